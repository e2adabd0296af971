"""Several replicas of a log: their common order, what one lacks, what enough peers agree on, who may do what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clock(wall_ms: Column, logical: Column, replica: Column) -> Column:
    """Sorts as hybrid logical clocks do: wall time, then the counter, then the replica."""
    return F.struct(wall_ms.alias("wall_ms"), logical.alias("logical"), replica.alias("replica_id"))


def within(a: Column, b: Column, window_ms: int) -> Column:
    return F.abs(a["wall_ms"] - b["wall_ms"]) <= window_ms


def ticked(events: DataFrame, replica: str = "replica_id", wall: str = "wall_ms", seq: str = "seq") -> DataFrame:
    """Stamps local events: the wall time never falls, the counter rises while it stands still."""
    w = Window.partitionBy(replica).orderBy(seq)
    rows = events.withColumn("hlc_wall", F.max(wall).over(w))
    return rows.withColumn("hlc_logical", F.row_number().over(Window.partitionBy(replica, "hlc_wall").orderBy(seq)) - 1)


def missing(ours: DataFrame, theirs: DataFrame, key: str = "client_event_id") -> tuple[DataFrame, DataFrame]:
    """Events we lack, and events they lack."""
    return theirs.join(ours.select(key).distinct(), key, "left_anti"), ours.join(theirs.select(key).distinct(), key, "left_anti")


def quorum(verifications: DataFrame, item: str, digest: str, peer: str, least: int = 3) -> DataFrame:
    """(item, digest, peers) that at least so many peers vouch for independently."""
    return verifications.groupBy(item, digest).agg(F.count_distinct(peer).alias("peers")).where(F.col("peers") >= least)


def rarest_first(holders: DataFrame, item: str, peer: str) -> DataFrame:
    """Items by how few peers hold them; ties by a hash of the item."""
    return holders.groupBy(item).agg(F.count_distinct(peer).alias("available")).orderBy("available", F.sha2(F.col(item).cast("string"), 256))


def grants(events: DataFrame, member: str = "member", action: str = "action", role: str = "role", seq: str = "seq") -> DataFrame:
    """(member, role): the last grant of each member that no later revocation undid."""
    last = events.groupBy(member).agg(F.max_by(F.struct(action, role), seq).alias("x"))
    return last.where(F.col(f"x.{action}") == "grant").select(member, F.col(f"x.{role}").alias(role))
