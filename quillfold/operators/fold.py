"""From the event log to the state of every target.

log: (seq, op, target, operand MAP<STRING,STRING>, agent, ts, branch ...). The fold is declared, not replayed: what a
sequential reader would end with is the last write of each field since the target's value was last replaced. Both
minima of work are aggregates that combine before the shuffle, so a target with a third of all events is no hot task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillfold.functions import paths
from quillfold.operators.ordered import lagged, running

#: Operators that replace the whole value; DEF merges fields into it.
REPLACES = ("INS", "SEG", "EVA")
WRITES = (*REPLACES, "DEF")


def deduplicate(log: DataFrame, key: str = "client_event_id") -> DataFrame:
    """The first event of each client id; events without one all stay."""
    first = log.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("seq").alias("_first"))
    return log.join(first, key, "left").where(F.col("_first").isNull() | (F.col("seq") == F.col("_first"))).drop("_first")


def quarantine(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events that can be folded, and the others with the reason: a second INS, or a write before any INS."""
    first = log.where("op = 'INS'").groupBy("target").agg(F.min("seq").alias("_ins"))
    rows = log.join(first, "target", "left")
    reason = F.when((F.col("op") == "INS") & (F.col("seq") > F.col("_ins")), "target exists").when(
        F.col("op").isin("SEG", "EVA", "DEF") & (F.col("_ins").isNull() | (F.col("seq") < F.col("_ins"))), "no such target"
    )
    rows = rows.withColumn("error", reason)
    return rows.where("error is null").drop("_ins", "error"), rows.where("error is not null").drop("_ins")


def last_writes(log: DataFrame, upto=None, by: tuple[str, ...] = ("target",)) -> DataFrame:
    """(target, field, value, seq): the fields of every target as of seq upto (None: now)."""
    events = log.where(F.col("op").isin(*WRITES))
    if upto is not None:
        events = events.where(F.col("seq") <= upto)
    since = events.where(F.col("op").isin(*REPLACES)).groupBy(*by).agg(F.max("seq").alias("_since"))
    fields = events.select(*by, "seq", F.explode("operand").alias("field", "value")).groupBy(*by, "field").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))
    return fields.join(since, list(by), "left").where(F.col("_since").isNull() | (F.col("seq") >= F.col("_since"))).drop("_since")


def state(log: DataFrame, upto=None) -> DataFrame:
    """One row per target: value, and what the last event on it was."""
    fields = last_writes(log, upto).groupBy("target").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "value")))).alias("value"))
    events = log.where(F.col("op").isin(*WRITES))
    if upto is not None:
        events = events.where(F.col("seq") <= upto)
    about = events.groupBy("target").agg(*(F.max_by(c, "seq").alias(f"last_{c}") for c in ("op", "agent", "ts")), F.max("seq").alias("last_seq"))
    return about.join(fields, "target", "left").withColumn("depth", paths.depth(F.col("target")))


def edges(log: DataFrame) -> DataFrame:
    """log with operand {added, removed, edge_type} of CON events as columns `added`, `removed` (arrays), `edge_type`.

    The last action on each (source, dest) counts; of one event, removal comes after addition.
    """
    con = log.where("op = 'CON'")
    acts = con.select("target", "seq", "edge_type", F.explode_outer(F.coalesce("added", F.array().cast("array<string>"))).alias("dest"), F.lit(0).alias("removes")).unionByName(
        con.select("target", "seq", "edge_type", F.explode_outer(F.coalesce("removed", F.array().cast("array<string>"))).alias("dest"), F.lit(1).alias("removes"))
    )
    last = acts.where("dest is not null").groupBy(F.col("target").alias("source"), "dest").agg(F.max_by(F.struct("removes", "edge_type", "seq"), F.struct("seq", "removes")).alias("x"))
    return last.where("x.removes = 0").select("source", "dest", "x.edge_type", "x.seq")


def aliases(merges: DataFrame, hops: int = 10) -> DataFrame:
    """merges: (target, into). Every merged target with the one it ends in; the survivor itself has no alias."""
    out = merges.where("target <> into").groupBy("target").agg(F.max_by("into", "seq").alias("canonical")) if "seq" in merges.columns else merges.where("target <> into").select("target", F.col("into").alias("canonical")).dropDuplicates(["target"])
    step = out.select(F.col("target").alias("_t"), F.col("canonical").alias("_c"))
    reach = 1
    while reach < hops:  # pointer doubling: a chain of ten takes four joins
        out = out.join(step, out["canonical"] == step["_t"], "left").select("target", F.coalesce("_c", "canonical").alias("canonical"))
        step = out.select(F.col("target").alias("_t"), F.col("canonical").alias("_c"))
        reach *= 2
    return out


def resolve(rows: DataFrame, alias_map: DataFrame, column: str = "target") -> DataFrame:
    """Rows with the column replaced by what it is an alias of."""
    a = alias_map.select(F.col("target").alias("_a"), "canonical")
    return rows.join(a, rows[column] == a["_a"], "left").withColumn(column, F.coalesce("canonical", column)).drop("_a", "canonical")


def no_ops(log: DataFrame) -> DataFrame:
    """(seq, target, no_op) of DEF events: whether every field they set had that value already.

    A field has the value of its last write since the target's value was last replaced; a field or target that wasn't
    there changes. An empty operand changes nothing that exists.
    """
    writes = log.where(F.col("op").isin(*WRITES)).select("seq", "op", "target", "operand", F.col("op").isin(*REPLACES).cast("int").alias("_r"))
    since = running(writes, ["target"], ["seq"], "_r", "_epoch")
    fields = since.select("seq", "op", "target", "_epoch", F.explode("operand").alias("field", "value"))
    before = lagged(fields, ["target", "_epoch", "field"], ["seq"], ["value"], "_p_").where("op = 'DEF'")
    set_ = before.groupBy("target", "seq").agg(F.min(~F.col("_first") & F.col("value").eqNullSafe(F.col("_p_value"))).alias("no_op"))
    first = writes.groupBy("target").agg(F.min("seq").alias("_made"))
    empty = writes.where((F.col("op") == "DEF") & (F.coalesce(F.size("operand"), F.lit(0)) < 1)).join(first, "target").select("target", "seq", (F.col("seq") > F.col("_made")).alias("no_op"))
    return set_.unionByName(empty).select("seq", "target", "no_op")


def null_states(log: DataFrame) -> DataFrame:
    """NUL events with what they observe: `cleared` where the target was created before, else `never-set`."""
    w = Window.partitionBy("target").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    known = F.coalesce(F.max((F.col("op") == "INS").cast("int")).over(w), F.lit(0))
    return log.withColumn("nul_state", F.when(F.col("op") == "NUL", F.when(known == 1, "cleared").otherwise("never-set"))).where("op = 'NUL'")


def absorb(ours: DataFrame, theirs: DataFrame, policy: str = "binding") -> DataFrame:
    """ours, theirs: (target, value, seq, agent). Merges their branch into ours, target by target.

    Equal values and values of one side only need no policy. Else: `binding` keeps both as a conflict, `clearing` keeps
    none, `cultivating` keeps ours as pending, `last-write-wins` takes the later seq, `timestamp-ordered` breaks its ties
    by agent, `first` (and `authority-ranked`) keeps ours, `tending` the last agreed value, which a merge lacks: a conflict.
    """
    o = ours.select("target", *(F.col(c).alias(f"our_{c}") for c in ("value", "seq", "agent")))
    t = theirs.select("target", *(F.col(c).alias(f"their_{c}") for c in ("value", "seq", "agent")))
    both = o.join(t, "target", "full_outer")
    differs = F.col("our_seq").isNotNull() & F.col("their_seq").isNotNull() & ~F.col("our_value").eqNullSafe(F.col("their_value"))
    later = F.when(F.col("their_seq") > F.col("our_seq"), F.col("their_value")).otherwise(F.col("our_value"))
    stamped = F.when(F.struct("their_seq", "their_agent") > F.struct("our_seq", "our_agent"), F.col("their_value")).otherwise(F.col("our_value"))
    chosen = {"clearing": F.lit(None).cast("string"), "last-write-wins": later, "priority-weighted": later, "timestamp-ordered": stamped, "first": F.col("our_value"), "authority-ranked": F.col("our_value"), "cultivating": F.col("our_value")}
    if policy not in (*chosen, "binding", "tending"):
        raise ValueError(f"no merge policy {policy!r}")
    merged = F.when(~differs, F.when(F.col("our_seq").isNotNull(), F.col("our_value")).otherwise(F.col("their_value")))
    merged = merged.when(differs, chosen[policy]) if policy in chosen else merged
    kind = F.when(F.col("our_seq").isNull(), "copied").when(F.col("their_seq").isNull(), "ours").when(~differs, "equal").when(F.lit(policy == "cultivating"), "pending").when(F.lit(policy in chosen), "resolved").otherwise("conflict")
    return both.select("target", merged.alias("value"), kind.alias("outcome"), F.when(differs & F.lit(policy not in chosen), F.array("our_value", "their_value")).alias("candidates"))


def branch_history(log: DataFrame, lineage: list[tuple[str, int | None]]) -> DataFrame:
    """lineage: (branch, fork seq of the next one) from the oldest ancestor on; the last one has None: all its events."""
    out = None
    for branch, upto in lineage:
        part = log.where(F.col("branch") == branch)
        part = part if upto is None else part.where(F.col("seq") <= upto)
        out = part if out is None else out.unionByName(part)
    return out


def branch_state(log: DataFrame, lineage: list[str], scope: str | None = None) -> DataFrame:
    """State of the youngest branch; targets it lacks are read from its ancestors, nearest first."""
    rank = F.create_map(*[x for i, b in enumerate(lineage) for x in (F.lit(b), F.lit(i))])
    fields = last_writes(log.where(F.col("branch").isin(*lineage)), by=("branch", "target")).withColumn("_rank", rank[F.col("branch")])
    nearest = fields.groupBy("target").agg(F.max("_rank").alias("_rank"))
    out = fields.join(nearest, ["target", "_rank"]).drop("_rank")
    return out.where(paths.under(F.col("target"), scope, itself=True)) if scope else out


def sandbox(staged: DataFrame, current: DataFrame) -> DataFrame:
    """(target, value): what is staged shadows what is there."""
    s = staged.select("target", F.col("value").alias("staged"), F.lit(True).alias("is_staged"))
    return current.join(s, "target", "full_outer").select("target", F.when(F.col("is_staged"), F.col("staged")).otherwise(F.col("value")).alias("value"), F.coalesce("is_staged", F.lit(False)).alias("is_staged"))


def soft_delete(current: DataFrame, prefix: str, restore: bool = False) -> DataFrame:
    hit = paths.under(F.col("target"), prefix, itself=True)
    was = F.col("is_deleted") if "is_deleted" in current.columns else F.lit(False)
    return current.withColumn("is_deleted", F.when(hit, F.lit(not restore)).otherwise(was))


def crossing_edges(edge_rows: DataFrame, prefix: str) -> DataFrame:
    """Edges with exactly one end below the prefix."""
    inside = [paths.under(F.col(c), prefix, itself=True) for c in ("source", "dest")]
    return edge_rows.where(inside[0] != inside[1])


def chain_hash(log: DataFrame, payload: list[str], bits: int = 10, levels: int = 5) -> DataFrame:
    """(target, hash, n): each target's history in one digest, which changes with any event and with their order.

    Digests of 2**bits neighbouring seqs are hashed together, and again, level by level, so that no task gathers more
    than so many of a target's events.
    """
    digest = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in payload]), 256)
    rows = log.select("target", F.col("seq").alias("k"), digest.alias("d"), F.lit(1).cast("long").alias("n"))
    for level in range(levels):
        key = F.shiftright("k", bits) if level < levels - 1 else F.lit(0).cast("long")
        together = rows.groupBy("target", key.alias("k")).agg(F.array_sort(F.collect_list(F.struct("k", "d"))).alias("e"), F.sum("n").alias("n"))
        rows = together.select("target", "k", F.sha2(F.array_join(F.transform("e", lambda x: F.concat_ws(":", x["k"], x["d"])), "|"), 256).alias("d"), "n")
    return rows.select("target", F.col("d").alias("hash"), "n")


def store_fingerprint(hashes: DataFrame) -> DataFrame:
    """One row that two stores share if they hold the same (target, hash) rows, in whatever order: a sum of digests."""
    part = F.conv(F.substring(F.sha2(F.concat_ws(":", "target", "hash"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return hashes.agg(F.count("*").alias("n"), F.sum(part).cast("string").alias("fingerprint"))


def site_lifecycle(log: DataFrame) -> DataFrame:
    """First touch of each target, and when it became permanent: by its first operator but SIG."""
    return log.groupBy("target").agg(F.min("seq").alias("first_seq"), F.min_by("op", "seq").alias("first_op"), F.min(F.when(F.col("op") != "SIG", F.col("seq"))).alias("permanent_seq"))


def dangling(current: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """(missing, n): what integrity finds, counted by what is missing. Ends are counted before they meet the state."""
    ends = edge_rows.select(F.explode(F.array("source", "dest")).alias("missing")).groupBy("missing").agg(F.count("*").alias("n"))
    return ends.join(current.select(F.col("target").alias("missing")), "missing", "left_anti")


def integrity(current: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """Edges whose source or dest has no state."""
    ends = edge_rows.select("source", "dest", F.explode(F.array(F.struct(F.lit("source").alias("end"), F.col("source").alias("missing")), F.struct(F.lit("dest").alias("end"), F.col("dest").alias("missing")))).alias("e")).select("source", "dest", "e.end", "e.missing")
    return ends.join(current.select(F.col("target").alias("missing")), "missing", "left_anti")


def grounds(current: DataFrame) -> DataFrame:
    """What each target takes from its ancestors: their fields that it lacks, with the distance; the nearest counts."""
    up = current.select("target", "value", F.posexplode(paths.ancestors(F.col("target"))).alias("i", "ancestor"), "depth")
    above = current.select(F.col("target").alias("ancestor"), F.col("value").alias("above"))
    rows = up.join(above, "ancestor").select("target", "value", F.explode("above").alias("field", "inherited"), (F.col("depth") - 1 - F.col("i")).alias("distance"))
    rows = rows.where(~F.coalesce(F.map_contains_key("value", F.col("field")), F.lit(False)))
    return rows.groupBy("target", "field").agg(F.min_by("inherited", "distance").alias("value"), F.min("distance").alias("distance"))
