"""Graphs as edge tables (source, dest): walks of bounded depth, degrees and roles, components."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfold.functions import paths


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="quillfold-")


def settled(df: DataFrame) -> DataFrame:
    """df written once to spark.checkpoint.dir, which all executors share, and read again: its lineage ends there.

    Unlike checkpoint(), which computes a plan twice, this computes it once. Where the setting is unset a temporary
    folder is used in local mode; executors on other machines would each write to their own disk, so there it is an error.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own_folder()
    path = f"{base.rstrip('/')}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def traverse(edges: DataFrame, starts: DataFrame, depth: int, direction: str = "forward", settle_every: int = 3) -> DataFrame:
    """(node, distance): what is reached from starts (node) in at most depth steps, nearest distance first.

    What is found is one table, written every few steps; a step joins its outermost nodes with the edges and keeps the
    least distance of each node, combined before the shuffle.
    """
    forward = edges.select(F.col("source").alias("_from"), F.col("dest").alias("_to"))
    back = edges.select(F.col("dest").alias("_from"), F.col("source").alias("_to"))
    steps = {"forward": forward, "reverse": back, "both": forward.unionByName(back)}[direction]
    found = starts.select("node").distinct().withColumn("distance", F.lit(0))
    for d in range(1, depth + 1):
        ahead = found.where(F.col("distance") == d - 1).join(steps, F.col("node") == F.col("_from")).select(F.col("_to").alias("node"), F.lit(d).alias("distance"))
        found = found.unionByName(ahead).groupBy("node").agg(F.min("distance").alias("distance"))
        if d % settle_every == 0 and d < depth:
            found = settled(found)
    return found


def touching(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges with either end among the chosen nodes (node)."""
    c = chosen.select("node").distinct()
    out = edges.join(c, edges["source"] == c["node"], "left_semi")
    rest = edges.join(c, edges["source"] == c["node"], "left_anti")
    return out.unionByName(rest.join(c, rest["dest"] == c["node"], "left_semi"))


def walked_edges(edges: DataFrame, reached: DataFrame, depth: int) -> DataFrame:
    """The out-edges of every node that a walk of this depth expanded."""
    return edges.join(reached.where(F.col("distance") < depth).select(F.col("node").alias("source")), "source", "left_semi")


def degrees(edges: DataFrame) -> DataFrame:
    """in_degree, out_degree, degree and mutual (links both ways) of every node, and its role.

    isolated: no edges; hub: six or more; bridge: its neighbours are in two collections or more; else leaf. Each pair of
    nodes is one row, with the directions that it is linked in, so both ends count from one shuffle of the edges.
    """
    up = F.col("source") <= F.col("dest")
    pairs = edges.groupBy(F.least("source", "dest").alias("a"), F.greatest("source", "dest").alias("b")).agg(F.max(up.cast("int")).alias("up"), F.max((~up).cast("int")).alias("down"))
    end = lambda node, other, out, into: F.struct(F.col(node).alias("node"), F.col(other).alias("other"), F.col(out).alias("out"), F.col(into).alias("into"))
    loop = F.struct(F.col("a").alias("node"), F.col("b").alias("other"), F.lit(1).alias("out"), F.lit(1).alias("into"))
    ends = pairs.select(F.explode(F.when(F.col("a") == F.col("b"), F.array(loop)).otherwise(F.array(end("a", "b", "up", "down"), end("b", "a", "down", "up")))).alias("e")).select("e.*")
    collection = paths.parent(F.col("other").cast("string"))
    out = ends.groupBy("node", collection.alias("c")).agg(*(F.sum(x).alias(n) for n, x in (("in_degree", F.col("into")), ("out_degree", F.col("out")), ("mutual", F.col("out") * F.col("into")))))
    out = out.groupBy("node").agg(*(F.sum(c).alias(c) for c in ("in_degree", "out_degree", "mutual")), F.count("c").alias("collections"))
    out = out.withColumn("degree", F.col("in_degree") + F.col("out_degree"))
    role = F.when(F.col("degree") == 0, "isolated").when(F.col("degree") >= 6, "hub").when(F.col("collections") >= 2, "bridge").otherwise("leaf")
    return out.select("node", "in_degree", "out_degree", "degree", "mutual", "collections", role.alias("role"))


def centrality(edges: DataFrame) -> DataFrame:
    """Out-degree over the number of other nodes."""
    nodes = edges.select(F.col("source").alias("node")).unionByName(edges.select(F.col("dest").alias("node"))).distinct()
    n = nodes.agg(F.count("*").alias("_n"))
    out = edges.groupBy(F.col("source").alias("node")).agg(F.count_distinct("dest").alias("out_degree"))
    rows = nodes.join(out, "node", "left").crossJoin(F.broadcast(n))  # one row
    return rows.select("node", F.coalesce("out_degree", F.lit(0)).alias("out_degree"), F.when(F.col("_n") > 1, F.coalesce("out_degree", F.lit(0)) / (F.col("_n") - 1)).otherwise(0.0).alias("centrality"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): undirected; a component is named by its smallest node.

    Every round a node takes the smallest label around it, then its label's label, so labels travel by doubling steps.
    """
    both = edges.select("source", "dest").unionByName(edges.select(F.col("dest").alias("source"), F.col("source").alias("dest")))
    both = settled(both.distinct())
    labels = settled(both.select(F.col("source").alias("node")).distinct().withColumn("component", F.col("node")))
    for _ in range(rounds):
        near = both.join(labels, both["dest"] == labels["node"]).groupBy(F.col("source").alias("node")).agg(F.min("component").alias("near"))
        new = labels.join(near, "node").select("node", F.least("component", "near").alias("component"), (F.col("near") < F.col("component")).alias("moved"))
        jump = new.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        new = settled(new.join(jump, new["component"] == jump["_n"], "left").select("node", F.least("component", F.coalesce("_c", "component")).alias("component"), "moved"))
        labels = new.select("node", "component")
        if new.where("moved").isEmpty():
            return labels
    raise RuntimeError("components did not settle")


def reaches_itself(edges: DataFrame, depth: int) -> DataFrame:
    """Nodes that lie on a cycle of at most depth edges."""
    steps = edges.select("source", "dest").distinct()
    ahead, found = steps.select(F.col("source").alias("start"), F.col("dest").alias("at")), None
    for _ in range(depth):
        ahead = settled(ahead)
        hit = ahead.where("start = at").select(F.col("start").alias("node"))
        found = hit if found is None else found.unionByName(hit)
        ahead = ahead.where("start <> at").join(steps, F.col("at") == F.col("source")).select("start", F.col("dest").alias("at")).distinct()
    return found.distinct()


