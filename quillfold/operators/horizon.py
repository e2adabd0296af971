"""What a record is, what it stands in and what is near it, for all records of a state at once.

state: (target, value MAP<STRING,STRING>); fields may also be child targets with one value, `rec.field` {value: x}.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillfold.functions import paths
from quillfold.operators.graph import settled


def figures(state: DataFrame, record_depth: int = 3, scalar: str = "value") -> DataFrame:
    """Records with their direct child targets as fields; a record's own field wins over a child of that name."""
    t = F.col("target")
    own = state.where(paths.depth(t) == record_depth).select("target", "value")
    child = state.where(paths.depth(t) == record_depth + 1).select(paths.parent(t).alias("target"), F.struct(paths.leaf(t).alias("k"), F.col("value")[scalar].alias("v")).alias("e"))
    pivoted = child.groupBy("target").agg(F.map_from_entries(F.array_sort(F.collect_list("e"))).alias("children"))
    rows = own.join(pivoted, "target", "left")
    extra = F.map_filter("children", lambda k, v: ~F.map_contains_key("value", k))
    return rows.select("target", F.when(F.col("children").isNull(), F.col("value")).otherwise(F.map_concat("value", extra)).alias("value"))


def ancestry(state: DataFrame) -> DataFrame:
    """(target, ancestor, distance, siblings, children): a row for each ancestor, the nearest at distance 1."""
    t = F.col("target")
    kids = state.select(paths.parent(t).alias("p")).where("p is not null").groupBy("p").agg(F.count("*").alias("children"))
    up = state.select("target", paths.depth(t).alias("d"), F.posexplode(paths.ancestors(t)).alias("i", "ancestor"))
    rows = up.join(kids, up["ancestor"] == kids["p"], "left").select("target", "ancestor", (F.col("d") - 1 - F.col("i")).alias("distance"), F.coalesce("children", F.lit(0)).alias("children"))
    return rows.withColumn("siblings", F.when(F.col("distance") == 1, F.col("children") - 1))


def nearby(records: DataFrame, traits: list[str], key: str, top: int = 10) -> DataFrame:
    """(key, other, shared, distance): for each record the `top` others that share most traits; ties go to smaller keys.

    All records are compared, however common their traits, but without pairs. Records with the same values of all traits
    are one class; the records that have the same values of a set of traits are kept as the top + 1 smallest keys, for
    every set. Whoever is left out of the list of all traits that two records share has `top` records before it, so the
    lists hold every answer. A class makes 2^traits - 1 rows, so traits are few; its records share its answer but for
    themselves. Null is no trait, records without key are nobody's. distance = max(1, traits - shared + 1).
    """
    sets = [[f"v{i}" for i in range(len(traits)) if n >> i & 1] for n in range(1, 1 << len(traits))]
    values = [f"v{i}" for i in range(len(traits))]
    few = lambda df, *by: df.withColumn("_n", F.dense_rank().over(Window.partitionBy(*by).orderBy("_k"))).where(F.col("_n") <= top + 1)
    rows = records.where(F.col(key).isNotNull()).select(F.col(key).alias("_k"), *(F.col(t).cast("string").alias(v) for t, v in zip(traits, values, strict=True)))
    rows = rows.withColumn("_class", F.to_json(F.struct(*values)))
    classes = few(rows, "_class").groupBy("_class", *values).agg(F.collect_set("_k").alias("_keys"))
    member = lambda n, s: F.struct(F.lit(n).alias("n"), F.lit(len(s)).alias("shared"), F.to_json(F.struct(*s)).alias("v"), reduce(lambda x, y: x & y, (F.col(v).isNotNull() for v in s)).alias("whole"))
    entries = settled(classes.select("_class", "_keys", F.explode(F.array(*(member(n, s) for n, s in enumerate(sets)))).alias("e")).where("e.whole").select("_class", "_keys", "e.n", "e.shared", "e.v"))
    lists = few(entries.select("n", "v", F.explode("_keys").alias("_k")), "n", "v").groupBy("n", "v").agg(F.collect_set("_k").alias("others"))
    # of each number of shared traits all keys that have so many; then those that have no more
    level = lambda s: F.array_distinct(F.flatten(F.collect_list(F.when(F.col("shared") == s, F.col("others")))))
    near = entries.drop("_keys").join(lists, ["n", "v"]).groupBy("_class").agg(*(level(s).alias(f"_at{s}") for s in range(1, len(traits) + 1)))
    near = near.withColumn("_seen", F.slice(f"_at{len(traits)}", 1, 0)).withColumn("_near", F.array().cast(f"array<struct<shared:int,other:{records.schema[key].dataType.simpleString()}>>"))
    for s in range(len(traits), 0, -1):
        shared = F.lit(s).alias("shared")
        near = near.withColumn("_new", F.array_sort(F.array_except(f"_at{s}", "_seen"))).withColumn("_seen", F.concat("_seen", "_new"))
        near = near.withColumn("_near", F.concat("_near", F.transform("_new", lambda k: F.struct(shared, k.alias("other")))))
    near = near.select("_class", F.slice("_near", 1, top + 1).alias("_near"))
    mine = F.slice(F.filter("_near", lambda x: x["other"] != F.col("_k")), 1, top)
    out = rows.select("_k", "_class").join(near, "_class").select("_k", F.explode(mine).alias("x")).select("_k", "x.*")
    # a key may have several records; both steps by key need one shuffle
    out = out.repartition("_k").groupBy("_k", "other").agg(F.max("shared").alias("shared"))
    w = Window.partitionBy("_k").orderBy(F.desc("shared"), "other")
    distance = F.greatest(F.lit(1), F.lit(len(traits)) - F.col("shared") + 1)
    return out.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= top).select(F.col("_k").alias(key), "other", "shared", distance.alias("distance"))


def governance(state: DataFrame, registrations: DataFrame) -> DataFrame:
    """registrations: (target, rule). Each target with the nearest registration at it or above it."""
    t = F.col("target")
    up = state.select("target", F.explode(F.array_append(paths.ancestors(t), t)).alias("at"))
    r = registrations.select(F.col("target").alias("_t"), "rule")
    rows = up.join(r, up["at"] == r["_t"])
    nearest = rows.groupBy("target").agg(F.max_by(F.struct("at", "rule"), F.struct(paths.depth(F.col("at")), F.col("rule"))).alias("x"))
    return nearest.select("target", F.col("x.at").alias("governed_by"), "x.rule", F.when(F.col("x.at") == F.col("target"), "direct").otherwise("ancestor").alias("scope"))


def hash_cohorts(hashes: DataFrame, least: int = 2) -> DataFrame:
    """Targets with the same history: (hash, members, first, last)."""
    return hashes.groupBy("hash").agg(F.count("*").alias("members"), F.min("target").alias("first"), F.max("target").alias("last")).where(F.col("members") >= least)


def observations(log: DataFrame, now, target: str = "target", ts: str = "ts", stale_days: int = 14, gap_days: int = 3) -> DataFrame:
    """(target, kind, detail): targets untouched for long, and long pauses between neighbouring events of one target."""
    stale = log.groupBy(F.col(target).alias("target")).agg(F.max(ts).alias("t")).where(F.unix_seconds("t") < F.unix_seconds(F.lit(now)) - stale_days * 86400)
    w = Window.partitionBy(target).orderBy(ts)
    gaps = log.select(F.col(target).alias("target"), (F.unix_seconds(F.col(ts)) - F.unix_seconds(F.lag(ts).over(w))).alias("gap")).where(F.col("gap") > gap_days * 86400).groupBy("target").agg(F.max("gap").alias("gap"))
    days = lambda c: F.floor(c / 86400).cast("long")
    return stale.select("target", F.lit("stale").alias("kind"), days(F.unix_seconds(F.lit(now)) - F.unix_seconds("t")).alias("detail")).unionByName(gaps.select("target", F.lit("gap").alias("kind"), days(F.col("gap")).alias("detail")))
