"""Alternative histories: what the fields of an entity are as of a time, under one merge policy or another.

writes: (entity, source, field, value, ts, seq), a row for each field that a source sets. links: (source, into, ts):
the source is merged into an entity at that time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(writes: DataFrame, ts=None, by: tuple[str, ...] = ("entity",)) -> DataFrame:
    """(by..., field, value, ts): the last value of each field at or before ts."""
    rows = writes if ts is None else writes.where(F.col("ts") <= F.lit(ts))
    return rows.groupBy(*by, "field").agg(F.max_by(F.struct("value", "ts", "seq"), F.struct("ts", "seq")).alias("x")).select(*by, "field", "x.value", "x.ts", "x.seq")


def worlds(writes: DataFrame, links: DataFrame, ts=None) -> DataFrame:
    """(world, entity, field, value) in three worlds.

    never: sources stay apart; always: sources count as their entity from the start; canonical: from the merge on, the
    entity has its sources' fields as they were then (the source listed last wins), and later writes to it on top.
    """
    upto = writes if ts is None else writes.where(F.col("ts") <= F.lit(ts))
    link = links if ts is None else links.where(F.col("ts") <= F.lit(ts))
    into = link.select("source", F.col("into").alias("_into"), F.col("ts").alias("_merged"), F.col("place").alias("_place") if "place" in links.columns else F.lit(0).alias("_place"))
    never = as_of(upto.withColumn("entity", F.col("source"))).select(F.lit("never").alias("world"), "entity", "field", "value")
    joined = upto.join(into, "source", "left")
    always = as_of(joined.withColumn("entity", F.coalesce("_into", "source"))).select(F.lit("always").alias("world"), "entity", "field", "value")
    before = joined.where(F.col("_into").isNotNull() & (F.col("ts") <= F.col("_merged"))).groupBy("_into", "field").agg(F.max_by("value", F.struct("_place", "ts", "seq")).alias("value"))
    own = as_of(upto.withColumn("entity", F.col("source"))).join(link.select(F.col("source").alias("_s")).distinct(), F.col("entity") == F.col("_s"), "left_anti")
    canonical = before.withColumnRenamed("_into", "entity").join(own.select("entity", "field", F.col("value").alias("own")), ["entity", "field"], "full_outer").select(F.lit("canonical").alias("world"), "entity", "field", F.coalesce("own", "value").alias("value"))
    return never.unionByName(always).unionByName(canonical)


def divergence(writes: DataFrame) -> DataFrame:
    """Writes to a field that another source has set before, with the number of sources so far."""
    w = Window.partitionBy("entity", "field").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    first = Window.partitionBy("entity", "field", "source").orderBy("ts", "seq")
    fresh = writes.withColumn("_new", (F.row_number().over(first) == 1).cast("int"))
    return fresh.withColumn("sources", F.sum("_new").over(w)).where("sources > 1").drop("_new")


def neighbours_in_time(points: DataFrame, by: str, ts: str) -> DataFrame:
    """Every point of divergence with the ones before and after it."""
    w = Window.partitionBy(by).orderBy(ts, "field")
    return points.withColumn("previous", F.lag(ts).over(w)).withColumn("next", F.lead(ts).over(w))


def stance(contributions: DataFrame, how: str) -> DataFrame:
    """contributions: (entity, field, source, value, ts). What several sources' values of a field come to.

    clearing: that of the first source by name; binding: all, by source; dissecting: a conflict where they differ;
    composing: the mean of numbers, else the distinct texts joined; tracing: the latest.
    """
    number = F.col("value").try_cast("double")
    g = contributions.groupBy("entity", "field")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source", "value"))), lambda x: x["value"]), " | ")
    if how == "clearing":
        out = F.min_by("value", "source")
    elif how == "binding":
        out = listed
    elif how == "dissecting":
        out = F.when(F.count_distinct("value") > 1, F.concat(F.lit("conflict: "), listed)).otherwise(F.min("value"))
    elif how == "composing":
        out = F.when(F.count(number) == F.count("value"), F.avg(number).cast("string")).otherwise(F.array_join(F.array_sort(F.collect_set("value")), " + "))
    elif how == "tracing":
        out = F.max_by("value", F.struct("ts", "source"))
    else:
        raise ValueError(f"no stance {how!r}")
    return g.agg(out.alias("value"), F.count_distinct("source").alias("sources"))


def timeline(writes: DataFrame, steps: int = 21) -> DataFrame:
    """(step, entity, field, value): the state at evenly spaced times, by one pass over the changes of each field.

    A value holds from its write to the next; steps are a small table that meets each value's span.
    """
    spark = writes.sparkSession
    low, high = writes.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    if low is None:
        return writes.select(F.lit(0).alias("step"), "entity", "field", "value").limit(0)
    at = spark.range(steps).select(F.col("id").cast("int").alias("step"), (F.lit(low) + ((high - low) * F.col("id") / max(steps - 1, 1))).cast("long").alias("at"))
    w = Window.partitionBy("entity", "field").orderBy("ts", "seq")
    spans = writes.select("entity", "field", "value", F.unix_micros("ts").alias("a"), F.lead(F.unix_micros("ts")).over(w).alias("b"))
    return spans.join(F.broadcast(at), (F.col("at") >= F.col("a")) & (F.col("b").isNull() | (F.col("at") < F.col("b")))).select("step", "entity", "field", "value")
