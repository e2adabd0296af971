"""Looking back along the rows of a key, in order, without one task for a key that has very many of them.

A key's rows are split by ranges of their order: days, or 2**20 numbers. Within a range a window looks back; what lies
before the range is one row a range, combined before it is shuffled, and carried over. Rows without key stand alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS, SECONDS = 20, 86_400


def span(rows: DataFrame, column: str) -> Column:
    """The range that a value of this column lies in."""
    kind = rows.schema[column].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.floor(F.unix_seconds(F.col(column).cast("timestamp")) / SECONDS)
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.shiftright(F.col(column).cast("long"), BITS)
    return F.lit(0).cast("long")


def lagged(rows: DataFrame, by: list[str], order: list[str], what: list[str], prefix: str = "prev_", spans: bool = False) -> DataFrame:
    """rows with the values of `what` in the key's row before, and `_first`, whether there is none; with `_span` if asked."""
    values = F.struct(*what)
    placed = rows.withColumn("_span", span(rows, order[0]))
    last = placed.groupBy(*by, "_span").agg(F.max_by(values, F.struct(*order)).alias("_last"))
    carried = last.select(*by, "_span", F.lag("_last").over(Window.partitionBy(*by).orderBy("_span")).alias("_carried"))
    w = Window.partitionBy(*by, "_span").orderBy(*order)
    out = placed.join(carried, [*by, "_span"], "left").withColumn("_before", F.coalesce(F.lag(values).over(w), "_carried"))
    return out.select(*rows.columns, *(F.col(f"_before.{c}").alias(f"{prefix}{c}") for c in what), F.col("_before").isNull().alias("_first"), *(["_span"] if spans else []))


def running(rows: DataFrame, by: list[str], order: list[str], number: str, name: str) -> DataFrame:
    """rows with the sum of a number over the key's rows up to each of them."""
    placed = rows.withColumn("_span", span(rows, order[0]))
    sums = placed.groupBy(*by, "_span").agg(F.sum(number).alias("_sum"))
    w = Window.partitionBy(*by).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*by, "_span", F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_carried"))
    within = F.sum(number).over(Window.partitionBy(*by, "_span").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = placed.join(carried, [*by, "_span"], "left").withColumn(name, F.coalesce("_carried", F.lit(0)) + within)
    return out.select(*rows.columns, name)
