"""Pairs of rows with equal keys, dealt out by the number of pairs and not by that of the rows."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a key that stand in one list, and what a task takes at most on average, up to PARTS tasks.
CHUNK, ROWS, PAIRS, PARTS = 1_024, 1 << 17, 1 << 21, 20_000


def within(rows: DataFrame, key: list[str], id_col: str) -> DataFrame:
    """(a, b), a < b: the ids of each two rows with equal keys. A row with a null in its key or id is in no pair.

    The rows are read twice: first their keys are counted, and only the sums come to the driver. A key of more than CHUNK
    rows is cut into chunks by id; each two of its chunks are a row of their own, so no task needs a key whole.
    """
    ids = rows.select(*key, F.col(id_col).alias("_id")).dropna()
    sizes = ids.groupBy(*key).agg(F.count("*").alias("_n"))
    n = F.col("_n").cast("double")
    total = sizes.agg(F.sum(n).alias("rows"), F.sum(n * (n - 1) / 2).alias("pairs"), F.max("_n").alias("most")).first()
    parts = min(PARTS, max(1, ceil(max((total["rows"] or 0) / ROWS, (total["pairs"] or 0) / PAIRS))))
    if (total["most"] or 0) <= CHUNK:
        return _emitted(_lists(ids.withColumn("_chunks", F.lit(1)), key, parts).withColumn("_other", F.col("_ids")), F.lit(True))
    large = sizes.where(F.col("_n") > CHUNK).select(*key, F.ceil(F.col("_n") / CHUNK).cast("int").alias("_chunks"))
    chunked = ids.join(large, key, "left").withColumn("_chunks", F.coalesce("_chunks", F.lit(1)))
    lists = _lists(chunked.withColumn("_c", F.pmod(F.xxhash64("_id"), F.col("_chunks")).cast("int")), [*key, "_c"], parts)
    alone = _emitted(lists.where("_chunks = 1").withColumn("_other", F.col("_ids")), F.lit(True))
    met = lists.where("_chunks > 1").withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    met = met.select(*key, "_c", "_ids", F.least("_c", "_o").alias("_lo"), F.greatest("_c", "_o").alias("_hi"))
    side = lambda c: F.first(F.when(F.col("_c") == F.col(c), F.col("_ids")), ignorenulls=True)
    blocks = met.repartition(parts, *key, "_lo", "_hi").groupBy(*key, "_lo", "_hi").agg(side("_lo").alias("_ids"), side("_hi").alias("_other"))
    return alone.unionByName(_emitted(blocks, F.col("_lo") == F.col("_hi")))


def _lists(chunked: DataFrame, by: list[str], parts: int) -> DataFrame:
    return chunked.repartition(parts, *by).groupBy(*by).agg(F.collect_list("_id").alias("_ids"), F.max("_chunks").alias("_chunks"))


def _emitted(lists: DataFrame, same) -> DataFrame:
    """The pairs between two lists of ids; where they are the same list, each once. Equal ids are in one chunk."""
    a, b = F.col("_a"), F.col("_b")
    out = lists.select(F.explode("_ids").alias("_a"), "_other", same.alias("_same")).select("_a", F.explode("_other").alias("_b"), "_same")
    return out.where(~F.col("_same") | (a < b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


__all__ = ["within"]
