"""Vector search by cosine over array columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def top_k(vectors: DataFrame, query: list[float], k: int = 20, where: Column | None = None, vector: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """The k nearest of the 2k nearest that fulfil the condition; ties go to the smaller id."""
    q = F.array(*(F.lit(float(x)) for x in query))
    scored = vectors.withColumn("score", cosine(F.col(vector), q)).orderBy(F.desc("score"), id_col)
    return scored.limit(2 * k).where(where).orderBy(F.desc("score"), id_col).limit(k) if where is not None else scored.limit(k)


def centroids(vectors: DataFrame, label: str, vector: str = "embedding") -> DataFrame:
    """(label, centroid): the mean vector of each label, of length 1."""
    cells = vectors.select(label, F.posexplode(vector).alias("i", "x")).groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    lists = cells.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda c: c["x"]).alias("c"))
    norm = F.sqrt(dot(F.col("c"), F.col("c")))
    return lists.select(label, F.when(norm > 0, F.transform("c", lambda x: x / norm)).otherwise(F.col("c")).alias("centroid"))


def classify(vectors: DataFrame, named: DataFrame, label: str, gap: float = 0.02, top: int = 5, vector: str = "embedding", id_col: str = "vec_id", max_centroids: int = 4096) -> DataFrame:
    """The nearest centroids of each vector: best, its lead over the second, whether that is less than `gap`, and the top.

    named: (label, centroid), a small table; more than max_centroids of them are refused.
    """
    rows = named.select(F.col(label).alias("n"), "centroid").orderBy("n").limit(max_centroids + 1).collect()
    if len(rows) > max_centroids:
        raise ValueError("too many centroids to compare every vector with")
    ranked = F.sort_array(F.array(*(F.struct(cosine(F.col(vector), F.array(*(F.lit(float(x)) for x in r["centroid"]))).alias("s"), F.lit(str(r["n"])).alias("n")) for r in rows)), False)
    out = vectors.withColumn("_r", ranked)
    lead = F.when(F.size("_r") > 1, F.col("_r")[0]["s"] - F.col("_r")[1]["s"]).otherwise(1.0)
    return out.select(id_col, F.col("_r")[0]["n"].alias("best"), F.col("_r")[0]["s"].alias("score"), lead.alias("lead"), (lead < gap).alias("boundary"), F.transform(F.slice("_r", 1, top), lambda x: x["n"]).alias("top"))


def row_cosine(records: DataFrame, columns: list[str], focal: dict[str, float]) -> DataFrame:
    """Cosine of each record's numeric fields with those of one record; missing numbers are 0."""
    row = F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns))
    return records.withColumn("score", cosine(row, F.array(*(F.lit(float(focal.get(c, 0.0))) for c in columns))))


def aligned(vectors: DataFrame, matrix: list[list[float]], vector: str = "embedding") -> DataFrame:
    """Vectors times a matrix (a row for each of their dimensions), of length 1 again; without length they stay as they are.
    The matrix is as large as a vector is long, whatever the number of vectors."""
    m = np.array(matrix, dtype=np.float64)

    @F.pandas_udf("array<double>")
    def turn(v: pd.Series) -> pd.Series:
        x = np.array([np.asarray(a, np.float64) for a in v]).reshape(-1, len(m)) @ m
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return pd.Series(list(np.divide(x, norm, out=x, where=norm > 0)))

    return vectors.withColumn(vector, turn(F.col(vector)))
