"""Helpers shared by the corpus operators."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share. Where that is unset, as in tests, a
    temporary folder, but only in local mode: executors on other machines would each write to their own disk."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not found.isDefined() and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = found.get() if found.isDefined() else tempfile.mkdtemp(prefix="quillfold-")
    return f"{base.rstrip('/')}/quillfold-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table written once to the shared folder: its lineage ends there and lost executors don't recompute it."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _few_rows(batches: Iterator[pa.RecordBatch], fn: Callable) -> Iterator[pa.RecordBatch]:
    return fn(b.slice(i, BATCH_ROWS) for b in batches for i in range(0, b.num_rows, BATCH_ROWS))


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """mapInArrow with batches of few rows. Spark bounds the bytes of the batches that it sends to a worker."""
    return df.mapInArrow(functools.partial(_few_rows, fn=fn), schema)


def raw(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
