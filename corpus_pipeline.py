"""The corpus pipeline: documents are filtered, deduplicated, cleaned of personal data, mixed and packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillfold.llm import mixing, packing, pii, quality, simhash
from quillfold.llm.common import table, written

#: Each takes (spark, docs, sf_dir); all but the last return the columns of documents.
STAGES = [
    ("quality rules", quality.quality_stage),
    ("simhash near-dedup", simhash.dedup_stage),
    ("personal data", pii.pii_stage),
    ("mixing", mixing.mixing_stage),
    ("packing", packing.packing_stage),
]

#: Trained models and tokenizers can't be put in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)  # as the next stage's input, read again from the shared folder
    return docs
