"""The pipeline's stages one after another, each held against what it must keep."""

import corpus_pipeline
from quillfold.llm import registry
from quillfold.llm.common import written

from .test_corpus import brute_components, check_packed


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{tables}/labels.parquet").collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, tables))
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.schema["doc_id"] == before.schema["doc_id"]
    before, after = seen["simhash near-dedup"]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    assert sorted(r["doc_id"] for r in after.collect()) == sorted({c for _, _, c in brute_components(rows)})
    before, after = seen["personal data"]
    assert before.count() == after.count() and after.where("text rlike '@mail[0-9]'").count() == 0
    before, after = ({r["doc_id"] for r in x.collect()} for x in seen["mixing"])
    clean = {k for k in before if k in labels and labels[k]["quality"] == 1 and labels[k]["toxic"] == 0}
    assert after <= before and len(clean - after) <= 0.02 * len(clean)
    before, after = seen["packing"]
    check_packed([(r["doc_id"], r["text"]) for r in before.collect()], after.collect())


def test_run_and_names(spark, tables):
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 11))
    assert corpus_pipeline.run(spark, tables).count() > 0
