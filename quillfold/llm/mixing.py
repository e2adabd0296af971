"""Mixing domains to target weights with soft membership.

A classifier, fitted to a bounded sample of the labelled table, gives each document's posterior over the domains
(`clean`, `low` quality, `toxic`). Nonnegative rates of the documents are then fitted by projected-gradient least
squares, so that the domains' expected token totals, the sum of rate * tokens * posterior, match their targets. A step
needs the totals of all documents, three sums, and changes each document's rate by what its posterior says, so the
rates are a function of the posteriors and of the few steps taken: nothing as long as the corpus leaves the executors.
A document is repeated floor(rate) times and once more by chance, by a hash of its id.

Unless weights are given, the targets are what clean documents hold: every document counts as far as it is clean, so a
domain's target is the sum of EPOCHS * posterior of clean * tokens * posterior of the domain. What is surely not clean has
no place in that mixture; a share of low quality or toxic text is left in it only where the classifier can't tell.

Tokens are words. Null texts are empty: no tokens, and the features of an empty text. Labels that are null, or whose
document is missing, are not learned from; of several labels of one document the worst counts. Repeated rows are mixed
each (with the same outcome); further columns are ignored; an empty table gives an empty result. Without labels every
document is clean.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfold.llm.common import map_batches, raw, table, written

DOMAINS = ("clean", "low", "toxic")
#: How often what is surely clean is read in the mixture.
EPOCHS = 1.2
MAX_LABELLED, FEATURES = 8000, 64
MAX_STEPS, TOLERANCE = 40, 1e-4
DAMPING = (1e-9, 1e-3, 1e-2, 0.1, 1.0)

_MARKS = b".,;:!?()\"'"


def features(text: bytes) -> tuple[int, set[bytes]]:
    """Number of words, and what the classifier may look at: bare words, how words end, and shares in coarse steps."""
    words = text.split()
    low = {w.strip(_MARKS) for w in {x.lower() for x in words}}
    out, n = {b"w:" + w for w in low if w}, max(len(words), 1)
    for mark in (b"$$$", b"###", b"%%%", b"&&&", b"***", b"!!", b"|"):
        share = text.count(mark) / n
        if share > 0.02:
            out.add(b"m:" + mark)
        if share > 0.2:
            out.add(b"M:" + mark)
    out.add(b"d:%d" % int(10 * len(set(words)) / n))
    out.add(b"u:%d" % int(5 * sum(w.isupper() for w in words) / n))
    out.add(b"n:%d" % len(words).bit_length())
    out.add(b"l:%d" % min(12, int(len(text) / n)))
    return len(words), out


@dataclass
class Classifier:
    """Logistic regression over the presence of chosen features."""

    names: dict[bytes, int]
    weights: np.ndarray  # [feature + 1, domain], the last row is the intercept

    def posteriors(self, found: list[set[bytes]]) -> np.ndarray:
        known = set(self.names)
        out = np.repeat(self.weights[-1:], len(found), 0)
        for i, f in enumerate(found):
            out[i] += self.weights[[self.names[x] for x in known & f]].sum(0)
        out = np.exp(out - out.max(1, keepdims=True))
        return out / out.sum(1, keepdims=True)


def _labelled_features(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([list(features(x)[1]) for x in raw(batch.column(1))], pa.list_(pa.binary()))], names=["y", "f"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED, n_features: int = FEATURES) -> Classifier:
    """Chooses the features of most mutual information with the domain, then fits their weights."""
    spark = docs.sparkSession
    worst = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    domain = F.when(F.col("t") > 0, 2).when(F.col("q") > 0, 0).otherwise(1)
    chosen = worst.select("doc_id", domain.alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).collect()
    if not chosen:
        return Classifier({}, np.array([[30.0, 0.0, 0.0]]))
    keys = spark.createDataFrame([(r["doc_id"], r["y"]) for r in chosen], "label_id long, y int")  # max_labelled rows
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # of repeated ids one text, so that the sample is as bounded as its ids
    sample = texts.join(F.broadcast(keys), texts["id"] == keys["label_id"]).groupBy("label_id", "y").agg(F.min("text").alias("text")).select("y", "text")
    sample = written(map_batches(sample, _labelled_features, "y int, f array<binary>"))
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    if not total:
        return Classifier({}, np.array([[30.0, 0.0, 0.0]]))
    with_f = sample.select("y", F.explode("f").alias("f")).groupBy("f").agg(*(F.sum((F.col("y") == d).cast("long")).alias(f"n{d}") for d in range(3)))
    have = sum(F.col(f"n{d}") for d in range(3))

    def part(joint: Column, one: Column, d: int) -> Column:
        return F.when(joint > 0, joint / total * F.log(joint * total / (one * max(sizes.get(d, 0), 1)))).otherwise(0.0)

    information = sum(part(F.col(f"n{d}"), have, d) + part(F.lit(sizes.get(d, 0)) - F.col(f"n{d}"), F.lit(total) - have, d) for d in range(3))
    top = with_f.where(have > 4).orderBy(information.desc(), "f").limit(n_features).select("f").collect()
    names = {bytes(r["f"]): i for i, r in enumerate(top)}
    rows = sample.select("y", F.array_intersect("f", F.array(*(F.lit(bytearray(k)) for k in names)) if names else F.array().cast("array<binary>")).alias("f")).collect()
    x, y = np.zeros((len(rows), len(names) + 1)), np.zeros((len(rows), 3))
    rows.sort(key=lambda r: (r["y"], sorted(map(bytes, r["f"]))))  # the same sums in whatever order rows come
    for i, r in enumerate(rows):
        x[i, [names[bytes(f)] for f in r["f"]]] = 1
        x[i, -1] = 1
        y[i, r["y"]] = 1
    return Classifier(names, _logistic(x, y))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, steps: int = 25) -> np.ndarray:
    """Newton steps of multinomial logistic regression; the ridge makes the surplus domain's weights unique."""
    n, k = x.shape[1], y.shape[1]
    w, held = np.zeros((n, k)), np.full(n, ridge)
    held[-1] = 1e-3  # the intercept is all but free
    for _ in range(steps):
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        slope = (x.T @ (y - p) - held[:, None] * w).T.ravel()
        curve = np.zeros((k, n, k, n))
        for i in range(k):
            for j in range(k):
                curve[i, :, j] = (x * (p[:, i] * ((i == j) - p[:, j]))[:, None]).T @ x + (i == j) * np.diag(held)
        step = np.linalg.solve(curve.reshape(k * n, k * n), slope).reshape(k, n).T
        w = w + step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def _posteriors(batches, at: int, shared):
    """Adds n_tokens and the posteriors to each batch."""
    classifier = shared.value
    for batch in batches:
        got = [features(x) for x in raw(batch.column(at))]
        p = classifier.posteriors([f for _, f in got]) if got else np.zeros((0, 3))
        extra = [pa.array([n for n, _ in got], pa.int64()), *(pa.array(p[:, d]) for d in range(3))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "n_tokens", *(f"p_{d}" for d in DOMAINS)])


def posteriors(docs: DataFrame, classifier: Classifier, text_col: str = "text") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(classifier)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "n_tokens long", *(f"p_{d} double" for d in DOMAINS)])
    return map_batches(docs, functools.partial(_posteriors, at=docs.columns.index(text_col), shared=shared), schema)


def rate(steps: list[tuple[float, ...]]) -> Column:
    """A document's rate after these steps, from its posteriors: nonnegative after each of them."""
    if not steps:
        return F.lit(1.0)
    taken = F.array(*(F.struct(*(F.lit(float(g)).alias(f"g{d}") for d, g in enumerate(s))) for s in steps))
    down = lambda s: sum(s[f"g{d}"] * F.col(f"p_{name}") for d, name in enumerate(DOMAINS))
    return F.aggregate(taken, F.lit(1.0), lambda r, s: F.greatest(F.lit(0.0), r - down(s)))


def fit_rates(scored: DataFrame, weights: tuple[float, ...] | None = None, epochs: float = EPOCHS) -> list[tuple[float, ...]]:
    """Steps of the projected gradient of the squared errors of the domains' totals, each error by its target's scale.

    In the metric of the documents' tokens a step takes the same from the rates of all documents of the same posterior.
    A step weighs the errors by the inverse Gram matrix of the posteriors (by tokens, of the documents whose rate isn't
    0), so the first one meets the targets but for the rates it would push below 0. One that doesn't lessen the error is
    damped towards the plain gradient; if no damping helps it isn't taken. So the last step is the best. A try sums a dozen
    numbers over all documents; after MAX_STEPS tries targets that no rates meet may be missed by a little more than need be.
    """
    k = len(DOMAINS)
    p, tokens = [F.col(f"p_{d}") for d in DOMAINS], F.col("n_tokens")

    def sums(steps) -> tuple[np.ndarray, np.ndarray]:
        rated = scored.withColumn("r", rate(steps))
        live = F.when(F.col("r") > 0, tokens).otherwise(0)
        row = rated.agg(*(F.sum(F.col("r") * tokens * p[i]).alias(f"s{i}") for i in range(k)), *(F.sum(live * p[i] * p[j]).alias(f"g{i}{j}") for i in range(k) for j in range(i, k))).first()
        return np.array([row[f"s{i}"] or 0.0 for i in range(k)]), np.array([[row[f"g{min(i, j)}{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])

    steps: list[tuple[float, ...]] = []
    have, gram = sums(steps)
    if not have.sum():
        return steps
    target = epochs * (gram[0] if weights is None else np.array(weights) / weights[0] * have[0])
    scale = np.maximum(target, 1e-3 * target.sum())
    off, now, tries, damped = lambda s: float(np.square((s - target) / scale).sum()), have, 0, 0
    while off(now) > TOLERANCE**2 and tries < MAX_STEPS:
        curve = gram / np.outer(scale, scale)
        longest = np.linalg.eigvalsh(curve).max()
        for i in range(damped, len(DAMPING)):
            step = np.linalg.solve(curve + DAMPING[i] * longest * np.eye(k), (now - target) / scale) / scale
            tries += 1
            tried, tried_gram = sums([*steps, tuple(step)])
            if off(tried) < off(now) * (1 - 1e-6):
                break
        else:
            break  # as near as rates of 0 and more can come
        steps.append(tuple(step))
        now, gram, damped = tried, tried_gram, max(0, i - 1)
    return steps


def copies(id_col: str = "doc_id", seed: int = 11) -> Column:
    chance = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 32)) / float(1 << 32)
    return F.floor(F.col("rate") + chance).cast("int")


def mix(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: tuple[float, ...] | None = None, epochs: float = EPOCHS) -> DataFrame:
    """doc_id, n_tokens, posteriors, rate and copies of every row."""
    classifier = fit(docs, labels, id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = written(posteriors(rows, classifier).drop("text"))
    return scored.withColumn("rate", rate(fit_rates(scored, weights, epochs))).withColumn("copies", copies())


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it; texts stay where they are and are scored beside their columns."""
    columns = [c for c in docs.columns if c in ("doc_id", "text", "lang", "source", "n_chars")]
    docs = docs.select(*columns)
    classifier = fit(docs, table(spark, sf_dir, "labels"))
    scored = written(posteriors(docs.select("doc_id", "text"), classifier).drop("text"))
    taken = posteriors(docs, classifier).withColumn("rate", rate(fit_rates(scored))).withColumn("copies", copies()).where("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*columns)
