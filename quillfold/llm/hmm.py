"""A hidden Markov language model, trained by Baum-Welch over the whole corpus, and a unigram model beside it.

A text is its lower-cased (A-Z) words and one end. States emit classes of words: the most frequent words (and the end)
are a class of their own, all others share classes by their last letters. Within a shared class a word has the
probability (c + 1) / (tokens + words + 1 of the class), c being its count in training; all unseen words of a class
share the last part. The likelihood of a text is that of its classes, by the scaled forward recursion over the whole
text, times those of its words within their classes.

Counts of words come from a shuffle over all training texts. The HOT most frequent words, a bounded table, are
broadcast; what is left of each text, its rarer words, meets its counts in a join. Training and scoring read whole texts,
and every round of training all training texts.

Rows whose crc32 of the id leaves remainder HELD of FOLDS are held out; rows without id are scored only. Null texts are
empty: one token. Repeated rows count as often as they stand there, and get equal results. Without training texts all
counts are 0. Further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfold.llm.blocks import Blocks, settle, settle_back
from quillfold.llm.common import map_batches, table, written

FOLDS, HELD = 7, 2
HOT = 131_072
OWN, SHARED = 4096, 256
#: Of training: at most ROUNDS, until a token's log likelihood gains less than GAIN.
STATES, ROUNDS, GAIN = 6, 8, 1e-3
#: Words of a text that are walked one after another; where two walks of a block differ by less than SAME they are one.
BLOCK, SAME = 192, 1e-6
END = b""  # no word is empty
FLUSH = 400_000


def _words(text: bytes | None) -> list[bytes]:
    words = (text or b"").lower().split()
    words.append(END)
    return words


def _count(batches):
    """Words of a partition's texts with their counts, in a few parts if there are very many."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])
    seen: Counter[bytes] = Counter()

    def out():
        batch = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], schema=schema)
        seen.clear()
        return batch

    for batch in batches:
        for text in batch.column(0).cast(pa.binary()).to_pylist():
            seen.update(_words(text))
        if len(seen) > FLUSH:
            yield out()
    yield out()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over all of the one column's texts, ends included."""
    return map_batches(texts, _count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def shared_class(word: bytes) -> int:
    return OWN + zlib.crc32(word[-3:]) % SHARED


def _class_sizes(batches, own: frozenset):
    tokens, words = np.zeros(SHARED, np.int64), np.zeros(SHARED, np.int64)
    for batch in batches:
        for w, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if w not in own:
                k = shared_class(w) - OWN
                tokens[k] += c
                words[k] += 1
    yield pa.RecordBatch.from_arrays([pa.array(range(SHARED), pa.int32()), pa.array(tokens), pa.array(words)], names=["k", "tokens", "words"])


@dataclass
class Lexicon:
    """What is known of words: bounded by HOT and the number of classes, whatever the corpus."""

    hot: dict[bytes, int]
    counts: np.ndarray
    codes: np.ndarray
    class_cost: np.ndarray  # log10 of tokens + words + 1 of each shared class
    tokens: int
    words: int


def lexicon(counts: DataFrame) -> Lexicon:
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    # a threshold first, so that each task sends only its share of the HOT words to the driver
    least = counts.agg(F.percentile_approx("c", 1 - HOT / total["v"], 100_000)).first()[0] if total["v"] > HOT else 0
    top = counts.where(F.col("c") > least).orderBy(F.col("c").desc(), "word").limit(HOT).collect()
    hot = {bytes(r["word"]): i for i, r in enumerate(top)}
    own = frozenset(w for w, i in hot.items() if i < OWN)
    sizes = map_batches(counts, functools.partial(_class_sizes, own=own), "k int, tokens long, words long").groupBy("k").agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).collect()
    cost = np.zeros(SHARED)
    for r in sizes:
        cost[r["k"]] = np.log10(r["tokens"] + r["words"] + 1)
    codes = np.array([i if i < OWN else shared_class(w) for w, i in hot.items()], np.uint16)
    return Lexicon(hot, np.array([r["c"] for r in top], np.int64), codes, cost, total["n"], total["v"])


_CODED = "key long, doc_id long, held_out boolean, learns boolean, n_tokens long, codes binary, hot_known long, hot_log double, class_log double, rare array<struct<word:binary,n:int>>"
_CODED_ARROW = pa.schema(
    [
        ("key", pa.int64()),
        ("doc_id", pa.int64()),
        ("held_out", pa.bool_()),
        ("learns", pa.bool_()),
        ("n_tokens", pa.int64()),
        ("codes", pa.binary()),
        ("hot_known", pa.int64()),
        ("hot_log", pa.float64()),
        ("class_log", pa.float64()),
        ("rare", pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32())]))),
    ]
)


def _code(batches, shared):
    lex: Lexicon = shared.value
    get, log_c = lex.hot.get, np.log10(lex.counts + 1.0)
    key = TaskContext.get().partitionId() << 40
    for batch in batches:
        keys, sizes, codes, known, logs, class_logs, rare = [], [], [], [], [], [], []
        for text in batch.column(3).cast(pa.binary()).to_pylist():
            words = _words(text)
            at = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
            hot = at[at >= 0]
            code = np.empty(len(words), np.uint16)
            code[at >= 0] = lex.codes[hot]
            tail = [words[i] for i in np.flatnonzero(at < 0).tolist()]
            if tail:
                code[at < 0] = [shared_class(w) for w in tail]
            in_shared = code[code >= OWN] - OWN
            keys.append(key)
            key += 1
            sizes.append(len(words))
            codes.append(code.tobytes())
            known.append(len(hot))
            logs.append(float(log_c[hot].sum()))
            class_logs.append(float(log_c[hot[lex.codes[hot] >= OWN]].sum() - lex.class_cost[in_shared].sum()))
            rare.append([{"word": w, "n": n} for w, n in Counter(tail).items()])
        columns = [keys, batch.column(0), batch.column(1), batch.column(2), sizes, codes, known, logs, class_logs, rare]
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _CODED_ARROW, strict=True)], schema=_CODED_ARROW)


# --- the model ----------------------------------------------------------------------------------------------------


@dataclass
class Hmm:
    first: np.ndarray  # [state]
    move: np.ndarray  # [state, state]
    emit: np.ndarray  # [class, state]


def initial(unigram: np.ndarray, states: int = STATES, seed: int = 7) -> Hmm:
    rng = np.random.default_rng(seed)
    emit = unigram[:, None] * np.exp(rng.normal(0, 0.7, (len(unigram), states)))
    move = rng.dirichlet(np.full(states, 4.0), states) * 0.5 + np.eye(states) * 0.5
    return Hmm(np.full(states, 1 / states), move, emit / emit.sum(0))


def forward(model: Hmm, sequences: list[np.ndarray]) -> np.ndarray:
    """log10 likelihood of each whole sequence of classes: the scaled forward recursion."""
    sizes = np.array([len(s) for s in sequences], np.int64)
    r, out = Blocks(sizes, int(sizes.max(initial=1))), np.zeros(len(sequences))
    codes = r.laid(np.concatenate([*sequences, np.zeros(0, np.uint16)]))
    alpha = np.repeat(model.first[None], len(sequences), 0)
    for t, n in enumerate(r.live.tolist()):
        alpha = (alpha if t == 0 else alpha[:n] @ model.move) * model.emit[codes[r.begin[t] : r.begin[t] + n]]
        scale = alpha.sum(1)
        out[:n] += np.log10(scale)
        alpha /= scale[:, None]
    return out[r.rank]


def expected(model: Hmm, sequences: list[np.ndarray]) -> np.ndarray:
    """Baum-Welch counts of whole sequences as one row of numbers: of first states, moves and classes, and the log
    likelihood. Blocks of sequences are walked at once, forward and back, and joined."""
    k, c = len(model.first), len(model.emit)
    flat = np.concatenate([*sequences, np.zeros(0, np.uint16)])
    r = Blocks(np.array([len(s) for s in sequences], np.int64), BLOCK)
    codes, move = r.laid(flat), model.move.astype(np.float32)
    seen = model.emit.astype(np.float32)[codes]
    alpha, scales, beta = np.empty((len(flat), k), np.float32), np.empty(len(flat), np.float32), np.empty((len(flat), k), np.float32)

    one = np.ones(k, np.float32)

    def scaled(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total = a @ one  # twice as fast as sum
        return a / total[:, None], total

    cur = np.where(r.begins[r.order][:, None], model.first, model.move.mean(0)).astype(np.float32)
    for t, n in enumerate(r.live.tolist()):
        at = slice(r.begin[t], r.begin[t] + n)
        cur, scales[at] = scaled((cur if t == 0 else cur[:n] @ move) * seen[at])
        alpha[at] = cur

    def ahead(blocks: np.ndarray) -> np.ndarray:
        changed, cur, of, t = np.zeros(len(blocks), bool), alpha[r.last(blocks - 1)], np.arange(len(blocks)), 0
        while len(of):
            at = r.begin[t] + r.rank[blocks[of]]
            cur, scales[at] = scaled((cur @ move) * seen[at])
            same, end = np.abs(cur - alpha[at]).max(1) <= SAME, r.size[blocks[of]] == t + 1
            alpha[at] = cur
            changed[of[end & ~same]] = True
            go = ~(same | end)
            cur, of, t = cur[go], of[go], t + 1
        return changed

    settle(r.begins, ahead)
    back = np.ascontiguousarray(move.T)
    cur = np.zeros((0, k), np.float32)
    for t in range(len(r.live) - 1, -1, -1):
        at = slice(r.begin[t], r.begin[t] + int(r.live[t]))
        beta[at] = 1 / k
        if len(cur):
            beta[at][: len(cur)] = scaled(cur @ back)[0]
        cur = seen[at] * beta[at]

    def behind(blocks: np.ndarray) -> np.ndarray:
        changed, of, t = np.zeros(len(blocks), bool), np.arange(len(blocks)), r.size[blocks] - 1
        cur = r.first(blocks + 1)
        cur = seen[cur] * beta[cur]
        while len(of):
            at = r.begin[t] + r.rank[blocks[of]]
            new = scaled(cur @ back)[0]
            same, end = np.abs(new - beta[at]).max(1) <= SAME, t == 0
            beta[at] = new
            changed[of[end & ~same]] = True
            go = ~(same | end)
            cur, of, t = (seen[at] * new)[go], of[go], t[go] - 1
        return changed

    settle_back(r.ends, behind)
    gamma, both = scaled(alpha * beta)
    after = seen * beta / (scales * both)[:, None]  # what a move into here weighs
    moves = np.zeros((k, k), np.float64)
    for t, n in enumerate(r.live[1:].tolist()):
        moves += alpha[r.begin[t] : r.begin[t] + n].T @ after[r.begin[t + 1] : r.begin[t + 1] + n]
    inner = np.flatnonzero(~r.ends)
    moves += alpha[r.last(inner)].T @ after[r.first(inner + 1)]
    by_class = np.stack([np.bincount(codes, gamma[:, j], c) for j in range(k)], 1)
    first = gamma[r.first(np.flatnonzero(r.begins))].sum(0)
    return np.concatenate([first, (moves * model.move).ravel(), by_class.ravel(), [np.log(scales, dtype=np.float64).sum()]])


def _expect(batches, model):
    model, held, size, total = model.value, [], 0, None
    for batch in batches:
        for codes in batch.column(0).to_pylist():
            held.append(np.frombuffer(codes, np.uint16))
            size += len(held[-1])
            if size > 300_000:
                got = expected(model, held)
                total, held, size = got if total is None else total + got, [], 0
    if held:
        got = expected(model, held)
        total = got if total is None else total + got
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "x"])


def train(coded: DataFrame, classes: int = OWN + SHARED, states: int = STATES, rounds: int = ROUNDS) -> Hmm:
    """Rounds of Baum-Welch over the coded training texts, until the likelihood a token gains less than GAIN; only the
    model's own counts come to the driver."""
    spark, texts = coded.sparkSession, coded.where("learns").select("codes")
    k, likelihood = states, -np.inf
    x = np.zeros(classes)
    for row in map_batches(texts, _class_counts, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
        x[row["i"]] = row["x"]
    unigram, tokens = (x + 0.5) / (x + 0.5).sum(), max(x.sum(), 1.0)
    model = initial(unigram, states)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)
        x = np.zeros(k + k * k + classes * k + 1)
        for row in map_batches(texts, functools.partial(_expect, model=shared), "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
            x[row["i"]] = row["x"]
        first, move, emit = x[:k] + 0.1, x[k : k + k * k].reshape(k, k) + 0.1, x[k + k * k : -1].reshape(classes, k) + 2.0 * unigram[:, None]
        model = Hmm(first / first.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
        if x[-1] - likelihood < GAIN * tokens:
            break
        likelihood = x[-1]
    return model


def _class_counts(batches):
    total = np.zeros(OWN + SHARED)
    for batch in batches:
        for codes in batch.column(0).to_pylist():
            total += np.bincount(np.frombuffer(codes, np.uint16), minlength=OWN + SHARED)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "x"])


def _likelihood(batches, model):
    schema, model, keys, held, size = pa.schema([("key", pa.int64()), ("hmm", pa.float64())]), model.value, [], [], 0
    for batch in batches:
        for key, codes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            keys.append(key)
            held.append(np.frombuffer(codes, np.uint16))
            size += len(held[-1])
        if size > 3_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(forward(model, held))], schema=schema)
            keys, held, size = [], [], 0
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(forward(model, held))], schema=schema)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Trains on docs but the held-out rows, and scores all rows."""
    rest = F.crc32(F.col(id_col).cast("string")) % FOLDS
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(rest == HELD, F.lit(False)).alias("held_out"), F.coalesce(rest != HELD, F.lit(False)).alias("learns"), F.col(text_col).alias("text"))
    counts = written(word_counts(rows.where("learns").select("text")))
    lex = lexicon(counts)
    context = docs.sparkSession.sparkContext
    coded = written(map_batches(rows, functools.partial(_code, shared=context.broadcast(lex)), _CODED))
    model = train(coded)
    likely = map_batches(coded.select("key", "codes"), functools.partial(_likelihood, model=context.broadcast(model)), "key long, hmm double")
    rare = coded.select("key", F.explode("rare").alias("r")).select("key", F.col("r.word").alias("word"), F.col("r.n").alias("n"))
    rare = rare.join(counts, "word", "left").select("key", "n", F.coalesce("c", F.lit(0)).alias("c"))
    rare = rare.groupBy("key").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("rare_log"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"))
    full = coded.drop("codes", "rare", "learns").join(likely, "key").join(rare, "key", "left")
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    return full.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("hot_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(lex.tokens).cast("long").alias("train_tokens"),
        (F.col("hot_log") + rare_log - F.col("n_tokens") * float(np.log10(lex.tokens + lex.words + 1))).alias("base_score"),
        (F.col("hmm") + F.col("class_log") + rare_log).alias("score"),
    )


def op4_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
