"""Near-duplicates by SimHash: documents whose 64-bit fingerprints differ in few bits are linked.

Equal fingerprints are joined first, so a group of copies is one fingerprint with its smallest doc_id. The fingerprints
left are dealt out by the bits of two of six blocks: of two that differ in BUDGET = 4 bits, at least two blocks are
equal, so each link falls together in one of the 15 tables at least. Where a table's bucket is large, it is cut into
chunks, and each pair of chunks is joined apart. Within a bucket the join walks pairs of nodes of a binary trie
together, adds up the bits in which their paths differ and drops a pair as soon as they exceed the budget; a pair whose
fingerprints are connected already is dropped too, so a dense group gives a tree of links and not their square.

Words are lower-cased (A-Z), shingles have four of them, repeats count; a shorter text is one shingle, and a text
without words (or null) has fingerprint 0, linked like any other. Rows without doc_id are linked like others but never
give a component its name. Repeated rows are copies. Further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfold.llm.common import map_batches, table, written
from quillfold.llm.components import components

SHINGLE, SEED, BUDGET = 4, 42, 4
#: (lowest bit, bits) of the blocks; BUDGET + 2 of them, so that two are equal in linked fingerprints.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
CHUNK = 4096
LEAF = 64
HOT_SHARE = 1000


def fingerprint(text: bytes) -> int:
    """Signed 64 bits; a bit is 1 if it is in over half of the shingles' hashes."""
    words = text.lower().split()
    n = len(words) - SHINGLE + 1
    if n < 2:
        return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(words), SEED)).astype(np.int64)) if words else 0
    total, join, digest = np.zeros(64, np.int64), b" ".join, xxhash.xxh64_intdigest
    for a in range(0, n, 1 << 16):
        h = np.array([digest(join(words[i : i + SHINGLE]), SEED) for i in range(a, min(n, a + (1 << 16)))], dtype=">u8")
        total += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n).view(">u8")[0].astype(np.int64))


def _fingerprints(batches, at: int, schema: pa.Schema):
    for batch in batches:
        texts = [x or b"" for x in batch.column(at).cast(pa.binary()).to_pylist()]
        memo = {t: fingerprint(t) for t in set(texts)}
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([memo[t] for t in texts], pa.int64())], schema=schema)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row, fp a signed long."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(rows, functools.partial(_fingerprints, at=1, schema=pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])), "doc_id long, fp long")


# --- the trie join ------------------------------------------------------------------------------------------------


def trie_links(left: np.ndarray, right: np.ndarray | None = None, budget: int = BUDGET) -> list[tuple[int, int]]:
    """Links that connect what is connected by links of at most budget bits: within left, or from left to right.

    A node is a range of a sorted array whose members share the bits above `bit`.
    """
    a = np.sort(left.astype(np.uint64))
    b = a if right is None else np.sort(right.astype(np.uint64))
    members = a if right is None else np.concatenate([a, b])
    label, shift, out = np.arange(len(members)), 0 if right is None else len(a), []
    stack = [(0, len(a), 0, len(b), 63, 0)]
    while stack:
        a0, a1, b0, b1, bit, differing = stack.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        of_a, of_b = label[a0:a1], label[shift + b0 : shift + b1]
        if of_a[0] == of_b[0] and (of_a == of_a[0]).all() and (of_b == of_a[0]).all():
            continue
        same = right is None and a0 == b0 and a1 == b1
        if (a1 - a0) * (b1 - b0) <= LEAF * LEAF or bit < 0:
            near = np.bitwise_count(a[a0:a1, None] ^ b[None, b0:b1]) <= budget
            i, j = np.nonzero(near)
            i, j = i + a0, j + b0 + shift
            open_ = label[i] != label[j]
            for x, y in zip(i[open_].tolist(), j[open_].tolist(), strict=True):
                one, other = label[x], label[y]
                if one != other:
                    out.append((x, y))
                    label[label == other] = one
            continue
        half = np.uint64(1) << np.uint64(bit)
        am = a0 + int(np.searchsorted(a[a0:a1] & half, half))
        bm = b0 + int(np.searchsorted(b[b0:b1] & half, half))
        if differing < budget:
            stack.append((a0, am, bm, b1, bit - 1, differing + 1))
            if not same:
                stack.append((am, a1, b0, bm, bit - 1, differing + 1))
        stack.append((a0, am, b0, bm, bit - 1, differing))
        stack.append((am, a1, bm, b1, bit - 1, differing))
    signed = members.astype(np.int64)
    return [(int(signed[x]), int(signed[y])) for x, y in out]


def _join_buckets(batches):
    """Rows come sorted by bucket; side 0 and 1 are the chunks of a pair, side 2 a bucket or chunk joined with itself."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held: tuple | None = None
    sides: list[list[np.ndarray]] = [[], [], []]

    def close() -> list[tuple[int, int]]:
        got = [np.concatenate(s) if s else np.zeros(0, np.int64) for s in sides]
        for s in sides:
            s.clear()
        return (trie_links(got[2]) if len(got[2]) > 1 else []) + (trie_links(got[0], got[1]) if len(got[0]) and len(got[1]) else [])

    for batch in batches:
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)])
        fps, side = batch.column(4).to_numpy(zero_copy_only=False), batch.column(5).to_numpy(zero_copy_only=False)
        cuts = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1, [len(fps)]])
        links = []
        for s, e in itertools.pairwise(cuts.tolist()):
            if s == e:
                continue
            now = tuple(keys[:, s].tolist())
            if held is not None and now != held:
                links += close()
            held = now
            for k in range(3):
                if len(x := fps[s:e][side[s:e] == k]):
                    sides[k].append(x)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], schema=schema)
    links = close()
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], schema=schema)


def links(fps: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """fps: distinct (fp). Links (a, b) that connect all fingerprints that links of at most BUDGET bits connect."""

    def bits(block: tuple[int, int]):
        return F.shiftrightunsigned("fp", block[0]).bitwiseAND(F.lit((1 << block[1]) - 1))

    keys = [F.struct(F.lit(i).alias("t"), (bits(x) * (1 << 11) + bits(y)).alias("k")) for i, (x, y) in enumerate(itertools.combinations(BLOCKS, 2))]
    dealt = fps.select("fp", F.explode(F.array(*keys)).alias("x")).select("fp", "x.t", "x.k")
    sizes = dealt.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    dealt = dealt.join(sizes, ["t", "k"]).withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j"), F.when(own == j, 2).when(own < j, 0).otherwise(1).alias("side"))))
    paired = dealt.select("t", "k", "fp", pair.alias("p")).select("t", "k", "p.i", "p.j", "fp", "p.side")
    return map_batches(paired.repartition("t", "k", "i", "j").sortWithinPartitions("t", "k", "i", "j"), _join_buckets, "a long, b long")


def classes(prints: DataFrame) -> DataFrame:
    """prints: (doc_id, fp). The component of every fingerprint: (fp, n, component_id, root), n being its rows and root the
    component's smallest fingerprint."""
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = components(links(distinct.select("fp")))
    linked = distinct.join(roots, distinct["fp"] == roots["node"]).select("fp", "root", "least")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    whole = linked.join(least, "root").select("fp", "root", "component_id")
    return distinct.join(whole, "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("root", "fp").alias("root"))


def named(prints: DataFrame, of: DataFrame) -> DataFrame:
    """Every row of prints with what its fingerprint has in `of` (fp, ...).

    Fingerprints of more than one in HOT_SHARE rows, so HOT_SHARE at most, are looked up in a broadcast table and never
    shuffled: a group of copies is no hot key, whatever its size. of: with a column n, the rows of each fingerprint.
    """
    total = of.agg(F.sum("n").alias("n")).first()["n"] or 0
    hot = of.where(F.col("n") * HOT_SHARE > total).drop("n").withColumn("hot", F.lit(True))
    columns = [c for c in of.columns if c not in ("fp", "n")]
    tried = prints.join(F.broadcast(hot), "fp", "left")
    rest = tried.where("hot is null").drop("hot", *columns).join(of.where(F.col("n") * HOT_SHARE <= total).drop("n"), "fp")
    return tried.where("hot").drop("hot").unionByName(rest)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint and component_id of every row."""
    prints = written(fingerprints(docs, id_col, text_col))
    return named(prints, written(classes(prints).drop("root"))).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one of the smallest doc_id, and of rows with that id one at most.

    Fingerprints and ids are judged beside the texts, combined by fingerprint before anything is joined. The texts are
    then shuffled once against the rows that go; by a hint at every size, since what goes grows with the corpus.
    """
    columns = [c for c in docs.columns if c in ("doc_id", "text", "lang", "source", "n_chars")]
    keyed = docs.select(*columns).withColumn("digest", F.xxhash64(*[F.col(c) for c in columns if c != "doc_id"]))
    rows = keyed.select("doc_id", "digest", "text")
    judge = functools.partial(_keyed_fingerprints, schema=pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("fp", pa.int64())]))
    prints = written(map_batches(rows, judge, "doc_id long, digest long, fp long"))
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("doc_id"), F.col("digest").alias("digest"))
    first = prints.groupBy("fp").agg(F.min(order).alias("w"))
    # grouped by root, as component_id is null where no row has an id
    stay = first.join(classes(prints.select("doc_id", "fp")).drop("n"), "fp").groupBy("root").agg(F.min("w").alias("w")).select(F.col("w.doc_id").alias("doc_id"), F.col("w.digest").alias("digest")).distinct()
    counts = prints.groupBy("doc_id", "digest").agg(F.count("*").alias("n"))
    go = written(counts.join(stay.withColumn("stays", F.lit(True)), counts["doc_id"].eqNullSafe(stay["doc_id"]) & (counts["digest"] == stay["digest"]), "left").where("stays is null or n > 1").select(counts["doc_id"], counts["digest"], F.col("stays").isNotNull().alias("repeated")))
    lost = go.where("not repeated")
    kept = keyed.join(lost.hint("merge"), keyed["doc_id"].eqNullSafe(lost["doc_id"]) & (keyed["digest"] == lost["digest"]), "left_anti")
    if not go.where("repeated").isEmpty():
        kept = kept.dropDuplicates(["doc_id", "digest"])
    return kept.select(*columns)


def _keyed_fingerprints(batches, schema: pa.Schema):
    for batch in batches:
        texts = [x or b"" for x in batch.column(2).cast(pa.binary()).to_pylist()]
        memo = {t: fingerprint(t) for t in set(texts)}
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array([memo[t] for t in texts], pa.int64())], schema=schema)
