"""Document fingerprints: scaled sketches that keep every shingle hash below a fixed share of the hash range.

The share is the same for every text, so the sketch of a union is the union of sketches, and the containment of a short
document in a long one is estimated without the bias of fixed-size sketches. Words are lower-cased (A-Z), shingles have
five of them; a shorter text is one shingle. The smallest hash of a text is kept too, so only a text without words has
an empty sketch.

Likeness is the larger of the two containments: shared hashes over the hashes of the smaller sketch. Two empty sketches
are alike (1), an empty one and another are not (0). Null texts are empty. The next document is the one of the next
smaller doc_id (rows of equal doc_id follow each other in order of a hash of their text, rows without doc_id come last, in
that order too); after the last comes the first, which for a single row is the row itself. Further columns are ignored, an
empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfold.llm.common import map_batches, table

SHINGLE = 5
SHARE = 1 / 4
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
MAX_CACHE = 300_000


class Sketcher:
    """Sketches as sorted arrays of unsigned 32-bit hashes. A shingle's hash mixes the hashes of its words in order."""

    def __init__(self, share: float = SHARE, shingle: int = SHINGLE):
        self.limit, self.shingle, self.cache = np.uint32(int(share * 2**32) - 1), shingle, {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        cache = self.cache
        if len(cache) > MAX_CACHE:
            cache.clear()
        out = np.empty(len(words), np.uint64)
        for i, w in enumerate(words):
            h = cache.get(w)
            if h is None:
                h = cache[w] = xxhash.xxh64_intdigest(w)
            out[i] = h
        return out

    def __call__(self, text: bytes) -> np.ndarray:
        words = self.hashes(text.lower().split())
        n = len(words)
        if not n:
            return np.zeros(0, np.uint32)
        size = min(self.shingle, n)
        h = np.full(n - size + 1, size, np.uint64)
        for k in range(size):
            h = (h ^ words[k : n - size + 1 + k]) * _MIX[0]
            h ^= h >> np.uint64(29)
        h = (h ^ (h >> np.uint64(30))) * _MIX[1]
        h = (h ^ (h >> np.uint64(27))) * _MIX[2]
        h = ((h ^ (h >> np.uint64(31))) >> np.uint64(32)).astype(np.uint32)
        kept = np.unique(h[h <= self.limit])
        return kept if len(kept) else h.min(keepdims=True)


def shared(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return shared(a, b) / min(len(a), len(b))


def encode(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def decode(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def merge(*fingerprints: str) -> str:
    """The fingerprint of texts together, from theirs (as long as no shingle crosses from one to the next)."""
    return encode(np.unique(np.concatenate([np.zeros(0, np.uint32), *map(decode, fingerprints)])))


def edited(text: str, other: str) -> str:
    """text with its last half replaced by as much of the start of other, or all of that."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def _fingerprints(batches):
    sketch = Sketcher()
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encode(sketch((x or "").encode())) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "fingerprint"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint of every row."""
    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col), _fingerprints, "doc_id long, fingerprint string")


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of (part, doc_id, text, ahead), sorted so that each row's next document follows it in its partition.

    Parts are ranges of doc_id, and behind them, for rows without one, ranges of the text's hash. The first row of a part
    is copied behind the end of the part before it (ahead is true), so the text is shuffled once and no window spans the
    whole table. Only the parts' bounds come to the driver.
    """
    spark = docs.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    text = F.coalesce(F.col(text_col), F.lit(""))
    place = F.bitwise_not(F.col(id_col).cast("long"))  # falls as the id rises, for every long
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), place.alias("place"), F.xxhash64(text).alias("hash"))
    bounds = rows.agg(F.percentile_approx("place", [i / parts for i in range(1, parts)], 100 * parts).alias("b")).first()["b"] or []
    bounds, step = np.array(sorted(set(bounds)), np.int64), (1 << 63) // parts * 2

    @F.pandas_udf("int")
    def part(known: pd.Series, place: pd.Series, hash_: pd.Series) -> pd.Series:
        behind = len(bounds) + 1 + (hash_.to_numpy(np.int64) // step + parts // 2 + 1)
        return pd.Series(np.where(known, np.searchsorted(bounds, place.to_numpy(np.int64)), behind), dtype="int32")

    rows = rows.withColumn("part", part(F.col("place").isNotNull(), F.coalesce("place", F.lit(0)), "hash"))
    heads = rows.groupBy("part").agg(F.min(F.struct("place", "hash")).alias("m")).orderBy("part").collect()
    if not heads:
        return rows.select("part", "doc_id", "text", F.lit(False).alias("ahead"))
    first = spark.createDataFrame([(h["m"]["place"], h["m"]["hash"], heads[i - 1]["part"]) for i, h in enumerate(heads)], "place long, hash long, to int")
    head_rows = rows.join(F.broadcast(first), (rows["hash"] == first["hash"]) & rows["place"].eqNullSafe(first["place"])).select(F.col("to").alias("part"), "doc_id", "text", F.lit(True).alias("ahead"), rows["hash"])
    both = rows.select("part", "doc_id", "text", F.lit(False).alias("ahead"), "hash").unionByName(head_rows.dropDuplicates(["part"]))
    dealt = both.repartitionById(2 * parts + 3, "part") if heads[-1]["part"] > len(bounds) else both.repartitionById(parts, "part")
    return dealt.sortWithinPartitions("part", "ahead", F.col("doc_id").desc_nulls_last(), "hash").select("part", "doc_id", "text", "ahead")


_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
        ("jaccard_edited", pa.float64()),
        ("jaccard_next", pa.float64()),
    ]
)
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, jaccard_edited double, jaccard_next double"


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = shared(a, b)
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _compare(batches, share: float, shingle: int):
    sketch, before = Sketcher(share, shingle), None
    for batch in batches:
        out = []
        for part, doc_id, text, ahead in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            now = (part, doc_id, text, ahead, sketch(text.encode()))
            if before and before[0] == part and not before[3]:
                _, was_id, was, _, one = before
                changed = edited(was, text)
                two = sketch(changed.encode())
                out.append((was_id, len(was), hashlib.sha256(changed.encode()).hexdigest(), encode(one), encode(two), likeness(one, two), likeness(one, now[4]), _jaccard(one, two), _jaccard(one, now[4])))
            before = now
        columns = list(zip(*out, strict=True)) or [[]] * len(_ARROW)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE, shingle: int = SHINGLE) -> DataFrame:
    """Fingerprints of every row and of its edited text, and their likeness to it and to the next document's."""
    return map_batches(in_order(docs, id_col, text_col), functools.partial(_compare, share=share, shingle=shingle), SCHEMA)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "documents"))
