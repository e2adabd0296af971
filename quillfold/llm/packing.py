"""Packing of tokenised documents into sequences by minimum bin slack.

A document is its token ids and one end id. Only a document that is longer than a sequence is cut: its last pieces are
full, its first one takes what is left. How pieces are combined is planned from the number of pieces of each length
alone, a table of `capacity` rows at most: per bin, the longest piece left is joined by the lengths whose subset sum,
found by dynamic programming over a bitset, leaves the least slack; the combination is used as often as the pieces left
allow, and removed. Pieces are then numbered within their length (by partition, without gathering a length anywhere)
and look up their place in the plan.

Null texts are empty and become one token, the end. A special token that a text spells is that token, as the vocabulary's
own tokenizer has it. Repeated rows are packed each; rows without id are packed too. Further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillfold.llm.common import map_batches, table, written

CAPACITY, END_ID = 2048, 0
TOKENIZER = "byte_bpe_50k.json"

#: How the byte-level vocabulary splits text before it merges bytes; fixed by the vocabulary's kind.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as SPLIT's engine knows it. Runs from LONG_RUN on are encoded as the pieces they are: its pattern looks ahead
#: from every place of a run, which for very long ones takes more stack than there is.
LONG_RUN = 1_000
_LONG_SPACE = re.compile("[\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)


class Encoder:
    """Ids of whole texts by the vocabulary of a byte-level tokenizers file, by default the public one.

    tiktoken merges with that file's vocabulary: the ids that the file's own tokenizer gives, special tokens that a text
    spells included (the tests compare them over all code points), in a quarter of the time.
    """

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path(TOKENIZER), encoding="utf-8") as f:
            read = json.load(f)
        vocabulary, self.special = read["model"]["vocab"], {x["content"]: x["id"] for x in read.get("added_tokens", [])}
        # the file writes bytes that aren't printable as the code points from 256 on
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
        ranks = {bytes(map(byte.__getitem__, w)): i for w, i in vocabulary.items() if w not in self.special}
        self.encoding = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=self.special)
        self.piece = tiktoken.Encoding("piece", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        return [np.array(self.ids(t), "<u4").tobytes() for t in texts]

    def ids(self, text: str) -> list[int]:
        runs = [m.span() for m in _LONG_SPACE.finditer(text)] if len(text) >= LONG_RUN else []
        out, at = [], 0
        for a, b in runs:
            # the last character of a run belongs to the word behind it
            b -= b < len(text) and not text.startswith(tuple(self.special), b)
            out += self.encoding.encode(text[at:a], allowed_special="all") + self.piece.encode_ordinary(text[a:b])
            at = b
        return out + self.encoding.encode(text[at:], allowed_special="all")


@functools.cache
def encoder(path: str | None) -> Encoder:
    """One for all tasks of a Python worker."""
    return Encoder(path)


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, length, capacity))]


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
_PIECES_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())])


def _tokenise(batches, path: str | None, capacity: int):
    encode, part, nth = encoder(path), TaskContext.get().partitionId(), Counter()
    end = np.array([END_ID], "<u4").tobytes()
    for batch in batches:
        out = []
        for doc_id, ids in zip(batch.column(0).to_pylist(), encode([x or "" for x in batch.column(1).to_pylist()]), strict=True):
            ids += end
            for i, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                out.append((doc_id, i, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), part, nth[length]))
                nth[length] += 1
        columns = list(zip(*out, strict=True)) or [[]] * len(_PIECES_ARROW)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECES_ARROW, strict=True)], schema=_PIECES_ARROW)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document; nth numbers the pieces of a length within their partition, part."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(rows, functools.partial(_tokenise, path=path, capacity=capacity), _PIECES)


def fullest(room: int, counts: dict[int, int]) -> dict[int, int]:
    """Lengths, with how many of each, of the subset whose sum comes closest to room from below."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    full = 1 << room
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left and not reach & full:
            n = min(k, left)
            steps.append((reach, length, n))
            reach |= (reach << (length * n)) & mask
            left, k = left - n, k * 2
        if reach & full:
            break
    total, out = reach.bit_length() - 1, Counter()
    for before, length, n in reversed(steps):
        if not before >> total & 1:
            out[length] += n
            total -= length * n
    return dict(out)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Combinations of lengths and how many bins take each."""
    left, out = {k: n for k, n in counts.items() if n}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        combination = Counter(fullest(capacity - longest, {k: n for k, n in left.items() if n}))
        left[longest] += 1
        combination[longest] += 1
        times = min(left[k] // n for k, n in combination.items())
        for k, n in combination.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        out.append((dict(combination), times))
    return out


class Places:
    """Where the pieces of a length go, in order of their number: (first number, first bin, pieces in a bin, offset)."""

    def __init__(self, planned: list[tuple[dict[int, int], int]]):
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        used, bins = Counter(), 0
        for combination, times in planned:
            offset = 0
            for length, n in sorted(combination.items(), reverse=True):
                rows.setdefault(length, []).append((used[length], bins, n, offset))
                used[length] += n * times
                offset += length * n
            bins += times
        self.rows = {k: np.array(v, np.int64) for k, v in rows.items()}
        self.bins = bins

    def __call__(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for x in np.unique(length):
            mine = np.flatnonzero(length == x)
            rows = self.rows[int(x)]
            first, bin_, n, start = rows[np.searchsorted(rows[:, 0], number[mine], side="right") - 1].T
            within = number[mine] - first
            sequence[mine], offset[mine] = bin_ + within // n, start + within % n * x
        return sequence, offset


_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _place(batches, places):
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    for batch in batches:
        of = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        sequence, offset = places.value(of["length"].to_numpy(), of["number"].to_numpy())
        yield pa.RecordBatch.from_arrays([*(of[n] for n in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with the sequence it is in and its offset there."""
    cut_up = written(pieces(docs, id_col, text_col, path, capacity))
    by_part = cut_up.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = by_part.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    lengths = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    places = docs.sparkSession.sparkContext.broadcast(Places(plan(lengths, capacity)))
    numbered = cut_up.join(before, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("number"))
    return map_batches(numbered, functools.partial(_place, places=places), _PACKED)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)
