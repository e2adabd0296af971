"""Texts as paragraphs, sentences and clauses with their places."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARAGRAPH, SENTENCE, CLAUSE, LONGEST = 20, 8, 12, 600
#: Texts that a worker reads at a time, spans that it hands over at a time.
TEXTS, SPANS = 64, 2048

_SENTENCE = re.compile(r"[^.!?\n]+(?:[.!?]+|\n|$)")
_CLAUSE = re.compile(r"[^,;:.!?\n]+[,;:.!?]*")


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = PARAGRAPH) -> DataFrame:
    """(doc_id, n, text): lines with text, of at least so many characters, numbered among all lines."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, r"\n+")).alias("n", "text"))
    return lines.withColumn("text", F.trim("text")).where(F.length("text") >= least)


def script(text: Column) -> Column:
    """The script that the first 400 characters are written in."""
    head = F.substring(text, 1, 400)
    return F.when(head.rlike(r"[぀-ヿ一-鿿가-힯]"), "cjk").when(head.rlike(r"[؀-ۿ]"), "arabic").when(head.rlike(r"[ऀ-ॿ]"), "devanagari").when(head.rlike(r"[Ѐ-ӿ]"), "cyrillic").otherwise("latin")


def _spans(text: str, pattern: re.Pattern, least: int) -> Iterator[tuple[int, int]]:
    for m in pattern.finditer(text):
        piece = m[0]
        a = m.start() + len(piece) - len(piece.lstrip())
        b = m.start() + len(piece.rstrip())
        while b - a > LONGEST:  # too long: cut at the last space that fits
            cut = text.rfind(" ", a + 1, a + LONGEST)
            cut = cut if cut > a else a + LONGEST
            yield a, cut
            a = cut + (text[cut : cut + 1] == " ")
        if b - a >= least:
            yield a, b


def spans(docs: DataFrame, tier: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, start, end, text) of every sentence or clause; places are code points."""
    pattern, least = (_SENTENCE, SENTENCE) if tier == "sentence" else (_CLAUSE, CLAUSE)

    def cut(batches):
        for few in (b.slice(i, TEXTS) for b in batches for i in range(0, b.num_rows, TEXTS)):
            rows = ((i, n, a, b, t[a:b]) for i, t in zip(*(c.to_pylist() for c in few.columns), strict=True) if t for n, (a, b) in enumerate(_spans(t, pattern, least)))
            while some := list(islice(rows, SPANS)):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["doc_id", "n", "start", "end", "text"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, "doc_id long, n int, start long, end long, text string")


def parents(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Each inner span with the outer span that holds its start: the last outer one that began before it, found in one
    pass over both in order. Outer spans don't overlap."""
    rest = [c for c in inner.columns if c not in ("doc_id", "start")]
    empty = F.lit(None).cast(inner.select(F.struct(*rest)).schema[0].dataType)
    o = outer.select("doc_id", "start", F.lit(0).alias("_side"), F.struct(F.col("n").alias("parent"), F.col("end").alias("to")).alias("_o"), empty.alias("_i"))
    i = inner.select("doc_id", "start", F.lit(1).alias("_side"), F.lit(None).cast(o.schema["_o"].dataType).alias("_o"), F.struct(*rest).alias("_i"))
    w = Window.partitionBy("doc_id").orderBy("start", "_side").rowsBetween(Window.unboundedPreceding, 0)
    rows = o.unionByName(i).withColumn("_o", F.last("_o", ignorenulls=True).over(w)).where((F.col("_side") == 1) & (F.col("start") < F.col("_o.to")))
    return rows.select(*(F.col(c) if c in ("doc_id", "start") else F.col(f"_i.{c}") for c in inner.columns), "_o.parent")
