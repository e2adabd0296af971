"""Quality rules: counts of a document's words, and bands of its zstandard ratio.

A ratio is compressed size over size in bytes. Text that repeats itself falls below the band of its length, text
without structure rises above it. Chunks of one fixed size are judged by one band, whatever the document's length, so a
document that is bad in most of its parts is found even where a long whole compresses as usual.

Null and empty texts have no words and fail. Every row is judged alone: repeated rows get equal results, other columns
than the two named are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from quillfold.llm.common import map_batches, raw, table

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_bytes long, ratio double, n_chunks long, n_bad_chunks long"
)


@dataclass(frozen=True)
class Bands:
    """Limits of the ratio. whole: (bytes below which it holds, lowest, highest), in order of length.

    They are those of characters of one byte, set on licences and on messages and help texts of programs in some 30
    languages, not on the tables here: the lowest a sixth or more below the least of such text, where only text that repeats
    itself comes, the highest above all of it. Characters of more bytes bring the lowest down and the highest up.
    """

    level: int = 3
    whole: tuple[tuple[float, float, float], ...] = (
        (64, 0.0, 9.0),
        (128, 0.40, 1.30),
        (256, 0.32, 1.05),
        (512, 0.28, 0.88),
        (1024, 0.26, 0.78),
        (2048, 0.25, 0.68),
        (4096, 0.24, 0.60),
        (8192, 0.24, 0.55),
        (16384, 0.23, 0.52),
        (65536, 0.21, 0.50),
        (float("inf"), 0.19, 0.50),
    )
    chunk_bytes: int = 2048
    chunk: tuple[float, float] = (0.25, 0.62)

    def scales(self, text: bytes) -> tuple[float, float]:
        """What the lowest and the highest are multiplied by, from the bytes a character has."""
        wide = len(text) / max(len(text.decode("utf-8", "replace")), 1)
        return 2 / (1 + wide), 1 + 0.18 * min(wide - 1, 1.0)

    bad_share: float = 0.5


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of so many words that the text holds twice or more."""
    n = len(words)
    if n <= window:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    code, cards = ids[: n - window + 1], len(seen)
    for k in range(1, window):
        if cards * len(seen) >= 1 << 62:
            values, code = np.unique(code, return_inverse=True)
            cards = len(values)
        code = code * len(seen) + ids[k : n - window + 1 + k]
        cards *= len(seen)
    _, inverse, counts = np.unique(code, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] > 1)
    if not len(starts):
        return 0
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def dup_lines(text: bytes) -> int:
    seen, n = set(), 0
    for line in text.split(b"\n"):
        if line.split():
            if line in seen:
                n += 1
            else:
                seen.add(line)
    return n


def measure(text: bytes, bands: Bands, press: zstandard.ZstdCompressor) -> tuple:
    words = text.split()  # of bytes: exactly the white space of ASCII
    n, size = len(words), len(text)
    repeats = repeat_words(words)
    failed = n < 10 or 100 * repeats > 20 * n
    ratio = len(press.compress(text)) / size if size else 0.0
    down, up = bands.scales(text)
    low, high = next((lo * down, hi * up) for most, lo, hi in bands.whole if size < most)
    parts = range(0, size - bands.chunk_bytes + 1, bands.chunk_bytes)
    bad = sum(not bands.chunk[0] * down <= len(press.compress(text[i : i + bands.chunk_bytes])) / bands.chunk_bytes <= bands.chunk[1] * up for i in parts)
    kept = not failed and low <= ratio <= high and bad <= bands.bad_share * len(parts)
    return (
        n,
        len(b"".join(words).decode("utf-8", "replace")),
        size - len(text.translate(None, SYMBOLS)),
        dup_lines(text),
        repeats,
        failed,
        kept,
        size,
        ratio,
        len(parts),
        bad,
    )


def _judge(batches, bands: Bands, schema: pa.Schema):
    press = zstandard.ZstdCompressor(level=bands.level)
    for batch in batches:
        rows = [measure(x, bands, press) for x in raw(batch.column(1))]
        columns = list(zip(*rows, strict=True)) or [[] for _ in schema.names[1:]]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(x, schema.field(i + 1).type) for i, x in enumerate(columns))], schema=schema)


_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("word_chars", pa.int64()),
        ("n_symbols", pa.int64()),
        ("n_dup_lines", pa.int64()),
        ("n_repeat_words", pa.int64()),
        ("base_failed", pa.bool_()),
        ("kept", pa.bool_()),
        ("n_bytes", pa.int64()),
        ("ratio", pa.float64()),
        ("n_chunks", pa.int64()),
        ("n_bad_chunks", pa.int64()),
    ]
)


def compression_bands(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: Bands = Bands()) -> DataFrame:
    """One row of counts and verdicts for each row of docs."""
    return map_batches(docs.select(id_col, text_col), functools.partial(_judge, bands=bands, schema=_ARROW), SCHEMA)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_bands(table(spark, sf_dir, "documents"))


_KEPT = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep, judged in one pass beside their columns."""
    bands, columns = Bands(), [c for c in docs.columns if c in _KEPT]
    at = columns.index("text")

    def keep(batches):
        press = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            yield batch.filter(pa.array([measure(x, bands, press)[6] for x in raw(batch.column(at))], pa.bool_()))

    docs = docs.select(*columns)
    return map_batches(docs, keep, docs.schema)
