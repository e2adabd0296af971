"""Loose values: how untyped fields compare, count as numbers, and count as empty.

Fields come as strings (the JSON text of a scalar without its quotes) or as typed columns. Comparisons never give null:
a missing value is unequal to everything, and what is not a number makes every range comparison false.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_text(c: Column) -> Column:
    """The text of a value; whole numbers have no fraction."""
    return F.regexp_replace(c.cast("string"), r"^(-?[0-9]+)\.0$", "$1")


def as_number(c: Column) -> Column:
    """null if the value is missing or not a number; empty text is 0, true and false are 1 and 0."""
    text = F.trim(c.cast("string"))
    number = F.when(text == "", 0.0).when(F.lower(text) == "true", 1.0).when(F.lower(text) == "false", 0.0).otherwise(text.try_cast("double"))
    return F.when(~F.isnan(number), number)


def leading_number(c: Column) -> Column:
    """The number that a text starts with, else null."""
    return F.regexp_extract(c.cast("string"), r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1).try_cast("double")


def is_empty(c: Column) -> Column:
    return c.isNull() | (c.cast("string") == "")


def sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def predicate(c: Column, op: str, value=None) -> Column:
    """One of the filter operators on a field. Text is compared without regard to case."""
    low, want = F.lower(as_text(c)), as_text(F.lit(value)) if value is not None else None
    want = F.lower(want) if want is not None else None
    number = as_number(F.lit(value)) if value is not None else None
    table = {
        "equals": lambda: sure(low == want),
        "not_equals": lambda: ~sure(low == want),
        "contains": lambda: sure(low.contains(want)),
        "not_contains": lambda: ~sure(low.contains(want)),
        "starts_with": lambda: sure(low.startswith(want)),
        "ends_with": lambda: sure(low.endswith(want)),
        "like": lambda: sure(as_text(c).ilike(value)),
        "not_like": lambda: ~sure(as_text(c).ilike(value)),
        "is_empty": lambda: is_empty(c),
        "is_not_empty": lambda: ~is_empty(c),
        "gt": lambda: sure(as_number(c) > number),
        "lt": lambda: sure(as_number(c) < number),
        "gte": lambda: sure(as_number(c) >= number),
        "lte": lambda: sure(as_number(c) <= number),
        "in": lambda: sure(low.isin([str(v).lower() for v in value])),
    }
    if op == "in":
        return sure(low.isin([str(v).lower() for v in value]))
    if op not in table:
        raise ValueError(f"no filter operator {op!r}")
    return table[op]()


#: Which operators make sense for a column type; all others take those of text.
OPERATORS = {
    "text": ("equals", "not_equals", "contains", "not_contains", "starts_with", "ends_with", "is_empty", "is_not_empty"),
    "number": ("equals", "not_equals", "gt", "lt", "gte", "lte", "is_empty", "is_not_empty"),
    "date": ("equals", "not_equals", "gt", "lt", "gte", "lte", "is_empty", "is_not_empty"),
    "select": ("equals", "not_equals", "is_empty", "is_not_empty"),
    "boolean": ("equals", "not_equals"),
}


def rules(filters: list[tuple], conjunction: str = "and") -> Column:
    """(column, operator[, value]) rules under one conjunction; none at all is true."""
    if not filters:
        return F.lit(True)
    parts = [predicate(F.col(f[0]) if isinstance(f[0], str) else f[0], *f[1:]) for f in filters]
    return reduce((lambda a, b: a & b) if conjunction == "and" else (lambda a, b: a | b), parts)


def natural_key(c: Column, width: int = 12) -> Column:
    """Orders text as people count: every run of digits is padded, case doesn't matter."""
    padded = F.regexp_replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), r"([0-9]+)", "0" * width + "$1")
    return F.regexp_replace(padded, rf"0*([0-9]{{{width}}})(?![0-9])", "$1")


def timestamp(c: Column) -> Column:
    """ISO text, or epoch seconds (below 10^12) or milliseconds, as a timestamp; else null."""
    number = c.cast("string").try_cast("double")
    millis = F.when(number < 1e12, number * 1000).otherwise(number)
    return F.coalesce(F.timestamp_millis(millis.cast("long")), F.try_to_timestamp(c.cast("string")))


def code_points(c: Column) -> Column:
    """Numbers of a text's characters."""
    return F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.conv(F.hex(F.encode(x, "utf-32")), 16, 10).cast("long"))


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a over code points, as a nonnegative long."""
    step = lambda h, x: (h.bitwiseXOR(x) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.aggregate(code_points(c), F.lit(2166136261).cast("long"), step)


def shard(c: Column, shards: int) -> Column:
    """Which of so many shards a text belongs to: times 33 plus the code point, over 32 bits, from 5381 on."""
    step = lambda h, x: (h * F.lit(33) + x).bitwiseAND(F.lit(0xFFFFFFFF))
    return (F.aggregate(code_points(c), F.lit(5381).cast("long"), step) % shards).cast("int")
