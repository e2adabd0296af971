"""Dotted target paths such as `app.orders.rec7.status`."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def depth(target: Column) -> Column:
    return F.size(F.split(target, r"\."))


def parent(target: Column) -> Column:
    """null for a root."""
    return F.when(target.contains("."), F.regexp_replace(target, r"\.[^.]*$", ""))


def leaf(target: Column) -> Column:
    return F.element_at(F.split(target, r"\."), -1)


def ancestors(target: Column) -> Column:
    """Proper prefixes, from the root down."""
    parts = F.split(target, r"\.")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "."))).otherwise(F.array().cast("array<string>"))


def under(target: Column, path: str, itself: bool = False) -> Column:
    """Descendants of path, by whole segments."""
    below = target.startswith(path + ".")
    return below | (target == path) if itself else below


def children(target: Column, path: str) -> Column:
    return under(target, path) & (depth(target) == len(path.split(".")) + 1)


def glob(target: Column, pattern: str) -> Column:
    """`*` is one segment, `**` any number of them, none included."""
    out, parts = "", pattern.split(".")
    for i, p in enumerate(parts):
        if p == "**":
            out += r"(?:[^.]+\.)*" if i < len(parts) - 1 else (r"(?:\.[^.]+)*" if i else r"[^.]+(?:\.[^.]+)*")
            continue
        out += "[^.]+" if p == "*" else re.escape(p)
        if i < len(parts) - 1 and not (parts[i + 1] == "**" and i + 1 == len(parts) - 1):
            out += r"\."
    return target.rlike(f"^{out}$")
