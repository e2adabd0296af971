"""Formulas over a record's fields: Spark SQL expressions of allowed functions, in order of their dependencies.

Formulas that depend on each other in a circle are iterated to a fixed point.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillfold.operators.graph import settled

#: Fixed list: what a formula may call.
ALLOWED = frozenset(
    "abs acos acosh asin asinh atan atan2 atanh cbrt ceil cos cosh exp expm1 floor hypot log log10 log1p log2 greatest least pow round sign signum sin sinh sqrt tan tanh coalesce if nullif now current_date datediff".split()
)
VOLATILE = re.compile(r"\b(?:now|today|current_date|current_timestamp|days_until|days_since)\s*\(|\bcurrent_(?:date|timestamp)\b", re.I)
LONGEST = 2048
_NAME = re.compile(r"\b[A-Za-z_][A-Za-z0-9_]*\b(?!\s*\()")
_CALL = re.compile(r"\b([A-Za-z_][A-Za-z0-9_]*)\s*\(")
_WORDS = frozenset("and or not true false null case when then else end is in between".split())


def is_volatile(formula: str) -> bool:
    """Whether its value depends on the time of reading, so that it must not be stored."""
    return bool(VOLATILE.search(formula))


def names(formula: str) -> set[str]:
    return {n for n in _NAME.findall(re.sub(r"'[^']*'", "", formula)) if n.lower() not in _WORDS}


def column(formula: str, fields: list[str]) -> Column:
    """The formula as a column; fields that the records lack are null. Calls that aren't allowed are refused."""
    if len(formula) > LONGEST:
        raise ValueError("formula too long")
    if bad := {c.lower() for c in _CALL.findall(formula)} - ALLOWED - _WORDS:
        raise ValueError(f"formula calls {sorted(bad)}")
    missing = names(formula) - set(fields) - {"current_date", "current_timestamp"}
    for n in missing:
        formula = re.sub(rf"\b{n}\b(?!\s*\()", "CAST(NULL AS DOUBLE)", formula)
    return F.expr(formula)


def order(formulas: dict[str, str]) -> list[str]:
    """Names in an order in which every formula comes after those it reads; a circle raises CycleError."""
    return list(TopologicalSorter({n: names(f) & set(formulas) - {n} for n, f in formulas.items()}).static_order())


def evaluate(records: DataFrame, formulas: dict[str, str]) -> DataFrame:
    out = records
    for n in order(formulas):
        out = out.withColumn(n, column(formulas[n], out.columns))
    return out


@dataclass
class Settled:
    records: DataFrame
    outcome: str  # converged, oscillation or bail
    rounds: int
    cycle_length: int = 0


def fixed_point(records: DataFrame, formulas: dict[str, str], rounds: int = 100, tolerance: float = 1e-9, memory: int = 16) -> Settled:
    """Evaluates all formulas at once, again and again, until no value moves by more than the tolerance (relative above 1),
    the whole state is one of the last `memory` states again, or the rounds are used up. State is kept by checkpoints."""
    now, seen = settled(records), []
    fields = list(formulas)
    for r in range(1, rounds + 1):
        new = settled(now.withColumns({**{f"_old_{n}": F.col(n) for n in fields}, **{n: column(f, now.columns).cast("double") for n, f in formulas.items()}}))
        moved = [F.abs(F.col(n) - F.col(f"_old_{n}")) > tolerance * F.greatest(F.lit(1.0), F.abs(n), F.abs(f"_old_{n}")) for n in fields]
        stats = new.agg(F.count_if(F.exists(F.array(*(F.coalesce(m, F.lit(False)) for m in moved)), lambda m: m)).alias("moved"), F.sum(F.xxhash64(*(F.round(n, 9) for n in fields)).cast("decimal(38,0)")).alias("digest")).first()
        now = new.drop(*(f"_old_{n}" for n in fields))
        if not stats["moved"]:
            return Settled(now, "converged", r)
        if stats["digest"] in seen:
            return Settled(now, "oscillation", r, len(seen) - seen.index(stats["digest"]))
        seen = [*seen, stats["digest"]][-memory:]
    return Settled(now, "bail", rounds)


__all__ = ["ALLOWED", "CycleError", "Settled", "column", "evaluate", "fixed_point", "is_volatile", "names", "order"]
