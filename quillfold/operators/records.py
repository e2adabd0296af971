"""Reading records: filters, projection, order, pages, suggestions, schema discovery, time travel by field.

Records are ordinary DataFrames, or rows of state (target, value MAP<STRING,STRING>) where fields vary.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillfold.functions import paths
from quillfold.functions.values import is_empty, natural_key, predicate, rules, sure
from quillfold.operators.ordered import lagged


def select(records: DataFrame, fields: list[str] | None = None, where: list[tuple] = (), any_of: bool = False, order_by: list[tuple[str, bool]] = (), limit: int | None = None, natural: bool = False) -> DataFrame:
    """Filter, order, limit and project, in this order. order_by: (field, descending); natural orders text by numbers in it."""
    out = records.where(typed_rules(records, list(where), any_of)) if where else records
    key = natural_key if natural else (lambda c: c)
    if order_by:
        out = out.orderBy(*[key(F.col(f)).desc_nulls_last() if down else key(F.col(f)).asc_nulls_first() for f, down in order_by])
    if limit is not None:
        out = out.limit(limit)
    return out.select(*fields) if fields else out


def typed_rules(records: DataFrame, filters: list[tuple], any_of: bool = False) -> Column:
    """The filters under one conjunction. Ranges of a numeric column compare as numbers, which the scan can do."""
    numeric = {f.name for f in records.schema if isinstance(f.dataType, T.NumericType)}
    compare = {"gt": Column.__gt__, "lt": Column.__lt__, "gte": Column.__ge__, "lte": Column.__le__}
    typed = lambda f: isinstance(f[0], str) and f[0] in numeric and f[1] in compare and isinstance(f[2], (int, float))
    # in a disjunction null must be false
    parts = [(lambda c: sure(c) if any_of else c)(compare[f[1]](F.col(f[0]), F.lit(f[2]))) if typed(f) else rules([f]) for f in filters]
    return reduce((lambda a, b: a | b) if any_of else (lambda a, b: a & b), parts)


def page(state: DataFrame, prefix: str, after: str | None = None, limit: int = 100) -> DataFrame:
    """Keyset pages: rows below prefix strictly after a target."""
    rows = state.where(paths.under(F.col("target"), prefix))
    return (rows.where(F.col("target") > after) if after is not None else rows).orderBy("target").limit(limit)


def free_text(records: DataFrame, query: str, columns: list[str] | None = None) -> DataFrame:
    """Rows where any column contains the text, whatever the case."""
    q = query.lower()
    hits = [F.coalesce(F.lower(F.col(c).cast("string")).contains(q), F.lit(False)) for c in columns or records.columns]
    return records.where(F.array_contains(F.array(*hits), True))


def time_range(records: DataFrame, column: str, low=None, high=None, missing: str = "hide") -> DataFrame:
    """Inclusive range. Rows without a time are hidden, shown, or put at the end (`end` adds `_last` for ordering)."""
    t, inside = F.col(column), F.lit(True)
    if low is not None:
        inside &= t >= F.lit(low)
    if high is not None:
        inside &= t <= F.lit(high)
    if missing == "hide":
        return records.where(t.isNotNull() & inside)
    out = records.where(t.isNull() | inside)
    return out.withColumn("_last", t.isNull()) if missing == "end" else out


def hierarchy(state: DataFrame, path: str) -> DataFrame:
    return state.where(paths.children(F.col("target"), path))


def at_depth(state: DataFrame, n: int, path: str | None = None) -> DataFrame:
    rows = state.where(paths.depth(F.col("target")) == n)
    return rows.where(paths.under(F.col("target"), path)) if path else rows


def suggest_targets(state: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Targets that match, best first: the whole target, its start, a segment's start, anywhere."""
    low, q = F.lower("target"), text.lower()
    score = F.when(low == q, 100).when(low.startswith(q), 80).when(F.lower(paths.leaf(F.col("target"))).startswith(q), 60).when(low.contains(q), 40)
    return state.select("target", score.alias("score")).where("score is not null").orderBy(F.desc("score"), F.length("target"), "target").limit(limit)


def field_names(state: DataFrame, column: str = "value") -> DataFrame:
    """Distinct keys of the records, without those that begin with an underscore."""
    return state.select(F.explode(F.map_keys(column)).alias("field")).where(~F.col("field").startswith("_")).distinct().orderBy("field")


def infer_columns(long: DataFrame) -> DataFrame:
    """long: (record, field, value STRING). Type of each field by the values that are there.

    All numbers: number; all booleans: boolean; over half dates, e-mail addresses or URLs: these; at most ten distinct
    values in over twice as many rows: select; else text.
    """
    v = F.col("value")
    there = ~is_empty(v)
    n = F.count_if(there)
    share = lambda pattern: F.count_if(there & v.rlike(pattern)) / n
    stats = long.where(~F.col("field").startswith("_")).groupBy("field").agg(
        n.alias("n"),
        F.count_if(there & v.try_cast("double").isNotNull()).alias("numbers"),
        F.count_if(there & F.lower(v).isin("true", "false")).alias("booleans"),
        share(r"^\d{4}-\d{2}-\d{2}").alias("dates"),
        share(r"^[^\s@]+@[^\s@]+\.[^\s@]+$").alias("emails"),
        share(r"^https?://").alias("urls"),
        F.count_distinct(F.when(there, v)).alias("distinct_values"),
    )
    kind = (
        F.when(F.col("n") == 0, "text")
        .when(F.col("numbers") == F.col("n"), "number")
        .when(F.col("booleans") == F.col("n"), "boolean")
        .when(F.col("dates") > 0.5, "date")
        .when(F.col("emails") > 0.5, "email")
        .when(F.col("urls") > 0.5, "url")
        .when((F.col("distinct_values") <= 10) & (F.col("distinct_values") < 0.5 * F.col("n")), "select")
        .otherwise("text")
    )
    first = F.when(F.lower("field") == "name", 0).when(F.lower("field") == "status", 1).otherwise(2)
    return stats.select("field", kind.alias("type"), "n", "distinct_values").orderBy(first, "field")


def bound(records: DataFrame, filters: list[tuple]) -> DataFrame:
    """Rows that fit all filters of a binding: as rules do, but 0 and false are empty too."""

    def one(f: tuple) -> Column:
        c = F.col(f[0])
        return is_empty(c) | F.lower(c.cast("string")).isin("0", "0.0", "false") if f[1] == "is_empty" else rules([f])

    return records.where(reduce(lambda a, b: a & b, map(one, filters), F.lit(True)))


def bind(state: DataFrame, mode: str, path: str | None = None, depth: int | None = None, kind: str | None = None, edges: DataFrame | None = None) -> DataFrame:
    """The records that a binding shows: `hierarchy` the children of a path, `depth` what lies so deep (below it), `type`
    those of a type, `connection` what a target links to."""
    if mode == "hierarchy":
        return hierarchy(state, path)
    if mode == "depth":
        return at_depth(state, depth, path)
    if mode == "type":
        return state.where(F.col("value")["type"] == kind)
    if mode == "connection":
        ends = edges.where(F.col("source") == path).select(F.col("dest").alias("target")).distinct()
        return state.join(ends, "target", "left_semi")
    raise ValueError(f"no binding mode {mode!r}")


def completions(records: DataFrame, field: str, start: str = "", limit: int = 8) -> DataFrame:
    """What a query may go on with after a field: its first values in order that begin so, whatever the case."""
    v = F.col(field).cast("string")
    return records.where(v.isNotNull() & (v != "") & F.lower(v).startswith(start.lower())).select(v.alias("value")).distinct().orderBy("value").limit(limit)


def schema_rules(state: DataFrame, scope: str) -> DataFrame:
    """(field, n_def, n_eva) of a scope's schema: type and constraints count as definitions, `resolve` as an evaluation.
    state: targets such as scope._schema.field.type."""
    below = state.where(F.col("target").startswith(f"{scope}._schema.")).select(F.split(F.substring("target", len(scope) + 10, 100_000), r"\.").alias("p"))
    part = F.col("p")[1]
    rows = below.where(F.size("p") >= 2).groupBy(F.col("p")[0].alias("field"))
    return rows.agg(F.count_if((part == "type") | (part == "constraint")).alias("n_def"), F.max((part == "resolve").cast("long")).alias("n_eva"))


def redact(records: DataFrame, policy: dict[str, str], mark: str = "REDACTED") -> DataFrame:
    """policy: column -> `redacted` (marked) or `hidden` (dropped)."""
    out = records.withColumns({c: F.when(F.col(c).isNotNull(), F.lit(mark)) for c, p in policy.items() if p == "redacted" and c in records.columns})
    return out.drop(*[c for c, p in policy.items() if p == "hidden"])


def audit_trail(log: DataFrame, value: Column, by: list[str], order: list[str]) -> DataFrame:
    """Changes of a value: rows whose value equals the one before, of the same key, are left out."""
    rows = lagged(log.withColumn("changed_to", value), by, order, ["changed_to"], "_p_").withColumnRenamed("_p_changed_to", "previous")
    return rows.where(F.col("_first") | ~F.col("changed_to").eqNullSafe(F.col("previous"))).drop("_first")


def changed_fields(old: DataFrame, new: DataFrame, key: str = "record") -> DataFrame:
    """old, new: (key, field, value). Fields added, changed or removed; null and missing are equal."""
    o, n = old.withColumnRenamed("value", "old_value"), new.withColumnRenamed("value", "new_value")
    return o.join(n, [key, "field"], "full_outer").where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def named_view(records: DataFrame, view: dict) -> DataFrame:
    """A stored view: filters, sorts and columns."""
    return select(records, view.get("columns"), view.get("filters", ()), view.get("any_of", False), view.get("sorts", ()), view.get("limit"))


__all__ = ["predicate", "select", "page", "free_text", "time_range", "hierarchy", "at_depth", "suggest_targets", "field_names", "infer_columns", "bound", "bind", "completions", "schema_rules", "redact", "audit_trail", "changed_fields", "named_view"]
