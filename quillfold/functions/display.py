"""How names, agents and times are shown, one spelling for equal values, ids derived from others."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillfold.functions.values import code_points


def name(segment: Column) -> Column:
    """A segment as a name: without tbl, rec or fld before it, words apart; the segment if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(segment, "^(tbl|rec|fld)", ""), "([a-z])([A-Z])", "$1 $2")
    return F.when(bare == "", segment).otherwise(bare)


def short_agent(agent: Column) -> Column:
    """The handle of an agent such as `@jo:host`; unknown if there is none."""
    return F.when(agent.isNull() | (agent == ""), "unknown").when(agent.rlike("^@?[^:@]"), F.regexp_extract(agent, "^@?([^:@]+)", 1)).otherwise(agent)


def user_and_device(agent: Column) -> Column:
    """(user_id, device_id) of `user|device`; without either side the whole is the user."""
    at = F.instr(agent, "|")
    both = (at > 1) & (at < F.length(agent))
    none = F.lit(None).cast("string")
    user = F.when(both, F.substring(agent, F.lit(1), at - 1)).when(agent != "", agent).otherwise(none)
    return F.struct(user.alias("user_id"), F.when(both, F.substring(agent, at + 1, F.length(agent))).otherwise(none).alias("device_id"))


def ago(ts: Column, now: Column) -> Column:
    """The time since ts in seconds, minutes, hours or days; from 30 days on, and in future, its day."""
    s = F.unix_seconds(now) - F.unix_seconds(ts)
    units = ((60, 1, "s"), (3600, 60, "m"), (86_400, 3600, "h"), (30 * 86_400, 86_400, "d"))
    out = F.when(s < 0, F.date_format(ts, "MMM d, yyyy"))
    for below, size, unit in units:
        out = out.when(s < below, F.concat(F.floor(s / size).cast("string"), F.lit(f"{unit} ago")))
    return out.otherwise(F.date_format(ts, "MMM d, yyyy"))


#: How a moment is written when the times shown span at most so many seconds.
TIERS = ((60, "HH:mm:ss.SSS"), (3600, "HH:mm:ss"), (86_400, "HH:mm"), (7 * 86_400, "EEE HH:mm"), (90 * 86_400, "MMM d"), (2 * 365 * 86_400, "MMM yyyy"), (20 * 365 * 86_400, "yyyy"))


def adaptive(ts: Column, span_seconds: float) -> Column:
    """A moment in as much detail as a range of so many seconds needs."""
    return F.date_format(ts, next((form for most, form in TIERS if abs(span_seconds) <= most), "yyyy"))


def field(value: Column, key: str, nested: str = "fields") -> Column:
    """A field of a JSON text, from its nested object or else from its top."""
    at = lambda path: F.get_json_object(value, path)
    return F.coalesce(at(f"$.{nested}.{key}"), at(f"$.{key}"))


def canonical(value: Column) -> Column:
    """A map's JSON with its keys in order: equal maps have equal texts, whatever their order. Missing values stay null."""
    quoted = lambda x: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(x, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))
    entry = lambda e: F.concat(quoted(e["key"]), F.lit(":"), F.coalesce(quoted(e["value"]), F.lit("null")))
    return F.when(value.isNull(), "null").otherwise(F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries(value)), entry), ","), F.lit("}")))


def derived_target(constituents: Column) -> Column:
    """The target of an entity that others make up: a 32-bit hash (times 31 plus the code) of their sorted names."""
    step = lambda h, x: (h * F.lit(31) + x).bitwiseAND(F.lit(0xFFFFFFFF))
    h = F.aggregate(code_points(F.array_join(F.array_sort(constituents), "|")), F.lit(0).cast("long"), step)
    return F.concat(F.lit("system.rec."), F.lower(F.lpad(F.hex(h), 8, "0")))


def derived_id(*parts: Column) -> Column:
    """An id that equal parts always give, on whatever replica: 32 hex digits."""
    text = F.concat_ws("\u001f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.substring(F.sha2(text, 256), 1, 32)


def excluded(field_id: Column, field_name: Column, fields: tuple[str, ...] = (), patterns: tuple[str, ...] = ()) -> Column:
    """Whether a policy leaves a field out: its id is listed, or a pattern is found in its id or name. Policies of several
    levels add up: pass all their fields and patterns."""
    hits = [field_id.isin(*fields)] if fields else []
    hits += [F.coalesce(c.rlike(p), F.lit(False)) for p in patterns for c in (field_id, field_name)]
    return reduce(lambda a, b: a | b, hits, F.lit(False))


def triples(text: Column) -> Column:
    """Array of (subject, predicate, object) from marked text: <triplet> subject <subj> object <obj> predicate. What is
    before the first mark, and triples that lack a part, are left out; parts in several pieces are put together."""
    clean = F.regexp_replace(text, "<s>|</s>|<pad>", "")
    pieces = F.slice(F.split(clean, r"(?:^|\s)<triplet>(?=\s|$)"), 2, 1_000_000)
    marked = lambda p: F.regexp_extract_all(F.concat(F.lit("<head> "), p), F.lit(r"(<head>|<subj>|<obj>)((?:(?!<subj>|<obj>)[\s\S])*)"), F.lit(0))
    part = lambda p, mark: F.trim(F.regexp_replace(F.array_join(F.transform(F.filter(marked(p), lambda x: x.startswith(mark)), lambda x: F.substring(x, F.lit(len(mark) + 1), F.length(x))), " "), r"\s+", " "))
    made = F.transform(pieces, lambda p: F.struct(part(p, "<head>").alias("subject"), part(p, "<obj>").alias("predicate"), part(p, "<subj>").alias("object")))
    return F.filter(made, lambda t: (t["subject"] != "") & (t["predicate"] != "") & (t["object"] != ""))
