"""Merging targets, forking and healing a log, and scanning it for what must hold.

state: (target, value MAP<STRING,STRING>); log: (seq, op, target, operand MAP<STRING,STRING>, agent, ts);
merges: (a, b, into, seq); edges: (source, dest).
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillfold.functions import paths
from quillfold.operators.fold import aliases, resolve

VALUE = "map<string,string>"

#: Notes that a task of `violations` takes on average, up to PARTS tasks.
NOTES, PARTS = 1 << 20, 20_000

#: What `violations` notes of a target, a bit each.
THERE, MADE, SOURCE, DEST, ONE_WAY, ONE_WAY_BACK, NEEDS = (1 << i for i in range(7))


def _one(key: str, value: Column) -> Column:
    return F.create_map(F.lit(key), value)


def merged(state: DataFrame, merges: DataFrame) -> DataFrame:
    """The state after merges of two targets each: `into` holds a's fields and b's, b's where both have one; a and b are
    aliases of it, unless one of them survives as `into`. Merges of a target that isn't there do nothing."""
    side = lambda n: state.select(F.col("target").alias(n), F.col("value").alias(f"value_{n}"))
    pairs = merges.join(side("a"), "a").join(side("b"), "b")
    both = F.map_concat(F.map_filter("value_a", lambda k, _: ~F.map_contains_key("value_b", k)), "value_b")
    new = F.array(*(F.struct(t.alias("target"), v.cast(VALUE).alias("value"), F.lit(r).alias("_rank")) for t, v, r in ((F.col("into"), both, 1), (F.col("a"), _one("_alias", F.col("into")), 0), (F.col("b"), _one("_alias", F.col("into")), 0))))
    rows = pairs.select("seq", F.explode(new).alias("x")).select("seq", "x.*")
    # of several merges the last one counts; a survivor is no alias of itself
    last = rows.groupBy("target").agg(F.max_by("value", F.struct("seq", "_rank")).alias("value"))
    return state.join(last.select("target"), "target", "left_anti").select("target", "value").unionByName(last)


def rewired(edges: DataFrame, merges: DataFrame) -> DataFrame:
    """Edges of merged targets lead from and to what they became; an edge within one of them is gone, equal ones are one."""
    became = aliases(merges.select(F.explode(F.array("a", "b")).alias("target"), "into", "seq"))
    return resolve(resolve(edges, became, "source"), became, "dest").where("source <> dest").distinct()


def bounded(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """pairs (a, b) with `bounded`: whether a common prefix of theirs is one of the segments (target)."""
    up = lambda c: F.array_append(paths.ancestors(F.col(c)), F.col(c))
    shared = pairs.select("a", "b", F.explode_outer(F.array_intersect(up("a"), up("b"))).alias("target"))
    known = segments.select("target").distinct().withColumn("_is", F.lit(True))
    return shared.join(known, "target", "left").groupBy("a", "b").agg(F.coalesce(F.max("_is"), F.lit(False)).alias("bounded"))


def guarded(log: DataFrame, creators: DataFrame, power: DataFrame, low: int = 10, high: int = 24) -> tuple[DataFrame, DataFrame]:
    """Events that may be folded, and those that may not: agents whose power lies in low..high define only what they made.

    creators: (target, created_by); power: (agent, level). An unknown target is nobody's, an unknown agent may do all.
    """
    rows = log.join(creators.select("target", F.col("created_by").alias("_by")), "target", "left").join(power.select("agent", F.col("level").alias("_level")), "agent", "left")
    denied = F.coalesce((F.col("op") == "DEF") & F.col("_level").between(low, high) & F.col("_by").isNotNull() & (F.col("_by") != F.col("agent")), F.lit(False))
    return rows.where(~denied).select(*log.columns), rows.where(denied).select(*log.columns)


def promoted(log: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(target, seq): the INS events a log lacks: of targets that are written, or linked to, before they are created.

    edges: (dest, seq). The seq is that of the event that needs it; it goes before that.
    """
    needs = log.where(~F.col("op").isin("NUL", "SIG", "REC", "INS")).select("target", "seq")
    if edges is not None:
        needs = needs.unionByName(edges.select(F.col("dest").alias("target"), "seq"))
    made = log.where("op = 'INS'").groupBy("target").agg(F.min("seq").alias("_made"))
    first = needs.groupBy("target").agg(F.min("seq").alias("seq"))
    return first.join(made, "target", "left").where(F.col("_made").isNull() | (F.col("_made") > F.col("seq"))).select("target", "seq")


def forked(log: DataFrame, parent: str, branch: str, agent: str, ts) -> tuple[DataFrame, DataFrame]:
    """A branch off another: the two events that the parent's log gets (SEG, and the NUL that witnesses it), and the
    branch's row, (id, parent, fork_seq): it sees its parent up to that NUL. Only the last seq comes to the driver."""
    spark, last = log.sparkSession, log.agg(F.max("seq")).first()[0] or 0
    rows = [(last + 1, "SEG", branch, agent), (last + 2, "NUL", branch, agent)]
    events = spark.createDataFrame(rows, "seq long, op string, target string, agent string")
    events = events.select("seq", "op", "target", _one("parent", F.lit(parent)).cast(VALUE).alias("operand"), "agent", F.lit(ts).alias("ts"))
    return events, spark.createDataFrame([(branch, parent, last + 2)], "id string, parent string, fork_seq long")


def existence(policy: str, value: Column) -> Column:
    """What a target is that one side made and the other has not: `dissecting` takes the value, `clearing` none, all
    others keep both as a conflict (whose text begins with `conflict:`)."""
    return {"dissecting": value, "clearing": F.lit(None).cast("string")}.get(policy, F.concat(F.lit("conflict:"), F.coalesce(value, F.lit(""))))


def conflicts(before: DataFrame, after: DataFrame, remote: DataFrame) -> DataFrame:
    """(target, op, field, ours, theirs): DEF events to add after a partition's remote events were replayed, for each
    field that stood before and now has another value. before, after: (target, field, value); remote: (target)."""
    touched = after.join(remote.select("target").distinct(), "target", "left_semi").select("target", "field", F.col("value").alias("theirs"))
    ours = before.select("target", "field", F.col("value").alias("ours"))
    changed = ours.join(touched, ["target", "field"]).where(~F.col("ours").eqNullSafe(F.col("theirs")))
    return changed.select("target", F.lit("DEF").alias("op"), F.concat(F.lit("_conflict."), "field").alias("field"), "ours", "theirs")


def retried(failed: DataFrame, log: DataFrame) -> DataFrame:
    """Of failed events (log's columns and error) those that can be folded now: their target exists by now."""
    made = log.where("op = 'INS'").select("target").distinct()
    return failed.where("error = 'no such target'").drop("error").join(made, "target", "left_semi").select(*[c for c in failed.columns if c != "error"])


def _dealt(rows: DataFrame, notes: int, *by: str) -> DataFrame:
    """rows, each of so many notes, in tasks of NOTES on average, however they are stored. They are read twice: first
    they are counted."""
    return rows.repartition(min(PARTS, max(1, ceil(rows.count() * notes / NOTES))), *by)


def violations(log: DataFrame, state: DataFrame, edges: DataFrame, back: DataFrame, needs: DataFrame | None = None) -> DataFrame:
    """(target, type): what must hold and doesn't, each once.

    missing_ins: a state without INS; asymmetric_con, asymmetric_con_rev: an edge without its entry in the other
    direction (back: (source, dest) as its own table has it); orphan_con_source, orphan_con_dest: ends without state;
    stale_def: a state whose last event isn't the log's last DEF (state: last_op, last_seq); missing_eva_dep: needs
    (target, dep) of a dep without state. A null equals nothing.

    Edges meet their entries in one aggregate, and all that is noted of a target in another. Rows are dealt out by their
    number first, edges by both ends and events by target and seq, and a task combines what it has of a target: one that
    is written or linked very often is no hot task, and no task holds more for larger tables.
    """
    ends, none = ["source", "dest"], F.lit(None)
    note = lambda target, bits, last=none, seq=none: F.struct(F.col(target).alias("target"), bits.alias("_bits"), last.alias("_last"), seq.alias("_seq"))
    flag = lambda condition, bit: F.when(condition, bit).otherwise(0)
    sides = edges.select(*ends, F.lit(1).alias("_in")).unionByName(back.select(*ends, F.lit(2).alias("_in")))
    sides = _dealt(sides, 2, *ends).groupBy(*ends).agg(F.bit_or("_in").alias("_in"))
    forth, both = F.col("_in") != 2, (F.col("_in") == 3) & F.col("source").isNotNull() & F.col("dest").isNotNull()
    source = note("source", flag(forth, SOURCE) + flag(forth & ~both, ONE_WAY))
    dest = note("dest", flag(forth, DEST) + flag((F.col("_in") != 1) & ~both, ONE_WAY_BACK))
    of_ends = sides.select(F.explode(F.array(source, dest)).alias("n")).where("n._bits > 0")
    of_state = state.select(note("target", F.lit(THERE), F.when(F.col("last_op") == "DEF", F.col("last_seq"))).alias("n"))
    of_log = log.where("op in ('INS', 'DEF')").select(note("target", flag(F.col("op") == "INS", MADE), none, F.when(F.col("op") == "DEF", F.col("seq"))).alias("n"))
    rows = _dealt(of_state.select("n.*").unionByName(of_log.select("n.*")), 1, "target", "_seq").unionByName(of_ends.select("n.*"))
    if needs is not None:
        lacking = needs.join(state.select(F.col("target").alias("dep")), "dep", "left_anti")
        rows = rows.unionByName(lacking.select(note("target", F.lit(NEEDS)).alias("n")).select("n.*"))
    noted = rows.groupBy("target").agg(F.bit_or("_bits").alias("_bits"), F.min("_last").alias("_least"), F.max("_last").alias("_most"), F.max("_seq").alias("_seq"))
    has = lambda bit: F.col("_bits").bitwiseAND(F.lit(bit)) != 0
    named = F.col("target").isNotNull()
    kinds = {
        "missing_ins": has(THERE) & ~(has(MADE) & named),
        "asymmetric_con": has(ONE_WAY),
        "asymmetric_con_rev": has(ONE_WAY_BACK),
        "orphan_con_source": has(SOURCE) & ~(has(THERE) & named),
        "orphan_con_dest": has(DEST) & ~(has(THERE) & named),
        "stale_def": named & ((F.col("_least") != F.col("_seq")) | (F.col("_most") != F.col("_seq"))),
        "missing_eva_dep": has(NEEDS),
    }
    return noted.select("target", F.explode(F.array_compact(F.array(*(F.when(found, kind) for kind, found in kinds.items())))).alias("type"))


def settled_means(cycling: DataFrame) -> DataFrame:
    """(target, value): what to set a target to that swings between states: their mean, if all of them are numbers.
    cycling: (target, value STRING), a row for each state of the cycle."""
    number = F.col("value").try_cast("double")
    means = cycling.groupBy("target").agg(F.count("*").alias("_n"), F.count(number).alias("_numbers"), F.avg(number).alias("value"))
    return means.where("_n >= 2 and _n = _numbers").select("target", "value")


def reviewed(compared: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates (a, b, decision) with pending ones decided, and the merges that approval makes: (a, b, into).

    decisions: (a, b, approve). What is pending and undecided stays pending; others aren't decided again.
    """
    d = decisions.groupBy("a", "b").agg(F.max("approve").alias("_approve"))
    rows = compared.join(d, ["a", "b"], "left")
    new = F.when((F.col("decision") == "pending") & F.col("_approve").isNotNull(), F.when(F.col("_approve"), "approved").otherwise("rejected")).otherwise(F.col("decision"))
    rows = rows.withColumn("decision", new)
    return rows.drop("_approve"), rows.where("decision = 'approved'").select("a", "b", F.col("a").alias("into"))


def at_least_rec(log: DataFrame, state: DataFrame, least: int) -> DataFrame:
    """Targets of a state with so many REC events at or below them, counted once for each of an event's ancestors."""
    up = log.where("op = 'REC'").select(F.explode(F.array_append(paths.ancestors(F.col("target")), F.col("target"))).alias("target"))
    return state.join(up.groupBy("target").agg(F.count("*").alias("recs")).where(F.col("recs") >= least), "target").select("target", "recs")


__all__ = ["merged", "rewired", "bounded", "guarded", "promoted", "forked", "existence", "conflicts", "retried", "violations", "settled_means", "reviewed", "at_least_rec"]
