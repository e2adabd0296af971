"""Metrics, population statistics, trajectories and rhythms of targets over their events."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillfold.functions.values import as_text, leading_number, predicate
from quillfold.operators.ordered import lagged


def metric(name: str, column: str | None = None, where: tuple | None = None) -> Column:
    """An aggregate of one of the metric cards: count, count_distinct, sum, avg, min, max. Text that doesn't start with
    a number is left out of sums; null values are not counted as distinct ones."""
    keep = predicate(F.col(where[0]), *where[1:]) if where else F.lit(True)
    if name == "count":
        return F.count_if(keep)
    c = F.when(keep, F.col(column))
    if name == "count_distinct":
        return F.count_distinct(as_text(c))
    number = leading_number(c)
    return {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[name](number)


def metric_cards(records: DataFrame, cards: dict[str, tuple]) -> DataFrame:
    """cards: name -> (metric, column, where). One row, in one pass over the records."""
    return records.agg(*(metric(*card).alias(name) for name, card in cards.items()))


def formula_aggregates(values: DataFrame, key: str, column: str) -> DataFrame:
    """SUM, AVG, MIN, MAX and COUNT of single-precision inputs; a missing number is 0, and COUNT counts what isn't 0."""
    x = F.coalesce(F.col(column), F.lit(0)).cast("float").cast("double")
    return values.groupBy(key).agg(F.sum(x).alias("sum"), F.avg(x).alias("avg"), F.min(x).alias("min"), F.max(x).alias("max"), F.count_if(x != 0).alias("count"))


def custom_aggregate(fn: Callable[[pd.Series], float], kind: str = "double"):
    """A function of a Series as an aggregate of a column, beside the built-in ones: `custom_aggregate(f)("x")` in agg.
    A group comes to one task whole, so it is for groups of bounded size."""

    @F.pandas_udf(kind)
    def aggregate(values: pd.Series) -> float:
        return fn(values)

    return aggregate


def z_scores(records: DataFrame, group: str, column: str, limit: float = 1.5, least: int = 3) -> DataFrame:
    """Each record's distance from its group's mean in population deviations; groups of fewer than `least` have none.

    The statistics are aggregated and joined back, so a hot group is no single task's window.
    """
    stats = records.groupBy(group).agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("deviation"), F.count(column).alias("n"))
    rows = records.join(stats, group)
    z = F.when((F.col("n") >= least) & (F.col("deviation") > 0), (F.col(column) - F.col("mean")) / F.col("deviation"))
    return rows.withColumn("z", z).withColumn("outlier", F.coalesce(F.abs(z) > limit, F.lit(False)))


def runs(log: DataFrame, by: str, what: str, order: list[str]) -> DataFrame:
    """Consecutive equal values of `what` as runs: (by, run, what, n, first, last).

    Runs are counted within a range of the order first; what goes on from the range before is number 0 there.
    """
    rows = lagged(log.select(*dict.fromkeys((by, what, *order))), [by], order, [what], "_p_", spans=True)
    new = F.when(~F.col("_first") & F.col(f"_p_{what}").eqNullSafe(F.col(what)), 0).otherwise(1)
    within = F.sum(new).over(Window.partitionBy(by, "_span").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    parts = rows.withColumn("_run", within).groupBy(by, "_span", "_run", what).agg(F.count("*").alias("n"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))
    before = Window.partitionBy(by).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    known = parts.groupBy(by, "_span").agg(F.max("_run").alias("_runs")).select(by, "_span", F.coalesce(F.sum("_runs").over(before), F.lit(0)).alias("_known"))
    numbered = parts.join(known, [by, "_span"]).withColumn("run", F.col("_known") + F.col("_run"))
    return numbered.groupBy(by, "run", what).agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))


def trajectory(log: DataFrame, by: str, what: str, order: list[str]) -> DataFrame:
    """The compressed sequence of runs of each key, its 16-digit fingerprint and the number of runs."""
    r = runs(log, by, what, order).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("run", what))).alias("_r"))
    path = F.array_join(F.transform("_r", lambda x: x[what]), ".")
    return r.select(by, path.alias("path"), F.substring(F.sha2(path, 256), 1, 16).alias("fingerprint"), F.size("_r").cast("long").alias("n_runs"))


def intervals(log: DataFrame, by: str, ts: str, order: list[str]) -> DataFrame:
    """Seconds since the key's event before."""
    rows = lagged(log, [by], order, [ts], "_p_")
    return rows.withColumn("gap", F.unix_seconds(F.col(ts)) - F.unix_seconds(F.col(f"_p_{ts}"))).drop(f"_p_{ts}", "_first")


def most_in_hour(log: DataFrame, by: str, ts: str) -> DataFrame:
    """The most events of each key in any hour that ends with one of them.

    Days are counted apart; an event of the last hour of a day is seen from the next day too, but not counted from there.
    """
    t = F.unix_seconds(F.col(ts))
    rows = log.select(by, t.alias("_t"), F.explode(F.array_distinct(F.array(F.floor(t / 86400), F.floor((t + 3600) / 86400)))).alias("_day"))
    w = Window.partitionBy(by, "_day").orderBy("_t").rangeBetween(-3600, 0)
    counted = rows.withColumn("n", F.count("*").over(w)).where(F.floor(F.col("_t") / 86400) == F.col("_day"))
    return counted.groupBy(by).agg(F.max("n").alias("most_in_hour"))


def cadence(log: DataFrame, by: str, ts: str, order: list[str], now) -> DataFrame:
    """How each key's events are spaced, as of `now`.

    dormant: none for 30 days; burst: more than three within an hour; periodic: over 60 % of the gaps within a fifth of
    their median; sparse: fewer than three events; else steady. The median is the element at half the sorted list.
    """
    spaced = intervals(log, by, ts, order)
    sizes = spaced.groupBy(by).agg(F.count("*").alias("n"), F.count("gap").alias("n_gaps"), F.max(ts).alias("last_ts"))
    counts = spaced.where("gap is not null").groupBy(by, "gap").agg(F.count("*").alias("_k"))  # equal gaps are one row
    ranked = counts.select(by, "gap", "_k", F.sum("_k").over(Window.partitionBy(by).orderBy("gap")).alias("_r"))
    half = sizes.select(by, (F.floor(F.col("n_gaps") / 2) + 1).alias("_half"))
    middle = ranked.join(half, by).where("_half <= _r and _half > _r - _k").select(by, F.col("gap").alias("median"))
    close = spaced.join(middle, by).groupBy(by).agg(F.max("median").alias("median"), F.count_if(F.abs(F.col("gap") - F.col("median")) <= 0.2 * F.col("median")).alias("_near"))
    rows = sizes.join(close, by, "left").withColumn("near", F.col("_near") / F.col("n_gaps")).join(most_in_hour(log, by, ts), by)
    kind = (
        F.when(F.unix_seconds("last_ts") < F.unix_seconds(F.lit(now)) - 30 * 86400, "dormant")
        .when(F.col("most_in_hour") > 3, "burst")
        .when(F.col("n") < 3, "sparse")
        .when(F.col("near") > 0.6, "periodic")
        .otherwise("steady")
    )
    return rows.select(by, F.col("n").alias("n_events"), F.col("median").alias("median_gap"), "most_in_hour", kind.alias("cadence"))


def contested(log: DataFrame, target: str, agent: str, value: str, seq: str) -> DataFrame:
    """Targets that several agents last left with different values."""
    last = log.groupBy(target, agent).agg(F.max_by(value, seq).alias("v"))
    return last.groupBy(target).agg(F.count("*").alias("agents"), F.count_distinct("v").alias("values")).where("agents > 1 and values > 1")


def supersession(log: DataFrame, target: str, agent: str, seq: str) -> DataFrame:
    """How often each target was defined, by how many agents, and its share of all that was written since."""
    return log.groupBy(target).agg(F.count("*").alias("n_defs"), F.count_distinct(agent).alias("n_agents"), F.when(F.count("*") > 1, F.count("*") / F.max(seq)).otherwise(0.0).alias("rate"))


def kanban(records: DataFrame, field: str, options: list[str], key: str) -> DataFrame:
    """Records per option, in the options' order; empty options stay, everything else is (none), first."""
    spark = records.sparkSession
    columns = spark.createDataFrame([("(none)", 0), *((o, i + 1) for i, o in enumerate(options))], "option string, place int")
    named = records.select(F.when(F.col(field).isin(options), F.col(field)).otherwise("(none)").alias("option"), key)
    counts = named.groupBy("option").agg(F.count("*").alias("n"), F.min(key).alias("first"), F.max(key).alias("last"))
    return columns.join(counts, "option", "left").select("option", "place", F.coalesce("n", F.lit(0)).alias("n"), "first", "last")


def calendar(records: DataFrame, ts: str, key: str) -> DataFrame:
    """Records per day, with their first and last by time."""
    return records.where(F.col(ts).isNotNull()).groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"), F.min_by(key, F.struct(ts, key)).alias("first"), F.max_by(key, F.struct(ts, key)).alias("last"))


def type_counts(records: DataFrame, field: str) -> DataFrame:
    return records.groupBy(F.col(field).alias("type")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type")


def tree_roll_up(state: DataFrame) -> DataFrame:
    """Per path prefix: how many targets lie below it, directly and in all, and how deep."""
    from quillfold.functions import paths

    up = state.where(~F.col("target").rlike(r"(^|\.)_")).select("target", F.explode(paths.ancestors(F.col("target"))).alias("node"))
    direct = paths.parent(F.col("target")) == F.col("node")
    return up.groupBy("node").agg(F.count("*").alias("below"), F.count_if(direct).alias("children"), F.max(paths.depth(F.col("target"))).alias("deepest"))


def cards(log: DataFrame, target: str, op: str, ts: str, seq: str) -> DataFrame:
    """The short summary of every target: events, first and last, most frequent and latest operator, number of operators."""
    per = log.groupBy(target, op).agg(F.count("*").alias("k"), F.max(seq).alias("s"), F.max(ts).alias("t"), F.min(seq).alias("f"))
    frequent = F.min_by(op, F.struct((-F.col("k")).alias("k"), F.col(op).alias("o")))
    return per.groupBy(target).agg(F.sum("k").alias("n_events"), F.min("f").alias("first_seq"), F.max("s").alias("last_seq"), F.max("t").alias("last_ts"), frequent.alias("dominant"), F.max_by(op, "s").alias("recent"), F.count("*").alias("spread"))


def cohorts(records: DataFrame, traits: list[str], key: str, least: int = 2) -> DataFrame:
    """Groups of records with equal traits, all of them there, of at least so many members."""
    there = records.where(F.array_position(F.array(*(F.col(t).isNull() for t in traits)), True) == 0)
    digest = F.substring(F.sha2(F.concat_ws("|", *(F.col(t).cast("string") for t in traits)), 256), 1, 16)
    return there.groupBy(*traits).agg(F.count_distinct(key).alias("members"), F.min(key).alias("first"), F.max(key).alias("last")).where(F.col("members") >= least).withColumn("cohort", digest)


def crystallised(records: DataFrame, scope: str, traits: list[str], key: str, least: int = 2, known: DataFrame | None = None, deepest: int = 8) -> DataFrame:
    """(target, scope, members, status): an entity below each scope for every group of its records with equal traits.

    A group of at least so many members is `active`; an entity of known (target) whose group has fewer by now is `inert`
    and keeps its name. Nothing is made deeper than `deepest`. Records without scope or a trait belong to no group.
    """
    from quillfold.functions import paths

    there = records.where(~F.exists(F.array(F.col(scope).isNull(), *(F.col(t).isNull() for t in traits)), lambda x: x) & (paths.depth(F.col(scope)) < deepest))
    groups = there.groupBy(F.col(scope).alias("scope"), *traits).agg(F.count_distinct(key).alias("members"))
    digest = F.substring(F.sha2(F.concat_ws("|", *(F.col(t).cast("string") for t in traits)), 256), 1, 16)
    rows = groups.select(F.concat("scope", F.lit("."), digest).alias("target"), "scope", "members")
    if known is None:
        return rows.where(F.col("members") >= least).withColumn("status", F.lit("active"))
    out = rows.join(known.select("target", F.lit(True).alias("_known")).distinct(), "target", "full_outer")
    status = F.when(F.col("members") >= least, "active").when(F.col("_known"), "inert")
    out = out.withColumn("status", status).where("status is not null")
    return out.select("target", F.coalesce("scope", paths.parent(F.col("target"))).alias("scope"), F.coalesce("members", F.lit(0)).alias("members"), "status")


def entity_signals(log: DataFrame, by: str, ts: str, value: str, order: list[str]) -> DataFrame:
    """periodicity (1 - variation of the gaps), momentum (share of the events in the later half of the time), spread."""
    gaps = intervals(log, by, ts, order)
    span = gaps.groupBy(by).agg(F.count("*").alias("n"), F.avg("gap").alias("mean_gap"), F.stddev_samp("gap").alias("sd_gap"), F.min(F.unix_seconds(ts)).alias("a"), F.max(F.unix_seconds(ts)).alias("b"), F.stddev_samp(value).alias("spread"))
    late = gaps.join(span.select(by, ((F.col("a") + F.col("b")) / 2).alias("_half")), by).groupBy(by).agg(F.count_if(F.unix_seconds(ts) > F.col("_half")).alias("late"))
    periodicity = F.when((F.col("n") >= 3) & (F.col("mean_gap") > 0), F.greatest(F.lit(0.0), 1 - F.col("sd_gap") / F.col("mean_gap"))).otherwise(0.0)
    return span.join(late, by).select(by, "n", periodicity.alias("periodicity"), (F.col("late") / F.col("n")).alias("momentum"), "spread")


def classify_entities(signals: DataFrame, by: str, group: str, names: dict[str, str]) -> DataFrame:
    """names: signal -> class. The class whose signal stands out most, in deviations blended of the group's and of all.

    The group's deviation weighs min(1, members / 10). Confidence is the lead over the second, relative to the first.
    """
    cols = list(names)
    stat = lambda p: [x for c in cols for x in (F.avg(c).alias(f"{p}m_{c}"), F.stddev_samp(c).alias(f"{p}s_{c}"))]
    local = signals.groupBy(group).agg(F.count("*").alias("_n"), *stat("l"))
    everywhere = signals.agg(*stat("g"))
    rows = signals.join(local, group).crossJoin(F.broadcast(everywhere))  # one row
    z = lambda c, p: F.coalesce((F.col(c) - F.col(f"{p}m_{c}")) / F.nullif(F.col(f"{p}s_{c}"), F.lit(0.0)), F.lit(0.0))
    weight = F.least(F.lit(1.0), F.col("_n") / 10)
    scores = F.sort_array(F.array(*(F.struct((weight * z(c, "l") + (1 - weight) * z(c, "g")).alias("s"), F.lit(n).alias("n")) for c, n in names.items())), False)
    return rows.withColumn("_x", scores).select(by, group, F.col("_x")[0]["n"].alias("class"), F.col("_x")[0]["s"].alias("score"), F.when(F.col("_x")[0]["s"] > 0, F.least(F.lit(1.0), (F.col("_x")[0]["s"] - F.col("_x")[1]["s"]) / F.col("_x")[0]["s"])).otherwise(0.0).alias("confidence"))


def stability_streaks(log: DataFrame, scope: str, seq: str, changed: Column, window: int = 5) -> DataFrame:
    """Events without a change of structure in a row, per scope; `fires` at every full window."""
    w = Window.partitionBy(scope).orderBy(seq)
    rows = log.withColumn("_epoch", F.sum(changed.cast("int")).over(w))
    streak = F.row_number().over(Window.partitionBy(scope, "_epoch").orderBy(seq)) - F.when(F.col("_epoch") > 0, 1).otherwise(0)
    return rows.withColumn("streak", streak).withColumn("fires", (F.col("streak") > 0) & (F.col("streak") % window == 0)).drop("_epoch")
