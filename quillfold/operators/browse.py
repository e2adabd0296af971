"""Reading the log as a person does, and keeping it in order: pages, search, validation, migration, undoing.

log: (seq, op, target, operand MAP<STRING,STRING>, agent, ts). Every step is a filter, a ranking of k rows or an
aggregate that combines before the shuffle; none gathers a target's history in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillfold.functions import paths

OPS = ("NUL", "SIG", "INS", "SEG", "CON", "SYN", "DEF", "EVA", "REC")
#: Operators that need something in their operand.
FILLED = ("INS", "SEG", "CON", "SYN", "DEF", "EVA", "REC")


def tail(log: DataFrame, since: int, limit: int | None = None) -> DataFrame:
    """Events after a seq, oldest first."""
    rows = log.where(F.col("seq") > since).orderBy("seq")
    return rows if limit is None else rows.limit(limit)


def page_before(log: DataFrame, before: int, limit: int) -> DataFrame:
    """The newest `limit` events before a seq, oldest first."""
    return log.where(F.col("seq") < before).orderBy(F.col("seq").desc()).limit(limit).orderBy("seq")


def matching(log: DataFrame, ops: tuple[str, ...] = (), prefix: str | None = None, agent: str | None = None, text: str | None = None, system_only: bool = False) -> DataFrame:
    """Events that fit all that is given; text is looked for in target, agent, op and operand, whatever the case."""
    hit = F.lit(True)
    if ops:
        hit &= F.col("op").isin(*ops)
    if prefix is not None:
        hit &= paths.under(F.col("target"), prefix, itself=True)
    if agent is not None:
        hit &= F.col("agent") == agent
    if system_only:
        hit &= F.col("agent") == "system"
    if text is not None:
        parts = (F.col("target"), F.col("agent"), F.col("op"), F.to_json("operand"))
        hit &= F.lower(F.concat_ws("\n", *parts)).contains(text.lower())
    return log.where(hit)


def search(state: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """(target, score): where the text stands in a target counts first, then the target's length; smaller is better."""
    at = F.locate(query.lower(), F.lower("target"))
    scored = state.select("target", ((at - 1) * 1000 + F.length("target")).cast("long").alias("score")).where(at > 0)
    return scored.orderBy("score", "target").limit(limit)


def invalid(log: DataFrame) -> DataFrame:
    """Events that can't be read as one of OPS, with the first reason."""
    op, target, operand = F.col("op"), F.col("target"), F.col("operand")
    reason = (
        F.when(op.isNull() | ~op.isin(*OPS), "unknown op")
        .when(target.isNull() | (F.trim(target) == ""), "no target")
        .when(target.rlike(r"^\.|\.\.|\.$"), "empty segment")
        .when(F.col("agent").isNull() | (F.col("agent") == ""), "no agent")
        .when(F.col("ts").isNull(), "no time")
        .when(op.isin(*FILLED) & (operand.isNull() | (F.size(operand) < 1)), "empty operand")
    )
    return log.withColumn("reason", reason).where("reason is not null")


def migrate(state: DataFrame, prefix: str, rules: list[tuple]) -> DataFrame:
    """Applies rules in order to the value map of targets below prefix.

    (`rename`, old, new) keeps what new holds if old is missing; (`coerce`, field, type) makes what can't be read null;
    (`set`, field, value); (`delete`, field).
    """
    value = F.col("value")

    def without(m: Column, field: str) -> Column:
        return F.map_filter(m, lambda k, _: k != field)

    def put(m: Column, field: str, x: Column) -> Column:
        return F.map_concat(without(m, field), F.create_map(F.lit(field), x))

    for kind, field, *more in rules:
        has = F.map_contains_key(value, field)
        if kind == "rename":
            value = F.when(has, put(without(value, field), more[0], F.element_at(value, field))).otherwise(value)
        elif kind == "coerce":
            value = F.when(has, put(value, field, F.element_at(value, field).try_cast(more[0]).cast("string"))).otherwise(value)
        elif kind == "set":
            value = put(value, field, F.lit(more[0]).cast("string"))
        elif kind == "delete":
            value = without(value, field)
        else:
            raise ValueError(f"no migration rule {kind!r}")
    return state.withColumn("value", F.when(paths.under(F.col("target"), prefix), value).otherwise(F.col("value")))


def stale(log: DataFrame, now, days: int, what: tuple[str, ...] = ("EVA",)) -> DataFrame:
    """(target, seq, ts): each target's last event of these kinds, if it is older than so many days and no later event superseded it."""
    last = log.groupBy("target").agg(F.max(F.struct("seq", "op", "ts")).alias("x"))
    old = F.unix_seconds("x.ts") < F.unix_seconds(F.lit(now)) - days * 86400
    return last.where(F.col("x.op").isin(*what) & old).select("target", "x.seq", "x.ts")


def undone(current: DataFrame, changes: DataFrame, upto: int) -> DataFrame:
    """(target, field, value) as of seq upto, read backwards.

    current: (target, field, value) now; changes: (target, field, seq, prev), prev being what a change replaced. The
    value is what the first later change replaced, or the present one if none came later.
    """
    first = changes.where(F.col("seq") > upto).groupBy("target", "field").agg(F.min_by(F.struct("prev"), "seq").alias("x"))
    return current.join(first, ["target", "field"], "left").select("target", "field", F.when(F.col("x").isNull(), F.col("value")).otherwise(F.col("x.prev")).alias("value"))


def with_all(log: DataFrame, kinds: list, by: str = "target", what: str = "op", without: list = ()) -> DataFrame:
    """What has an event of each of these kinds and of none of the others: one aggregate instead of joined sets."""
    kind = F.col(what)
    seen = log.where(kind.isin(*kinds, *without)).groupBy(by).agg(F.count_distinct(F.when(kind.isin(*kinds), kind)).alias("n"), F.max(kind.isin(*without) if without else F.lit(False)).alias("bad"))
    return seen.where((F.col("n") == len(set(kinds))) & ~F.col("bad")).select(by)


def mutual(links: DataFrame) -> DataFrame:
    """(source, dest), once each, of links that stand in both directions."""
    up = F.col("source") < F.col("dest")
    rows = links.where("source <> dest").select(F.least("source", "dest").alias("a"), F.greatest("source", "dest").alias("b"), up.alias("up"))
    both = rows.groupBy("a", "b").agg(F.max("up").alias("there"), F.max(~F.col("up")).alias("back"))
    return both.where("there and back").select(F.col("a").alias("source"), F.col("b").alias("dest"))


def connection_groups(links: DataFrame, hidden: tuple[str, ...] = ()) -> DataFrame:
    """(collection, links, targets, hidden): links by the collection that they lead to, largest first, hidden ones last."""
    to = paths.parent(F.col("dest"))
    rows = links.groupBy(F.coalesce(to, F.lit("")).alias("collection")).agg(F.count("*").alias("links"), F.count_distinct("dest").alias("targets"))
    rows = rows.withColumn("hidden", F.col("collection").isin(*hidden) if hidden else F.lit(False))
    return rows.orderBy("hidden", F.col("links").desc(), "collection")


def prototypes(rows: DataFrame, by: str, numbers: list[str], cell: str) -> DataFrame:
    """Of each group its size, the means of its numbers and its most frequent cell; of equally frequent ones the least."""
    counted = rows.groupBy(by, cell).agg(F.count("*").alias("_n"), *(F.sum(c).alias(f"_s_{c}") for c in numbers), *(F.count(c).alias(f"_c_{c}") for c in numbers))
    top = F.min_by(F.col(cell), F.struct((-F.col("_n")).alias("n"), F.col(cell).alias("c")))
    return counted.groupBy(by).agg(F.sum("_n").alias("members"), *((F.sum(f"_s_{c}") / F.sum(f"_c_{c}")).alias(f"mean_{c}") for c in numbers), top.alias("dominant"))


def latest_by(log: DataFrame, by: list[str], seq: str = "seq") -> DataFrame:
    """The last event of each combination, such as the last observation of a site in each resolution."""
    rest = [c for c in log.columns if c not in by]
    return log.groupBy(*by).agg(F.max_by(F.struct(*rest), seq).alias("x")).select(*by, *(F.col(f"x.{c}").alias(c) for c in rest))
