"""Queries over branches, replicas and policies: one log in several versions, and what they come to together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from quillfold.functions import paths
from quillfold.operators import analytics, fold, horizon, sync, worlds
from quillfold.plans.event_queries import _SEC, _W, LOG, _writes, event_log
from quillfold.plans.registry import Book, read

book = Book()

_BRANCH = "CASE seq % 3 WHEN 0 THEN 'main' WHEN 1 THEN 'dev' ELSE 'fix' END"


def _branched(spark, d):
    n = F.col("seq") % 3
    return event_log(spark, d).withColumn("branch", F.when(n == 0, "main").when(n == 1, "dev").otherwise("fix"))


@book(
    f"""WITH l AS (SELECT event_id AS seq FROM events), b AS (SELECT seq, {_BRANCH} AS branch, (SELECT max(seq) FROM l) AS last FROM l)
    SELECT seq, branch FROM b WHERE branch = 'fix' OR (branch = 'dev' AND seq <= last * 3 // 4) OR (branch = 'main' AND seq <= last // 2)"""
)
def branch_log(spark, d):
    last = read(spark, d, "events").agg(F.max("event_id")).first()[0] or 0
    return fold.branch_history(_branched(spark, d), [("main", last // 2), ("dev", last * 3 // 4), ("fix", None)]).select("seq", "branch")


@book(
    f"""WITH l AS (SELECT *, {_BRANCH} AS branch FROM ({LOG})), r AS (SELECT branch, target, max(seq) FILTER (WHERE op <> 'DEF') AS since FROM l GROUP BY 1, 2),
    w AS (SELECT branch, target, seq, field, value FROM l UNION ALL SELECT branch, target, seq, 'k', k FROM l),
    f AS (SELECT branch, target, field, arg_max(value, w.seq) AS value FROM w JOIN r USING (branch, target) WHERE since IS NULL OR w.seq >= since GROUP BY 1, 2, 3),
    g AS (SELECT *, CASE branch WHEN 'main' THEN 0 WHEN 'dev' THEN 1 ELSE 2 END AS place FROM f), n AS (SELECT target, max(place) AS place FROM g GROUP BY 1)
    SELECT target, field, value, branch FROM g JOIN n USING (target, place)"""
)
def branch_reads(spark, d):
    return fold.branch_state(_branched(spark, d), ["main", "dev", "fix"]).select("target", "field", "value", "branch")


@book(
    """WITH s AS (SELECT user_id, event_id % 2 AS side, arg_max(value, event_id) AS v FROM events GROUP BY 1, 2)
    SELECT user_id AS target, coalesce(max(v) FILTER (WHERE side = 1), max(v) FILTER (WHERE side = 0)) AS value, count(*) FILTER (WHERE side = 1) > 0 AS is_staged FROM s GROUP BY 1"""
)
def sandbox_state(spark, d):
    last = read(spark, d, "events").groupBy(F.col("user_id").alias("target"), (F.col("event_id") % 2).alias("side")).agg(F.max_by("value", "event_id").alias("value"))
    return fold.sandbox(last.where("side = 1"), last.where("side = 0"))


@book("SELECT 'app.' || c_mktsegment || '.' || c_custkey AS target, c_mktsegment = 'BUILDING' AND c_custkey % 10 <> 1 AS is_deleted FROM customer")
def deleted_targets(spark, d):
    c = read(spark, d, "customer").select(F.concat_ws(".", F.lit("app"), "c_mktsegment", "c_custkey").alias("target"), "c_custkey")
    gone = fold.soft_delete(c, "app.BUILDING")
    back = fold.soft_delete(gone.where("c_custkey % 10 = 1"), "app", restore=True)
    return gone.where("c_custkey % 10 <> 1").unionByName(back).select("target", "is_deleted")


_POLICIES = ("binding", "clearing", "cultivating", "last-write-wins", "priority-weighted", "timestamp-ordered", "first", "authority-ranked", "tending")


@book(
    f"""WITH s AS (SELECT event_id % 2 AS side, user_id || '.' || event_type AS target, CAST(arg_max(value, event_id) AS VARCHAR) AS v, max(event_id) AS seq FROM events GROUP BY 1, 2),
    b AS (SELECT coalesce(o.target, t.target) AS target, o.v AS ov, t.v AS tv, o.seq AS os, t.seq AS ts FROM (SELECT * FROM s WHERE side = 0) o FULL JOIN (SELECT * FROM s WHERE side = 1) t ON o.target = t.target),
    p AS (SELECT unnest({list(_POLICIES)}) AS policy)
    SELECT policy, target, CASE WHEN os IS NULL THEN tv WHEN ts IS NULL OR ov = tv THEN ov WHEN policy IN ('clearing', 'binding', 'tending') THEN NULL
    WHEN policy IN ('last-write-wins', 'priority-weighted', 'timestamp-ordered') AND ts > os THEN tv ELSE ov END AS value,
    CASE WHEN os IS NULL THEN 'copied' WHEN ts IS NULL THEN 'ours' WHEN ov = tv THEN 'equal' WHEN policy = 'cultivating' THEN 'pending' WHEN policy IN ('binding', 'tending') THEN 'conflict' ELSE 'resolved' END AS outcome,
    CASE WHEN ov <> tv AND policy IN ('binding', 'tending') THEN ov || '|' || tv END AS candidates FROM b, p"""
)
def merge_policies(spark, d):
    e = read(spark, d, "events").withColumn("target", F.concat_ws(".", "user_id", "event_type"))
    side = lambda n: e.where(F.col("event_id") % 2 == n).groupBy("target").agg(F.max_by("value", "event_id").cast("string").alias("value"), F.max("event_id").alias("seq"), F.lit(f"a{n}").alias("agent"))
    one = lambda p: fold.absorb(side(0), side(1), p).select(F.lit(p).alias("policy"), "target", "value", "outcome", F.array_join("candidates", "|").alias("candidates"))
    return reduce(lambda a, b: a.unionByName(b), map(one, _POLICIES))


_STANCES = ("clearing", "binding", "dissecting", "composing", "tracing")


@book(
    f"""WITH {_W}, c AS (SELECT entity, source, field, value, ts FROM (SELECT *, row_number() OVER (PARTITION BY entity, source, field ORDER BY ts DESC, seq DESC) AS n FROM w) WHERE n = 1),
    g AS (SELECT entity, field, count(DISTINCT source) AS sources, count(DISTINCT value) AS kinds, min(value) AS least, arg_min(value, source) AS clearing, string_agg(value, ' | ' ORDER BY source) AS binding,
    CAST(round(avg(CAST(value AS DOUBLE)), 4) AS VARCHAR) AS composing, (array_agg(value ORDER BY ts DESC, source DESC))[1] AS tracing FROM c GROUP BY 1, 2)
    SELECT how, entity, field, CASE how WHEN 'clearing' THEN clearing WHEN 'binding' THEN binding WHEN 'dissecting' THEN CASE WHEN kinds > 1 THEN 'conflict: ' || binding ELSE least END
    WHEN 'composing' THEN composing ELSE tracing END AS value, sources FROM g, (SELECT unnest({list(_STANCES)}) AS how)"""
)
def stances(spark, d):
    last = worlds.as_of(_writes(spark, d), by=("entity", "source"))

    def one(how):
        value = F.round(F.col("value").cast("double"), 4).cast("string") if how == "composing" else F.col("value")
        return worlds.stance(last, how).select(F.lit(how).alias("how"), "entity", "field", value.alias("value"), "sources")

    return reduce(lambda a, b: a.unionByName(b), map(one, _STANCES))


@book(
    """WITH x AS (SELECT event_id AS seq, user_id % 7 AS replica, max(epoch_us(ts) // 1000) OVER (PARTITION BY user_id % 7 ORDER BY event_id) AS hlc_wall FROM events)
    SELECT seq, hlc_wall, row_number() OVER (PARTITION BY replica, hlc_wall ORDER BY seq) - 1 AS hlc_logical FROM x"""
)
def stamped_events(spark, d):
    e = read(spark, d, "events").select(F.col("event_id").alias("seq"), (F.col("user_id") % 7).alias("replica_id"), F.unix_millis("ts").alias("wall_ms"))
    return sync.ticked(e).select("seq", "hlc_wall", F.col("hlc_logical").cast("long").alias("hlc_logical"))


@book("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'we' ELSE 'they' END AS lacking FROM events WHERE (event_id % 3 = 0) <> (event_id % 4 = 0)")
def replica_gaps(spark, d):
    e = read(spark, d, "events").select("event_id")
    we, they = sync.missing(e.where("event_id % 3 <> 0"), e.where("event_id % 4 <> 0"), "event_id")
    return we.withColumn("lacking", F.lit("we")).unionByName(they.withColumn("lacking", F.lit("they")))


@book(
    f"""WITH n AS (SELECT max({_SEC}) AS now FROM events), g AS (SELECT user_id, {_SEC} AS t, {_SEC} - lag({_SEC}) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events)
    SELECT user_id AS target, 'stale' AS kind, CAST(((SELECT now FROM n) - max(t)) // 86400 AS BIGINT) AS detail FROM g GROUP BY 1 HAVING max(t) < (SELECT now FROM n) - 14 * 86400
    UNION ALL SELECT user_id, 'gap', CAST(max(gap) // 86400 AS BIGINT) FROM g GROUP BY 1 HAVING max(gap) > 3 * 86400"""
)
def untouched_and_gaps(spark, d):
    e = read(spark, d, "events")
    return horizon.observations(e, e.agg(F.max("ts")).first()[0], "user_id", "ts")


@book(
    """SELECT 'app.n' || n_nationkey AS target, 'owner' AS field, 'all' AS value, CAST(1 AS INTEGER) AS distance FROM nation
    UNION ALL SELECT 'app.n' || c_nationkey || '.c' || c_custkey, 'owner', 'all', 2 FROM customer
    UNION ALL SELECT 'app.n' || c_nationkey || '.c' || c_custkey, 'region', CAST(n_regionkey AS VARCHAR), 1 FROM customer JOIN nation ON c_nationkey = n_nationkey"""
)
def inherited_fields(spark, d):
    nations = read(spark, d, "nation").select(F.concat(F.lit("app.n"), "n_nationkey").alias("target"), F.create_map(F.lit("region"), F.col("n_regionkey").cast("string")).alias("value"))
    people = read(spark, d, "customer").select(F.concat(F.lit("app.n"), "c_nationkey", F.lit(".c"), "c_custkey").alias("target"), F.create_map(F.lit("segment"), F.col("c_mktsegment")).alias("value"))
    root = spark.range(1).select(F.lit("app").alias("target"), F.create_map(F.lit("owner"), F.lit("all"), F.lit("region"), F.lit("none")).alias("value"))
    current = nations.unionByName(people).unionByName(root)
    return fold.grounds(current.withColumn("depth", paths.depth(F.col("target"))))


@book(
    """SELECT 'u' || user_id AS source, event_type AS dest, 'e' || (max(event_id) % 3) AS edge_type, max(event_id) AS seq FROM events GROUP BY user_id, event_type HAVING max(event_id) % 4 <> 0"""
)
def open_edges(spark, d):
    n, kind = F.col("event_id"), F.array("event_type")
    e = read(spark, d, "events")  # every fourth event removes, every eighth adds and removes at once
    log = e.select(n.alias("seq"), F.lit("CON").alias("op"), F.concat(F.lit("u"), "user_id").alias("target"), F.concat(F.lit("e"), n % 3).alias("edge_type"), F.when((n % 4 != 0) | (n % 8 == 0), kind).alias("added"), F.when(n % 4 == 0, kind).alias("removed"))
    return fold.edges(log)


@book(
    """WITH l AS (SELECT event_id AS seq, user_id, event_id % 5 = 0 AS ins FROM events), f AS (SELECT user_id, min(seq) FILTER (WHERE ins) AS made FROM l GROUP BY 1)
    SELECT seq, CASE WHEN ins THEN 'target exists' ELSE 'no such target' END AS error FROM l JOIN f USING (user_id) WHERE (ins AND seq > made) OR (NOT ins AND (made IS NULL OR seq < made))"""
)
def quarantined_events(spark, d):
    e = read(spark, d, "events").select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 5 == 0, "INS").otherwise("DEF").alias("op"), F.col("user_id").alias("target"))
    return fold.quarantine(e)[1].select("seq", "error")


@book("SELECT min(event_id) AS seq FROM events WHERE event_id % 3 <> 0 GROUP BY user_id, event_type UNION ALL SELECT event_id FROM events WHERE event_id % 3 = 0")
def deduplicated_events(spark, d):
    e = read(spark, d, "events").select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 != 0, F.concat_ws(".", "user_id", "event_type")).alias("client_event_id"))
    return fold.deduplicate(e).select("seq")


@book(
    """WITH h AS (SELECT user_id, md5(string_agg(DISTINCT event_type, '|' ORDER BY event_type)) AS hash FROM events GROUP BY 1)
    SELECT hash, count(*) AS members, min(user_id) AS first, max(user_id) AS last FROM h GROUP BY 1 HAVING count(*) >= 2"""
)
def equal_histories(spark, d):
    kinds = F.array_join(F.array_sort(F.collect_set("event_type")), "|")
    return horizon.hash_cohorts(read(spark, d, "events").groupBy(F.col("user_id").alias("target")).agg(F.md5(kinds).alias("hash")))


@book(
    f"""WITH {_W}, x AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY entity, field, source ORDER BY ts, seq) = 1 THEN 1 ELSE 0 END AS n FROM w),
    p AS (SELECT * FROM (SELECT entity, field, epoch_us(ts) AS moment, sum(n) OVER (PARTITION BY entity, field ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS s FROM x) WHERE s > 1)
    SELECT entity, field, moment, lag(moment) OVER v AS previous, lead(moment) OVER v AS next FROM p WINDOW v AS (PARTITION BY entity ORDER BY moment, field)"""
)
def divergence_neighbours(spark, d):
    out = worlds.neighbours_in_time(worlds.divergence(_writes(spark, d)), "entity", "ts")
    return out.select("entity", "field", *(F.unix_micros(c).alias(n) for c, n in (("ts", "moment"), ("previous", "previous"), ("next", "next"))))


@book(
    """WITH g AS (SELECT 'app.' || p_brand AS scope, p_type, count(*) AS members FROM part GROUP BY 1, 2)
    SELECT scope || '.' || substr(sha256(p_type), 1, 16) AS target, scope, members, CASE WHEN members >= 4 THEN 'active' ELSE 'inert' END AS status FROM g WHERE members >= 2"""
)
def crystallised_parts(spark, d):
    parts = read(spark, d, "part").withColumn("scope", F.concat(F.lit("app."), "p_brand"))
    earlier = analytics.crystallised(parts, "scope", ["p_type"], "p_partkey", 2)
    return analytics.crystallised(parts, "scope", ["p_type"], "p_partkey", 4, earlier)


QUERIES, ORACLE = book.queries, book.sql
