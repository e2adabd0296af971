"""Queries that browse the log, check it and look at it from other sides."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillfold.functions import paths, values
from quillfold.operators import browse, fold, horizon, sync, worlds
from quillfold.plans.event_queries import LOG, event_log
from quillfold.plans.registry import Book, read
from quillfold.sources.records import collection

book = Book()


@book("SELECT event_id AS seq, 'app.users.u' || user_id AS target FROM events WHERE event_id > 200 ORDER BY event_id LIMIT 100")
def log_tail(spark, d):
    return browse.tail(event_log(spark, d), 200, 100).select("seq", "target")


@book("SELECT seq, target, op FROM (SELECT * FROM (" + LOG + ") WHERE seq < 500 ORDER BY seq DESC LIMIT 50) ORDER BY seq")
def reverse_page(spark, d):
    return browse.page_before(event_log(spark, d), 500, 50).select("seq", "target", "op")


@book(f"SELECT seq, target, op, agent FROM ({LOG}) WHERE op IN ('DEF', 'EVA') AND agent = 'agent2' AND starts_with(target, 'app.users.') AND field = 'purchase'")
def log_browser(spark, d):
    return browse.matching(event_log(spark, d), ("DEF", "EVA"), "app.users", "agent2", "PURCHASE").select("seq", "target", "op", "agent")


@book("SELECT target, CAST((instr(target, '12') - 1) * 1000 + length(target) AS BIGINT) AS score FROM (SELECT 'app.customer.' || c_custkey AS target FROM customer) WHERE contains(target, '12') ORDER BY score, target LIMIT 20")
def record_search(spark, d):
    return browse.search(read(spark, d, "customer").select(F.concat(F.lit("app.customer."), "c_custkey").alias("target")), "12")


@book(
    """SELECT event_id AS seq, CASE WHEN event_id % 7 = 0 THEN 'unknown op' WHEN event_id % 11 = 0 THEN 'empty segment' WHEN event_id % 13 = 0 THEN 'no agent'
    WHEN event_id % 17 = 0 THEN 'empty operand' END AS reason FROM events WHERE event_id % 7 = 0 OR event_id % 11 = 0 OR event_id % 13 = 0 OR event_id % 17 = 0"""
)
def invalid_events(spark, d):
    def spoilt(n, bad, good):
        return F.when(F.col("seq") % n == 0, bad).otherwise(good)

    log = event_log(spark, d)
    log = log.select("seq", spoilt(7, F.lit("XXX"), F.lit("DEF")).alias("op"), spoilt(11, F.lit("app..u"), F.col("target")).alias("target"), spoilt(13, F.lit(""), F.col("agent")).alias("agent"), spoilt(17, F.lit(None).cast("map<string,string>"), F.col("operand")).alias("operand"), "ts")
    return browse.invalid(log).select("seq", "reason")


@book("SELECT 'app.part.' || p_partkey AS target, p_name AS title, p_size AS size, 'v2' AS version, CAST(NULL AS VARCHAR) AS brand FROM part")
def migrated_parts(spark, d):
    state = collection(read(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_brand"), "part", "p_partkey")
    out = browse.migrate(state, "app.part", [("rename", "p_name", "title"), ("coerce", "p_size", "int"), ("set", "version", "v2"), ("delete", "p_brand")])
    v = F.col("value")
    return out.select("target", v["title"].alias("title"), v["p_size"].cast("int").alias("size"), v["version"].alias("version"), v["p_brand"].alias("brand"))


_NOW = "(SELECT max(CAST(floor(epoch(ts)) AS BIGINT)) FROM events)"


@book(f"WITH x AS (SELECT target, max(seq) AS seq, arg_max(op, seq) AS op, arg_max(CAST(floor(epoch(ts)) AS BIGINT), seq) AS t FROM ({LOG}) GROUP BY 1) SELECT target, seq FROM x WHERE op IN ('DEF', 'EVA') AND t < {_NOW} - 86400")
def stale_targets(spark, d):
    log = event_log(spark, d)
    return browse.stale(log, log.agg(F.max("ts")).first()[0], 1, ("DEF", "EVA")).select("target", "seq")


@book("SELECT 'app.users.u' || user_id AS target, event_type AS field, arg_max(value, event_id) FILTER (WHERE event_id <= 300) AS value FROM events GROUP BY 1, 2")
def undone_state(spark, d):
    e = read(spark, d, "events").select(F.concat(F.lit("app.users.u"), "user_id").alias("target"), F.col("event_type").alias("field"), "value", F.col("event_id").alias("seq"))
    changes = e.withColumn("prev", F.lag("value").over(Window.partitionBy("target", "field").orderBy("seq")))
    current = e.groupBy("target", "field").agg(F.max_by("value", "seq").alias("value"))
    return browse.undone(current, changes, 300)


@book(
    """SELECT user_id FROM (SELECT user_id, count(DISTINCT event_type) FILTER (WHERE event_type IN ('signup', 'purchase')) AS n, count(*) FILTER (WHERE event_type = 'error' AND value > 90) AS bad FROM events GROUP BY 1)
    WHERE n = 2 AND bad = 0"""
)
def users_with_all(spark, d):
    e = read(spark, d, "events").withColumn("kind", F.when((F.col("event_type") == "error") & (F.col("value") > 90), "bad").otherwise(F.col("event_type")))
    return browse.with_all(e, ["signup", "purchase"], "user_id", "kind", ["bad"])


_STEPS = "SELECT user_id % 40 AS source, CAST(CAST(json_extract(props, '$.k') AS BIGINT) % 40 AS BIGINT) AS dest FROM events"


def _steps(spark, d):
    e = read(spark, d, "events")
    return e.select((F.col("user_id") % 40).alias("source"), (F.get_json_object("props", "$.k").cast("long") % 40).alias("dest"))


@book(f"WITH s AS (SELECT DISTINCT * FROM ({_STEPS})) SELECT source, dest FROM s WHERE source < dest AND EXISTS (SELECT 1 FROM s AS t WHERE t.source = s.dest AND t.dest = s.source)")
def mutual_links(spark, d):
    return browse.mutual(_steps(spark, d))


_LINKS = "SELECT 'app.orders.' || l_orderkey AS source, 'app.part.' || l_partkey AS dest FROM lineitem UNION ALL SELECT 'app.orders.' || l_orderkey, 'app.supplier.' || (l_suppkey * 2) FROM lineitem"


def _links(spark, d):
    li = read(spark, d, "lineitem")
    dests = F.array(F.concat(F.lit("app.part."), "l_partkey"), F.concat(F.lit("app.supplier."), F.col("l_suppkey") * 2))
    return li.select(F.concat(F.lit("app.orders."), "l_orderkey").alias("source"), F.explode(dests).alias("dest"))


@book(f"SELECT regexp_replace(dest, '\\.[^.]*$', '') AS collection, count(*) AS links, count(DISTINCT dest) AS targets, regexp_replace(dest, '\\.[^.]*$', '') = 'app.part' AS hidden FROM ({_LINKS}) GROUP BY 1, 4")
def connection_groups(spark, d):
    return browse.connection_groups(_links(spark, d), ("app.part",))


def _targets(spark, d):
    named = lambda t, k: read(spark, d, t).select(F.concat(F.lit(f"app.{t}."), k).alias("target"))
    return named("orders", "o_orderkey").unionByName(named("part", "p_partkey")).unionByName(named("supplier", "s_suppkey"))


_TARGETS = "SELECT 'app.orders.' || o_orderkey AS target FROM orders UNION ALL SELECT 'app.part.' || p_partkey FROM part UNION ALL SELECT 'app.supplier.' || s_suppkey FROM supplier"


@book(f"SELECT dest, count(*) AS n FROM ({_LINKS}) WHERE dest NOT IN ({_TARGETS}) GROUP BY 1")
def dangling_links(spark, d):
    return fold.dangling(_targets(spark, d), _links(spark, d)).select(F.col("missing").alias("dest"), "n")


@book(f"SELECT count(*) AS links, count(DISTINCT source) AS sources FROM ({_LINKS}) WHERE starts_with(dest, 'app.supplier.')")
def crossing_links(spark, d):
    return fold.crossing_edges(_links(spark, d), "app.supplier").agg(F.count("*").alias("links"), F.count_distinct("source").alias("sources"))


@book("SELECT l_returnflag AS flag, count(*) AS members, round(avg(l_quantity), 6) AS mean_quantity, round(avg(l_discount), 6) AS mean_discount, (SELECT l_linenumber FROM lineitem AS b WHERE b.l_returnflag = a.l_returnflag GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS dominant FROM lineitem AS a GROUP BY 1")
def prototype_means(spark, d):
    out = browse.prototypes(read(spark, d, "lineitem"), "l_returnflag", ["l_quantity", "l_discount"], "l_linenumber")
    return out.select(F.col("l_returnflag").alias("flag"), "members", F.round("mean_l_quantity", 6).alias("mean_quantity"), F.round("mean_l_discount", 6).alias("mean_discount"), "dominant")


@book("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def latest_observations(spark, d):
    return browse.latest_by(read(spark, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


_H = "list_reduce(list_prepend(CAST({0} AS HUGEINT), list_transform(string_split(target, ''), lambda c: CAST(ord(c) AS HUGEINT))), lambda h, x: {1})"


@book(f"SELECT target, CAST({_H.format(2166136261, '(xor(h, x) * 16777619) % 4294967296')} AS BIGINT) AS fnv, CAST({_H.format(5381, '(h * 33 + x) % 4294967296')} % 16 AS INTEGER) AS shard FROM (SELECT 'app.' || c_mktsegment || '.' || c_name AS target FROM customer)")
def hash_shards(spark, d):
    t = read(spark, d, "customer").select(F.concat(F.lit("app."), "c_mktsegment", F.lit("."), "c_name").alias("target"))
    return t.select("target", values.fnv1a(F.col("target")).alias("fnv"), values.shard(F.col("target"), 16).alias("shard"))


@book("SELECT 'app.orders.' || l_orderkey || '.lines.' || l_linenumber AS target FROM lineitem WHERE l_linenumber = 3")
def glob_paths(spark, d):
    t = read(spark, d, "lineitem").select(F.concat(F.lit("app.orders."), "l_orderkey", F.lit(".lines."), "l_linenumber").alias("target"))
    return t.where(paths.glob(F.col("target"), "app.**.*.3"))


_LINES = "SELECT 'app.orders.' || l_orderkey || '.lines.' || l_linenumber AS target, l_orderkey % 100 = 0 AS own, l_linenumber = 2 AS direct FROM lineitem"


@book(f"SELECT target, CASE WHEN direct THEN target WHEN own THEN regexp_replace(target, '\\.lines\\..*$', '') ELSE 'app.orders' END AS governed_by, CASE WHEN direct THEN 'direct' ELSE 'ancestor' END AS scope FROM (SELECT DISTINCT * FROM ({_LINES}))")
def governed(spark, d):
    li = read(spark, d, "lineitem")
    order = F.concat(F.lit("app.orders."), "l_orderkey")
    line = F.concat(order, F.lit(".lines."), "l_linenumber")
    orders = li.where("l_orderkey % 100 = 0").select(order.alias("target"), F.lit("order").alias("rule"))
    lines = li.where("l_linenumber = 2").select(line.alias("target"), F.lit("line").alias("rule"))
    root = spark.createDataFrame([("app.orders", "all")], "target string, rule string")
    rules = orders.unionByName(lines).unionByName(root).distinct()
    return horizon.governance(li.select(line.alias("target")).distinct(), rules).select("target", "governed_by", "scope")


@book(
    """WITH l AS (SELECT event_id AS seq, user_id, CASE WHEN event_id % 9 = 4 THEN 'NUL' WHEN event_id % 3 = 0 THEN 'INS' ELSE 'DEF' END AS op FROM events)
    SELECT seq, CASE WHEN EXISTS (SELECT 1 FROM l AS m WHERE m.user_id = l.user_id AND m.op = 'INS' AND m.seq < l.seq) THEN 'cleared' ELSE 'never-set' END AS nul_state FROM l WHERE op = 'NUL'"""
)
def null_observations(spark, d):
    op = F.when(F.col("event_id") % 9 == 4, "NUL").when(F.col("event_id") % 3 == 0, "INS").otherwise("DEF")
    return fold.null_states(read(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("target"), op.alias("op"))).select("seq", "nul_state")


@book(
    """SELECT user_id AS member, arg_max(event_type, event_id) AS role FROM events GROUP BY 1
    HAVING arg_max(event_id % 4 <> 0, event_id)"""
)
def granted_roles(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").alias("member"), F.when(F.col("event_id") % 4 == 0, "revoke").otherwise("grant").alias("action"), F.col("event_type").alias("role"), F.col("event_id").alias("seq"))
    return sync.grants(e)


@book(
    """WITH b AS (SELECT epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi FROM events), s AS (SELECT CAST(i AS INTEGER) AS step, CAST(floor(lo + ((hi - lo) * i / 4)) AS BIGINT) AS moment FROM b, range(5) AS r(i)),
    w AS (SELECT user_id, event_type, value, epoch_us(ts) AS a, lead(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS z FROM events)
    SELECT step, user_id AS entity, event_type AS field, value FROM s JOIN w ON moment >= a AND (z IS NULL OR moment < z)"""
)
def timeline_steps(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").alias("entity"), F.col("event_type").alias("field"), "value", "ts", F.col("event_id").alias("seq"))
    return worlds.timeline(e, 5)


QUERIES, ORACLE = book.queries, book.sql
