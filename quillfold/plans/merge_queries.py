"""Queries that merge, heal and check a log, and that show and name what is in it."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillfold.functions import display
from quillfold.operators import edges, fold, graph, merging, records, vectors
from quillfold.plans.registry import Book, read
from quillfold.sources.records import collection, long_form

book = Book()

#: A log whose users write few values, so that writes often change nothing.
_FEW = """SELECT event_id AS seq, CASE WHEN event_id = min(event_id) OVER (PARTITION BY user_id) THEN 'INS' WHEN event_id % 16 = 0 THEN 'SEG' ELSE 'DEF' END AS op, user_id AS target, event_type AS field,
CAST(CAST(floor(value / 60) AS BIGINT) AS VARCHAR) AS value, CAST(event_id % 2 AS VARCHAR) AS k FROM events"""


def _few(spark, d):
    e = read(spark, d, "events")
    first = e.groupBy("user_id").agg(F.min("event_id").alias("_first"))
    op = F.when(F.col("event_id") == F.col("_first"), "INS").when(F.col("event_id") % 16 == 0, "SEG").otherwise("DEF")
    operand = F.create_map(F.col("event_type"), F.floor(F.col("value") / 60).cast("string"), F.lit("k"), (F.col("event_id") % 2).cast("string"))
    return e.join(first, "user_id").select(F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").alias("target"), operand.alias("operand"))


@book(
    f"""WITH l AS ({_FEW}), w AS (SELECT seq, op, target, field, value FROM l UNION ALL SELECT seq, op, target, 'k', k FROM l),
    s AS (SELECT e.seq, max(r.seq) AS since FROM l e JOIN l r ON r.target = e.target AND r.op <> 'DEF' AND r.seq <= e.seq GROUP BY 1),
    b AS (SELECT w.seq, w.target, w.field, w.value, arg_max(p.value, p.seq) AS before FROM w JOIN s USING (seq) LEFT JOIN w p ON p.target = w.target AND p.field = w.field AND p.seq < w.seq AND p.seq >= s.since
    WHERE w.op = 'DEF' GROUP BY 1, 2, 3, 4) SELECT seq, target, bool_and(coalesce(value = before, false)) AS no_op FROM b GROUP BY 1, 2"""
)
def unchanged_writes(spark, d):
    return fold.no_ops(_few(spark, d))


_PAIRS = "SELECT a.s_suppkey AS ka, b.s_suppkey AS kb FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1 WHERE a.s_suppkey % 6 = 2"


def _merges(spark, d):
    t = lambda c: F.concat(F.lit("app.supplier."), c)
    s = read(spark, d, "supplier").where("s_suppkey % 6 = 2")
    into = F.when(F.col("s_suppkey") % 4 == 0, t(F.col("s_suppkey"))).otherwise(F.concat(F.lit("app.supplier.m"), "s_suppkey"))
    return s.select(t(F.col("s_suppkey")).alias("a"), t(F.col("s_suppkey") + 1).alias("b"), into.alias("into"), F.col("s_suppkey").alias("seq"))


@book(
    f"""WITH p AS ({_PAIRS}), s AS (SELECT s_suppkey AS k, s_name, CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_nationkey AS VARCHAR) END AS home FROM supplier),
    m AS (SELECT ka, kb, CASE WHEN ka % 4 = 0 THEN 'app.supplier.' || ka ELSE 'app.supplier.m' || ka END AS t FROM p WHERE kb IN (SELECT k FROM s))
    SELECT t AS target, b.s_name AS name, coalesce(b.home, a.home) AS home, CAST(NULL AS VARCHAR) AS alias FROM m JOIN s a ON a.k = ka JOIN s b ON b.k = kb
    UNION ALL SELECT 'app.supplier.' || kb, NULL, NULL, t FROM m UNION ALL SELECT 'app.supplier.' || ka, NULL, NULL, t FROM m WHERE ka % 4 <> 0
    UNION ALL SELECT 'app.supplier.' || k, s_name, home, NULL FROM s WHERE k NOT IN (SELECT ka FROM m) AND k NOT IN (SELECT kb FROM m)"""
)
def merged_suppliers(spark, d):
    s = read(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey").cast("string")).alias("home"))
    v = F.col("value")
    return merging.merged(collection(s, "supplier", "s_suppkey"), _merges(spark, d)).select("target", v["name"].alias("name"), v["home"].alias("home"), v["_alias"].alias("alias"))


@book(
    f"""WITH p AS ({_PAIRS}), m AS (SELECT ka AS k, CASE WHEN ka % 4 = 0 THEN 'app.supplier.' || ka ELSE 'app.supplier.m' || ka END AS t FROM p UNION ALL SELECT kb, CASE WHEN ka % 4 = 0 THEN 'app.supplier.' || ka ELSE 'app.supplier.m' || ka END FROM p)
    SELECT DISTINCT 'app.part.' || l_partkey AS source, coalesce(t, 'app.supplier.' || l_suppkey) AS dest FROM lineitem LEFT JOIN m ON k = l_suppkey"""
)
def rewired_links(spark, d):
    links = read(spark, d, "lineitem").select(F.concat(F.lit("app.part."), "l_partkey").alias("source"), F.concat(F.lit("app.supplier."), "l_suppkey").alias("dest"))
    return merging.rewired(links, _merges(spark, d))


@book(
    """SELECT 'app.n' || c_nationkey || '.c' || c_custkey AS a, 'app.n' || (c_custkey % 25) || '.x' AS b, c_nationkey = c_custkey % 25 AND c_nationkey % 3 = 0 AS bounded FROM customer"""
)
def bounded_pairs(spark, d):
    c = read(spark, d, "customer")
    pairs = c.select(F.concat(F.lit("app.n"), "c_nationkey", F.lit(".c"), "c_custkey").alias("a"), F.concat(F.lit("app.n"), F.col("c_custkey") % 25, F.lit(".x")).alias("b"))
    return merging.bounded(pairs, read(spark, d, "nation").where("n_nationkey % 3 = 0").select(F.concat(F.lit("app.n"), "n_nationkey").alias("target")))


_OPS = "SELECT event_id AS seq, CASE WHEN event_type = 'signup' THEN 'INS' WHEN event_type = 'error' THEN 'REC' ELSE 'DEF' END AS op, 'app.g' || (user_id % 10) || '.u' || user_id AS target, 'agent' || (event_id % 5) AS agent FROM events"


def _ops(spark, d):
    e = read(spark, d, "events")
    op = F.when(F.col("event_type") == "signup", "INS").when(F.col("event_type") == "error", "REC").otherwise("DEF")
    return e.select(F.col("event_id").alias("seq"), op.alias("op"), F.concat(F.lit("app.g"), F.col("user_id") % 10, F.lit(".u"), "user_id").alias("target"), F.concat(F.lit("agent"), F.col("event_id") % 5).alias("agent"))


@book(f"WITH l AS ({_OPS}) SELECT target, min(seq) FILTER (WHERE op = 'DEF') AS seq FROM l GROUP BY 1 HAVING min(seq) FILTER (WHERE op = 'DEF') < coalesce(min(seq) FILTER (WHERE op = 'INS'), 1e18)")
def promoted_targets(spark, d):
    return merging.promoted(_ops(spark, d))


@book(f"WITH l AS ({_OPS}), c AS (SELECT target, arg_min(agent, seq) AS by FROM l GROUP BY 1) SELECT l.seq FROM l JOIN c USING (target) WHERE l.op = 'DEF' AND l.agent IN ('agent1', 'agent2') AND l.agent <> c.by")
def guarded_writes(spark, d):
    log = _ops(spark, d)
    creators = log.groupBy("target").agg(F.min_by("agent", "seq").alias("created_by"))
    power = spark.createDataFrame([(f"agent{i}", 5 + 8 * i) for i in range(5)], "agent string, level int")
    return merging.guarded(log, creators, power)[1].select("seq")


@book(f"SELECT target, count(*) AS recs FROM (SELECT regexp_replace(target, '\\.u[0-9]+$', '') AS target FROM ({_OPS}) WHERE op = 'REC') GROUP BY 1 HAVING count(*) >= 20")
def recurring_groups(spark, d):
    groups = read(spark, d, "events").select(F.concat(F.lit("app.g"), F.col("user_id") % 10).alias("target")).distinct()
    return merging.at_least_rec(_ops(spark, d), groups, 20)


@book(
    """WITH e AS (SELECT DISTINCT l_orderkey AS s, l_partkey + (CASE WHEN l_partkey % 40 = 0 THEN 1000000 ELSE 0 END) AS d FROM lineitem WHERE l_linenumber = 1), o AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 9 <> 0)
    SELECT 'o' || s AS target, 'asymmetric_con' AS type FROM e WHERE s % 7 = 0 UNION SELECT 'o' || s, 'orphan_con_source' FROM e WHERE s NOT IN (SELECT k FROM o) UNION SELECT 'p' || d, 'orphan_con_dest' FROM e WHERE d NOT IN (SELECT p_partkey FROM part)
    UNION SELECT 'o' || k, 'missing_ins' FROM o WHERE k % 11 = 0 UNION SELECT 'p' || p_partkey, 'missing_ins' FROM part UNION SELECT 'o' || k, 'stale_def' FROM o WHERE k % 13 = 0"""
)
def invariant_violations(spark, d):
    name = lambda prefix, c: F.concat(F.lit(prefix), c)
    li = read(spark, d, "lineitem").where("l_linenumber = 1")
    links = li.select(name("o", "l_orderkey").alias("source"), name("p", F.col("l_partkey") + F.when(F.col("l_partkey") % 40 == 0, 1_000_000).otherwise(0)).alias("dest"), "l_orderkey")
    k = F.col("o_orderkey")
    o = read(spark, d, "orders")
    log = o.where(k % 11 != 0).select(F.lit(1).cast("long").alias("seq"), F.lit("INS").alias("op"), name("o", k).alias("target")).unionByName(o.select((k + 10).alias("seq"), F.lit("DEF").alias("op"), name("o", k).alias("target")))
    made = o.where(k % 9 != 0).select(name("o", k).alias("target"), F.lit("DEF").alias("last_op"), F.when(k % 13 == 0, k).otherwise(k + 10).alias("last_seq"))
    parts = read(spark, d, "part").select(name("p", "p_partkey").alias("target"), F.lit("INS").alias("last_op"), F.lit(1).cast("long").alias("last_seq"))
    return merging.violations(log, made.unionByName(parts), links.drop("l_orderkey"), links.where("l_orderkey % 7 <> 0").drop("l_orderkey"))


@book(
    """WITH x AS (SELECT user_id, event_type AS field, arg_max(floor(value / 30), event_id) FILTER (WHERE event_id % 3 <> 0) AS ours, arg_max(floor(value / 30), event_id) AS theirs, count(*) FILTER (WHERE event_id % 3 <> 0) AS n FROM events GROUP BY 1, 2)
    SELECT user_id AS target, '_conflict.' || field AS field, CAST(ours AS BIGINT) AS ours, CAST(theirs AS BIGINT) AS theirs FROM x WHERE n > 0 AND ours <> theirs AND user_id IN (SELECT user_id FROM events WHERE event_id % 3 = 0)"""
)
def partition_conflicts(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").alias("target"), F.col("event_type").alias("field"), F.floor(F.col("value") / 30).alias("value"), "event_id")
    last = lambda df: df.groupBy("target", "field").agg(F.max_by("value", "event_id").alias("value"))
    return merging.conflicts(last(e.where("event_id % 3 <> 0")), last(e), e.where("event_id % 3 = 0")).drop("op")


@book("SELECT user_id AS target, round(avg(value), 6) AS value FROM events GROUP BY 1 HAVING count(*) >= 2 AND count(*) = count(value)")
def oscillation_means(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").alias("target"), F.col("value").cast("string").alias("value"))
    return merging.settled_means(e).withColumn("value", F.round("value", 6))


@book(
    """WITH c AS (SELECT p_partkey AS a, p_partkey + 1 AS b, CASE WHEN p_size > 40 THEN 'auto' WHEN p_size > 20 THEN 'pending' ELSE 'rejected' END AS decision FROM part) SELECT a, b, CASE WHEN decision = 'pending' AND a % 3 = 0 THEN 'approved'
    WHEN decision = 'pending' AND a % 3 = 1 THEN 'rejected' ELSE decision END AS decision FROM c"""
)
def reviewed_candidates(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    p = read(spark, d, "part")
    compared = p.select(k.alias("a"), (k + 1).alias("b"), F.when(size > 40, "auto").when(size > 20, "pending").otherwise("rejected").alias("decision"))
    return merging.reviewed(compared, p.where(k % 3 != 2).select(k.alias("a"), (k + 1).alias("b"), (k % 3 == 0).alias("approve")))[0].select("a", "b", "decision")


@book(
    """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'Sales Order' ELSE c_mktsegment END AS name, CASE WHEN c_custkey % 3 = 0 THEN 'unknown' ELSE 'u' || c_custkey END AS agent,
    CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE '@u' || c_custkey || ':host' END AS user_id, CASE WHEN c_custkey % 3 = 1 THEN 'd1' END AS device_id FROM customer"""
)
def display_names(spark, d):
    k = F.col("c_custkey")
    agent = F.when(k % 3 == 1, F.concat(F.lit("@u"), k, F.lit(":host|d1"))).when(k % 3 == 2, F.concat(F.lit("@u"), k, F.lit(":host")))
    segment = F.when(F.col("c_mktsegment") == "BUILDING", "tblSalesOrder").otherwise(F.concat(F.lit("fld"), "c_mktsegment"))
    both = display.user_and_device(agent)
    return read(spark, d, "customer").select("c_custkey", display.name(segment).alias("name"), display.short_agent(agent).alias("agent"), both["user_id"].alias("user_id"), both["device_id"].alias("device_id"))


@book(
    """SELECT event_id, CASE WHEN s < 60 THEN s || 's ago' WHEN s < 3600 THEN s // 60 || 'm ago' WHEN s < 86400 THEN s // 3600 || 'h ago' WHEN s < 2592000 THEN s // 86400 || 'd ago' ELSE strftime(ts, '%b %-d, %Y') END AS ago, strftime(ts, '%H:%M') AS moment
    FROM (SELECT *, (SELECT max(CAST(floor(epoch(ts)) AS BIGINT)) FROM events) - CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)"""
)
def event_ages(spark, d):
    e = read(spark, d, "events")
    now = e.agg(F.max("ts")).first()[0]
    return e.select("event_id", display.ago(F.col("ts"), F.lit(now)).alias("ago"), display.adaptive(F.col("ts"), 20_000).alias("moment"))


@book(
    """SELECT p_partkey, '{"brand":"' || p_brand || '","name":"' || p_name || '\\"' || '","size":' || CASE WHEN p_size % 5 = 0 THEN 'null' ELSE '"' || p_size || '"' END || '}' AS canonical,
    CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_brand END AS shown FROM part"""
)
def canonical_parts(spark, d):
    size = F.when(F.col("p_size") % 5 != 0, F.col("p_size").cast("string"))
    value = F.create_map(F.lit("size"), size, F.lit("name"), F.concat("p_name", F.lit('"')), F.lit("brand"), F.col("p_brand"))
    nested = F.when(F.col("p_size") % 2 == 0, F.to_json(F.struct(F.struct(F.col("p_name").alias("x")).alias("fields"), F.col("p_brand").alias("x")))).otherwise(F.to_json(F.struct(F.col("p_brand").alias("x"))))
    return read(spark, d, "part").select("p_partkey", display.canonical(value).alias("canonical"), display.field(nested, "x").alias("shown"))


_H31 = "list_reduce(list_prepend(CAST(0 AS HUGEINT), list_transform(string_split(t, ''), lambda c: CAST(ord(c) AS HUGEINT))), lambda h, x: (h * 31 + x) % 4294967296)"


@book(f"SELECT k, 'system.rec.' || lpad(lower(printf('%x', CAST({_H31} AS BIGINT))), 8, '0') AS target, substr(sha256('a' || chr(31) || k), 1, 32) AS id FROM (SELECT c_custkey AS k, 'app.' || c_mktsegment || '|' || 'app.c' || c_custkey AS t FROM customer)")
def derived_targets(spark, d):
    parts = F.array(F.concat(F.lit("app.c"), "c_custkey"), F.concat(F.lit("app."), "c_mktsegment"))
    return read(spark, d, "customer").select(F.col("c_custkey").alias("k"), display.derived_target(parts).alias("target"), display.derived_id(F.lit("a"), F.col("c_custkey")).alias("id"))


@book("SELECT column_name AS field FROM (DESCRIBE lineitem) WHERE NOT (column_name = 'l_tax' OR regexp_matches(column_name, 'key$') OR regexp_matches(column_name, '^l_ret'))")
def kept_fields(spark, d):
    names = spark.createDataFrame([(c,) for c in read(spark, d, "lineitem").columns], "field string")
    return names.where(~display.excluded(F.col("field"), F.col("field"), ("l_tax",), ("key$", "^l_ret")))


@book("SELECT p_partkey FROM part WHERE p_size % 4 IN (0) AND p_name ILIKE '%e%'")
def bound_parts(spark, d):
    p = read(spark, d, "part").withColumn("rest", F.col("p_size") % 4)
    return records.bound(p, [("rest", "is_empty"), ("p_name", "contains", "e")]).select("p_partkey")


@book("SELECT DISTINCT p_brand AS value FROM part WHERE lower(p_brand) LIKE 'brand#1%' ORDER BY 1 LIMIT 8")
def completed_values(spark, d):
    return records.completions(read(spark, d, "part"), "p_brand", "BRAND#1")


@book("SELECT 'f' || (p_partkey % 5) AS field, count(*) FILTER (WHERE p_partkey % 3 < 2) AS n_def, CAST(max(CASE WHEN p_partkey % 3 = 2 THEN 1 ELSE 0 END) AS BIGINT) AS n_eva FROM part GROUP BY 1")
def schema_summary(spark, d):
    k = F.col("p_partkey")
    kind = F.when(k % 3 == 0, "type").when(k % 3 == 1, F.concat(F.lit("constraint."), k)).otherwise("resolve")
    state = read(spark, d, "part").select(F.concat(F.lit("app.part._schema.f"), k % 5, F.lit("."), kind).alias("target"))
    return records.schema_rules(state, "app.part")


@book("SELECT DISTINCT l_orderkey AS source, l_partkey AS dest FROM lineitem WHERE l_orderkey % 50 = 0 OR l_partkey % 97 = 0")
def touched_links(spark, d):
    li = read(spark, d, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("dest")).distinct()
    chosen = read(spark, d, "orders").where("o_orderkey % 50 = 0").select(F.concat(F.lit("o"), "o_orderkey").alias("node")).unionByName(read(spark, d, "part").where("p_partkey % 97 = 0").select(F.concat(F.lit("p"), "p_partkey").alias("node")))
    out = graph.touching(li, chosen)
    return out.select(F.substring("source", 2, 20).cast("long").alias("source"), F.substring("dest", 2, 20).cast("long").alias("dest"))


@book(
    """WITH s AS (SELECT op, field, count(*) AS n FROM (SELECT 'INS' AS op, unnest(['o_orderkey', 'o_custkey', 'o_orderstatus']) AS field FROM orders UNION ALL SELECT 'INS', unnest(['c_custkey', 'c_mktsegment']) FROM customer
    UNION ALL SELECT 'CON', 'o_custkey' FROM orders JOIN customer ON c_custkey = o_custkey UNION ALL SELECT 'DEF', 'link' UNION ALL SELECT 'DEF', 'o_orderstatus' FROM orders UNION ALL SELECT 'DEF', 'c_mktsegment' FROM customer) GROUP BY 1, 2) SELECT * FROM s"""
)
def keyed_import(spark, d):
    prefixed = lambda c, p: F.concat(F.lit(p), c)
    o = read(spark, d, "orders").select(prefixed("o_orderkey", "ORD-").alias("o_orderkey"), prefixed("o_custkey", "CUS-").alias("o_custkey"), "o_orderstatus")
    c = read(spark, d, "customer").select(prefixed("c_custkey", "CUS-").alias("c_custkey"), "c_mktsegment")
    long = long_form(o, "orders", "o_orderkey").unionByName(long_form(c, "customer", "c_custkey"))
    return edges.keyed_events(long).groupBy("op", "field").agg(F.count("*").alias("n"))


@book("SELECT n_name || ' x' AS subject, 'located in' AS predicate, r_name AS object FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT r_name, 'holds', n_name FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 2 = 0")
def parsed_triples(spark, d):
    n = read(spark, d, "nation").join(read(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    first = F.concat(F.lit("<s>noise <triplet> "), "n_name", F.lit("  x <subj> "), "r_name", F.lit(" <obj> located in"))
    second = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit(" <triplet> "), "r_name", F.lit(" <subj> "), "n_name", F.lit(" <obj> holds</s>"))).otherwise(F.lit(" <triplet> lacks <subj> an end </s><pad>"))
    return n.select(F.explode(display.triples(F.concat(first, second))).alias("t")).select("t.*")


@book(
    """WITH v AS (SELECT vec_id, list_reverse(CAST(embedding AS DOUBLE[])) AS e FROM embeddings) SELECT vec_id, round(-e[1] / sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS first,
    round(-e[64] / sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS last FROM v"""
)
def aligned_vectors(spark, d):
    turn = [[-1.0 if i + j == 63 else 0.0 for j in range(64)] for i in range(64)]
    out = vectors.aligned(read(spark, d, "embeddings"), turn)
    return out.select("vec_id", F.round(F.col("embedding")[0], 6).alias("first"), F.round(F.col("embedding")[63], 6).alias("last"))


QUERIES, ORACLE = book.queries, book.sql
