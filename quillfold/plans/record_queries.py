"""Queries over the star-schema tables, read as collections of records."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillfold.functions import similarity as S
from quillfold.operators import analytics, dedup, edges, formulas, graph, horizon, pairs, records, segments, sync, vectors
from quillfold.plans.registry import Book, read
from quillfold.sources.records import collection, long_form

book = Book()


@book(
    """SELECT c_name, c_acctbal FROM customer WHERE lower(c_mktsegment) = 'building' AND c_acctbal > 0
    ORDER BY c_acctbal DESC, c_name LIMIT 10"""
)
def sql_filter_topk(spark, d):
    return records.select(read(spark, d, "customer"), ["c_name", "c_acctbal"], [("c_mktsegment", "equals", "Building"), ("c_acctbal", "gt", 0)], order_by=[("c_acctbal", True), ("c_name", False)], limit=10)


@book("SELECT target, depth FROM (SELECT 'app.orders.' || o_orderkey AS target, 3 AS depth, o_orderstatus AS s, o_totalprice AS p FROM orders) WHERE s = 'F' AND p > 300000")
def path_filter(spark, d):
    # filtered as columns, so that the scan can do it, and made targets then
    hit = records.select(read(spark, d, "orders"), ["o_orderkey"], [("o_orderstatus", "equals", "f"), ("o_totalprice", "gt", 300000)])
    return records.hierarchy(collection(hit, "orders", "o_orderkey"), "app.orders").select("target", F.lit(3).alias("depth"))


@book("SELECT p_partkey, p_name FROM part WHERE lower(p_brand) = 'brand#2' AND lower(p_type) = 'economy' ")
def equality_filter(spark, d):
    return records.select(read(spark, d, "part"), ["p_partkey", "p_name"], [("p_brand", "equals", "BRAND#2"), ("p_type", "equals", "economy")])


@book(
    """SELECT p_partkey, p_name FROM part WHERE (lower(p_name) = 'red widget' OR lower(p_name) LIKE '%ring%' OR lower(p_type) LIKE 'sma%' OR p_size >= 49 OR p_size < 3
    OR lower(p_brand) LIKE '%#7')"""
)
def rule_filters_any(spark, d):
    rules = [("p_name", "equals", "Red Widget"), ("p_name", "contains", "RING"), ("p_type", "starts_with", "sma"), ("p_size", "gte", 49), ("p_size", "lt", 3), ("p_brand", "ends_with", "#7")]
    return records.select(read(spark, d, "part"), ["p_partkey", "p_name"], rules, any_of=True)


@book(
    """SELECT p_partkey FROM part WHERE lower(p_name) <> 'red widget' AND lower(p_name) NOT LIKE '%ring%' AND p_size <= 20 AND p_size > 5 AND p_type IS NOT NULL AND p_type <> ''
    AND p_name ILIKE '%w_dg%'"""
)
def rule_filters_all(spark, d):
    rules = [("p_name", "not_equals", "Red Widget"), ("p_name", "not_contains", "ring"), ("p_size", "lte", 20), ("p_size", "gt", 5), ("p_type", "is_not_empty"), ("p_name", "like", "%w_dg%")]
    return records.select(read(spark, d, "part"), ["p_partkey"], rules)


@book("SELECT c_custkey FROM customer WHERE lower(c_name) LIKE '%00012%' OR lower(c_mktsegment) LIKE '%00012%' OR CAST(c_custkey AS VARCHAR) LIKE '%00012%'")
def free_text(spark, d):
    return records.free_text(read(spark, d, "customer"), "00012", ["c_name", "c_mktsegment", "c_custkey"]).select("c_custkey")


@book("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate <= TIMESTAMP '1997-03-31'")
def time_range(spark, d):
    o = read(spark, d, "orders")
    return records.time_range(o, "o_orderdate", F.lit("1997-01-01").cast("timestamp"), F.lit("1997-03-31").cast("timestamp")).select("o_orderkey")


@book("SELECT 'app.part.' || p_partkey AS target FROM part WHERE 'app.part.' || p_partkey > 'app.part.15' ORDER BY target LIMIT 50")
def keyset_page(spark, d):
    return records.page(collection(read(spark, d, "part"), "part", "p_partkey"), "app.part", "app.part.15", 50).select("target")


@book(
    """SELECT target, CASE WHEN target = 'app.part.1' THEN 100 WHEN target LIKE 'app.part.1%' THEN 80 ELSE 40 END AS score FROM (SELECT 'app.part.' || p_partkey AS target FROM part)
    WHERE target LIKE '%app.part.1%' ORDER BY score DESC, length(target), target LIMIT 20"""
)
def target_suggestions(spark, d):
    return records.suggest_targets(collection(read(spark, d, "part"), "part", "p_partkey"), "app.part.1")


@book("SELECT unnest(['o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) AS field")
def field_suggestions(spark, d):
    return records.field_names(collection(read(spark, d, "orders"), "orders", "o_orderkey"))


@book(
    """SELECT field, type, CAST(n AS BIGINT) AS n, CAST(distinct_values AS BIGINT) AS distinct_values FROM (
    SELECT 'o_orderstatus' AS field, 'select' AS type, count(o_orderstatus) AS n, count(DISTINCT o_orderstatus) AS distinct_values FROM orders UNION ALL
    SELECT 'o_totalprice', 'number', count(o_totalprice), count(DISTINCT o_totalprice) FROM orders UNION ALL
    SELECT 'o_orderdate', 'date', count(o_orderdate), count(DISTINCT o_orderdate) FROM orders UNION ALL
    SELECT 'o_custkey', 'number', count(o_custkey), count(DISTINCT o_custkey) FROM orders)"""
)
def column_types(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_custkey")
    long = long_form(o, "orders", "o_orderkey").where("field <> 'o_orderkey'")
    return records.infer_columns(long)


@book(
    """SELECT count(*) AS n, count(DISTINCT l_returnflag) AS flags, round(sum(l_extendedprice), 2) AS total, round(avg(l_quantity), 6) AS mean_quantity, min(l_discount) AS least,
    max(l_discount) AS most, count(*) FILTER (WHERE l_returnflag = 'R') AS returned FROM lineitem"""
)
def metric_cards(spark, d):
    cards = {"n": ("count",), "flags": ("count_distinct", "l_returnflag"), "total": ("sum", "l_extendedprice"), "mean_quantity": ("avg", "l_quantity"), "least": ("min", "l_discount"), "most": ("max", "l_discount"), "returned": ("count", None, ("l_returnflag", "equals", "R"))}
    out = analytics.metric_cards(read(spark, d, "lineitem"), cards)
    return out.withColumn("total", F.round("total", 2)).withColumn("mean_quantity", F.round("mean_quantity", 6))


@book(
    """SELECT l_returnflag, round(sum(CAST(CAST(l_discount AS FLOAT) AS DOUBLE)), 4) AS sum, round(avg(CAST(CAST(l_discount AS FLOAT) AS DOUBLE)), 6) AS avg, count(*) FILTER (WHERE l_discount <> 0) AS count
    FROM lineitem GROUP BY 1"""
)
def formula_aggregates(spark, d):
    return analytics.formula_aggregates(read(spark, d, "lineitem"), "l_returnflag", "l_discount").select("l_returnflag", F.round("sum", 4).alias("sum"), F.round("avg", 6).alias("avg"), "count")


@book("SELECT o_orderpriority AS type, count(*) AS n FROM orders GROUP BY 1")
def type_counts(spark, d):
    return analytics.type_counts(read(spark, d, "orders"), "o_orderpriority")


@book(
    """WITH opt(option, place) AS (VALUES ('(none)', 0), ('O', 1), ('F', 2), ('X', 3)), r AS (SELECT CASE WHEN o_orderstatus IN ('O', 'F', 'X') THEN o_orderstatus ELSE '(none)' END AS option, o_orderkey FROM orders)
    SELECT opt.option, opt.place, count(r.o_orderkey) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM opt LEFT JOIN r ON opt.option = r.option GROUP BY 1, 2"""
)
def kanban_groups(spark, d):
    return analytics.kanban(read(spark, d, "orders"), "o_orderstatus", ["O", "F", "X"], "o_orderkey")


@book("SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders GROUP BY 1")
def calendar_days(spark, d):
    return analytics.calendar(read(spark, d, "orders").withColumn("o_orderdate", F.date_trunc("day", "o_orderdate")), "o_orderdate", "o_orderkey").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@book(
    """SELECT c_custkey, round((c_acctbal - m) / s, 6) AS z, abs((c_acctbal - m) / s) > 1.5 AS outlier FROM customer JOIN (SELECT c_nationkey, avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s, count(*) AS n
    FROM customer GROUP BY 1) USING (c_nationkey) WHERE n >= 3 AND s > 0"""
)
def zscore_signals(spark, d):
    out = analytics.z_scores(read(spark, d, "customer"), "c_nationkey", "c_acctbal")
    return out.where("z is not null").select("c_custkey", F.round("z", 6).alias("z"), "outlier")


@book("SELECT p_brand, p_type, count(*) AS members, min(p_partkey) AS first, max(p_partkey) AS last FROM part GROUP BY 1, 2 HAVING count(*) >= 5")
def cohorts(spark, d):
    return analytics.cohorts(read(spark, d, "part"), ["p_brand", "p_type"], "p_partkey", 5).drop("cohort")


_SUPPLY = "SELECT DISTINCT 'part.' || l_partkey AS source, 'supplier.' || l_suppkey AS dest FROM lineitem"


def _supply(spark, d):
    return read(spark, d, "lineitem").select(F.concat(F.lit("part."), "l_partkey").alias("source"), F.concat(F.lit("supplier."), "l_suppkey").alias("dest")).distinct()


@book(
    f"""WITH e AS ({_SUPPLY}), n AS (SELECT source AS node, 1 AS o FROM e UNION ALL SELECT dest, 0 FROM e) SELECT node, CAST(sum(1 - o) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree,
    count(*) AS degree, CASE WHEN count(*) >= 6 THEN 'hub' ELSE 'leaf' END AS role FROM n GROUP BY 1"""
)
def edge_metrics(spark, d):
    return graph.degrees(_supply(spark, d)).select("node", "in_degree", "out_degree", "degree", "role")


@book(f"WITH e AS ({_SUPPLY}), n AS (SELECT source AS node FROM e UNION SELECT dest FROM e) SELECT n.node, count(e.dest) AS out_degree, round(count(e.dest) / ((SELECT count(*) FROM n) - 1.0), 9) AS centrality FROM n LEFT JOIN e ON e.source = n.node GROUP BY 1")
def centrality(spark, d):
    return graph.centrality(_supply(spark, d)).withColumn("centrality", F.round("centrality", 9))


_TREE = """SELECT 'region.' || n_regionkey AS source, 'nation.' || n_nationkey AS dest FROM nation UNION ALL SELECT 'nation.' || c_nationkey, 'customer.' || c_custkey FROM customer
UNION ALL SELECT 'customer.' || o_custkey, 'order.' || o_orderkey FROM orders"""


def _tree(spark, d):
    def link(t, a, ka, b, kb):
        return read(spark, d, t).select(F.concat(F.lit(f"{a}."), ka).alias("source"), F.concat(F.lit(f"{b}."), kb).alias("dest"))

    return link("nation", "region", "n_regionkey", "nation", "n_nationkey").unionByName(link("customer", "nation", "c_nationkey", "customer", "c_custkey")).unionByName(link("orders", "customer", "o_custkey", "order", "o_orderkey"))


@book(
    f"""WITH RECURSIVE e AS ({_TREE}), w(node, distance) AS (SELECT 'region.1', 0 UNION ALL SELECT e.dest, w.distance + 1 FROM w JOIN e ON e.source = w.node WHERE w.distance < 3)
    SELECT node, CAST(min(distance) AS INTEGER) AS distance FROM w GROUP BY 1"""
)
def traverse(spark, d):
    return graph.traverse(_tree(spark, d), spark.createDataFrame([("region.1",)], "node string"), 3)


@book(f"WITH e AS ({_TREE}) SELECT DISTINCT e2.dest AS node, 2 AS distance FROM e e1 JOIN e e2 ON e2.source = e1.source WHERE e1.dest = 'nation.3' AND e2.dest <> 'nation.3'")
def siblings(spark, d):
    both = graph.traverse(_tree(spark, d), spark.createDataFrame([("nation.3",)], "node string"), 1, "reverse").where("distance = 1").select("node")
    return graph.traverse(_tree(spark, d), both, 1).where("distance = 1 and node <> 'nation.3'").select("node", F.lit(2).alias("distance"))


@book(
    """WITH RECURSIVE e AS (SELECT DISTINCT c_nationkey AS source, 100 + c_nationkey % 5 AS dest FROM customer), b AS (SELECT source, dest FROM e UNION SELECT dest, source FROM e),
    r(node, x) AS (SELECT source, source FROM b UNION SELECT r.node, b.dest FROM r JOIN b ON r.x = b.source) SELECT CAST(node AS BIGINT) AS node, CAST(min(x) AS BIGINT) AS component FROM r GROUP BY 1"""
)
def components(spark, d):
    e = read(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("source"), (F.col("c_nationkey") % 5 + 100).cast("long").alias("dest")).distinct()
    return graph.components(e)


@book(
    """SELECT o_custkey, count(*) AS n_items, round(sum(l_extendedprice), 2) AS spent FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey
    WHERE lower(c_mktsegment) = 'building' AND o_orderstatus = 'F' GROUP BY 1"""
)
def field_chain(spark, d):
    customers = read(spark, d, "customer").where(records.predicate(F.col("c_mktsegment"), "equals", "building")).select(F.col("c_custkey").alias("o_custkey"))
    orders = read(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey").join(customers, "o_custkey", "left_semi")
    items = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_extendedprice")
    return orders.join(items, "o_orderkey").groupBy("o_custkey").agg(F.count("*").alias("n_items"), F.round(F.sum("l_extendedprice"), 2).alias("spent"))


@book(
    """WITH t AS (SELECT p_partkey AS id, p_brand || '|' || p_type || '|' || p_size AS k FROM part) SELECT a.id AS a, b.id AS b FROM t a JOIN t b ON a.k = b.k AND a.id < b.id"""
)
def nearby_traits(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat("p_brand", F.lit("|"), "p_type", F.lit("|"), "p_size").alias("k"))
    return pairs.within(p, ["k"], "id")


@book(
    """SELECT p_partkey AS id, min(p_partkey) OVER (PARTITION BY list_aggregate(list_sort(string_split(lower(p_name), ' ')), 'string_agg', ' ')) AS class,
    count(*) OVER (PARTITION BY list_aggregate(list_sort(string_split(lower(p_name), ' ')), 'string_agg', ' ')) AS members FROM part"""
)
def key_block_classes(spark, d):
    return dedup.key_classes(read(spark, d, "part").withColumnRenamed("p_partkey", "id"), ["p_name"])


@book(
    """WITH r AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY lower(c_mktsegment) || '|' || regexp_replace(lower(c_name), '[^a-z0-9 ]', '', 'g'), c_custkey) AS n FROM customer)
    SELECT least(a.id, b.id) AS a, greatest(a.id, b.id) AS b FROM r a JOIN r b ON b.n BETWEEN a.n + 1 AND a.n + 2"""
)
def sorted_neighbourhood(spark, d):
    return dedup.sorted_neighbourhood(read(spark, d, "customer").withColumnRenamed("c_custkey", "id"), ["c_mktsegment", "c_name"], 3)


#: Every name of a part whose key is divisible by 50, against all names.
_PAIRS = "WITH n AS (SELECT DISTINCT p_name AS x FROM part), q AS (SELECT DISTINCT p_name AS x FROM part WHERE p_partkey % 50 = 0) SELECT a.x AS a, b.x AS b, "
_PAIRS_END = " FROM q a JOIN n b ON a.x <> b.x"
_BLOCKS = 16


def _name_pairs(spark, d):
    """The query set goes to every block of names, so each block meets it once."""
    part = read(spark, d, "part")
    names = part.select(F.col("p_name").alias("b")).distinct().withColumn("block", F.pmod(F.xxhash64("b"), F.lit(_BLOCKS)))
    asked = part.where("p_partkey % 50 = 0").select(F.col("p_name").alias("a")).distinct().select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_BLOCKS - 1).cast("long"))).alias("block"))
    return asked.join(names, "block").where("a <> b").select("a", "b")


@book(_PAIRS + "round(1 - levenshtein(lower(a.x), lower(b.x)) / greatest(length(a.x), length(b.x)), 9) AS score" + _PAIRS_END)
def sim_levenshtein(spark, d):
    return _name_pairs(spark, d).withColumn("score", F.round(S.levenshtein(F.col("a"), F.col("b")), 9))


_SETS = "list_distinct(string_split(lower(a.x), ' ')), list_distinct(string_split(lower(b.x), ' '))"


@book(_PAIRS + f"round(len(list_intersect({_SETS})) / len(list_distinct(list_concat({_SETS}))), 9) AS score" + _PAIRS_END)
def sim_jaccard(spark, d):
    return _name_pairs(spark, d).withColumn("score", F.round(S.jaccard(F.col("a"), F.col("b")), 9))


@book(_PAIRS + f"round(2 * len(list_intersect({_SETS})) / (len(list_distinct(string_split(lower(a.x), ' '))) + len(list_distinct(string_split(lower(b.x), ' ')))), 9) AS score" + _PAIRS_END)
def sim_dice(spark, d):
    return _name_pairs(spark, d).withColumn("score", F.round(S.dice(F.col("a"), F.col("b")), 9))


@book()
def sim_alignments(spark, d):
    a, b = F.col("a"), F.col("b")
    return _name_pairs(spark, d).select("a", "b", *(F.round(fn(a, b), 6).alias(n) for n, fn in (("osa", S.osa), ("jaro_winkler", S.jaro_winkler), ("affine_gap", S.affine_gap), ("smith_waterman", S.smith_waterman), ("cosine", S.tfidf_cosine))))


@book()
def phonetic_keys(spark, d):
    return read(spark, d, "part").select("p_name").distinct().select("p_name", S.soundex(F.col("p_name")).alias("soundex"), S.metaphone(F.col("p_name")).alias("metaphone"), S.ngram_fingerprint(F.col("p_name")).alias("ngrams"))


@book()
def dedup_classify(spark, d):
    parts = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", F.lower("p_type")).alias("name"), "p_brand")
    single = graph.settled(parts.groupBy("name", "p_brand").agg(F.min("id").alias("id")))  # read by each rule and by the comparison
    found = dedup.union_pairs(dedup.lsh_pairs(single, ["name", "p_brand"]), dedup.sorted_neighbourhood(single, ["name"], 3))
    how = dedup.Matching((dedup.Comparison("name", "jaccard", 2.0), dedup.Comparison("p_brand", "exact")), 0.9, 0.6)
    return dedup.compare(found, single, how).select("a", "b", F.round("score", 6).alias("score"), "decision")


_LONG = " UNION ALL ".join(f"SELECT 'orders' AS c, '{f}' AS f, CAST({f} AS VARCHAR) AS v FROM orders" for f in ("o_orderkey", "o_custkey"))


@book(
    """SELECT * FROM (SELECT 'customer' AS collection, 'c_custkey' AS field, 'number' AS pattern, count(*) AS records FROM customer UNION ALL
    SELECT 'orders', 'o_orderkey', 'number', count(*) FROM orders)"""
)
def id_fields(spark, d):
    long = long_form(read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "orders", "o_orderkey").unionByName(long_form(read(spark, d, "customer").select("c_custkey", "c_nationkey"), "customer", "c_custkey"))
    return edges.id_fields(long)


@book(
    """SELECT 'orders' AS collection, 'o_custkey' AS field, target, count(*) AS n, round(count(*) / (SELECT count(*) FROM orders), 9) AS share FROM orders
    JOIN (SELECT 'customer' AS target, c_custkey AS id FROM customer UNION ALL SELECT 'orders', o_orderkey FROM orders) i ON i.id = o_custkey GROUP BY 3"""
)
def fk_detect(spark, d):
    long = long_form(read(spark, d, "orders").select("o_orderkey", "o_custkey"), "orders", "o_orderkey").unionByName(long_form(read(spark, d, "customer").select("c_custkey"), "customer", "c_custkey"))
    return edges.references(long, edges.id_fields(long)).select("collection", "field", "target", "n", F.round("share", 9).alias("share"))


@book(
    """WITH i AS (SELECT DISTINCT l_orderkey AS g, l_suppkey AS s FROM lineitem) SELECT a.s AS a, b.s AS b, count(*) AS n FROM i a JOIN i b ON a.g = b.g AND a.s < b.s GROUP BY 1, 2 HAVING count(*) >= 3"""
)
def co_occurrence(spark, d):
    return edges.co_occurrence(read(spark, d, "lineitem"), "l_orderkey", "l_suppkey", 3)


@book(
    """SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings
    ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) DESC, vec_id LIMIT 20"""
)
def cosine_topk(spark, d):
    e = read(spark, d, "embeddings")
    query = e.where("vec_id = 0").select("embedding").first()[0]
    return vectors.top_k(e, query, 20).select("vec_id", F.round("score", 6).alias("score"))


@book(
    """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), u AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e),
    m AS (SELECT label, i, avg(x) AS x FROM u GROUP BY 1, 2), c AS (SELECT CAST(label AS VARCHAR) AS label, list(x ORDER BY i) AS v FROM m GROUP BY 1),
    s AS (SELECT vec_id, c.label AS best, list_cosine_similarity(e.v, c.v) AS score FROM e, c),
    r AS (SELECT *, row_number() OVER w AS place, lead(score) OVER w AS second FROM s WINDOW w AS (PARTITION BY vec_id ORDER BY score DESC, best DESC))
    SELECT vec_id, best, round(score, 6) AS score, coalesce(score - second, 1.0) < 0.02 AS boundary FROM r WHERE place = 1"""
)
def centroid_classify(spark, d):
    e = read(spark, d, "embeddings")
    return vectors.classify(e, vectors.centroids(e, "label"), "label").select("vec_id", "best", F.round("score", 6).alias("score"), "boundary")


@book("SELECT doc_id, count(*) AS n FROM (SELECT doc_id, trim(unnest(string_split_regex(text, '\\n+')), ' ') AS t FROM documents) WHERE length(t) >= 20 GROUP BY 1")
def paragraphs(spark, d):
    return segments.paragraphs(read(spark, d, "documents")).groupBy("doc_id").agg(F.count("*").alias("n"))


@book()
def clause_parents(spark, d):
    docs = read(spark, d, "documents")
    return segments.parents(segments.spans(docs, "clause").drop("text"), segments.spans(docs, "sentence")).select("doc_id", "n", "parent", "start", "end")


@book("SELECT 'app.customer' AS node, count(*) AS below, count(*) AS children, 3 AS deepest FROM customer UNION ALL SELECT 'app', count(*), 0, 3 FROM customer")
def tree_roll_up(spark, d):
    return analytics.tree_roll_up(collection(read(spark, d, "customer"), "customer", "c_custkey"))


@book("SELECT c_custkey, c_name, CASE WHEN c_acctbal IS NOT NULL THEN 'REDACTED' END AS c_acctbal FROM customer")
def redacted(spark, d):
    return records.redact(read(spark, d, "customer"), {"c_acctbal": "redacted", "c_nationkey": "hidden", "c_mktsegment": "hidden"})


_SHARED = """WITH s AS (SELECT x.p_partkey AS a, y.p_partkey AS b, CAST((x.p_brand = y.p_brand)::INT + (x.p_type = y.p_type)::INT + (x.p_size = y.p_size)::INT + (x.p_name = y.p_name)::INT AS INTEGER) AS shared
    FROM part x JOIN part y ON x.p_partkey <> y.p_partkey)
    SELECT a AS p_partkey, b AS other, shared, greatest(1, 4 - shared + 1) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY shared DESC, b) AS n FROM s WHERE shared > 0) WHERE n <= """


@book(_SHARED + "3")
def nearby_records(spark, d):
    return horizon.nearby(read(spark, d, "part"), ["p_brand", "p_type", "p_size", "p_name"], "p_partkey", 3)


@book(_SHARED + "10")
def nearby_records_all(spark, d):
    return horizon.nearby(read(spark, d, "part"), ["p_brand", "p_type", "p_size", "p_name"], "p_partkey", 10)


@book("SELECT 'app.region.r' || n_regionkey || '.n' || n_nationkey AS target, 'app.region.r' || n_regionkey AS ancestor, 1 AS distance, count(*) OVER (PARTITION BY n_regionkey) AS children, count(*) OVER (PARTITION BY n_regionkey) - 1 AS siblings FROM nation")
def ancestry(spark, d):
    state = read(spark, d, "nation").select(F.concat(F.lit("app.region.r"), "n_regionkey", F.lit(".n"), "n_nationkey").alias("target"))
    return horizon.ancestry(state).where("distance = 1")


@book(
    """SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS gross, round(sqrt(abs(l_extendedprice * (1 - l_discount))), 6) AS root
    FROM lineitem"""
)
def formula_fields(spark, d):
    out = formulas.evaluate(read(spark, d, "lineitem"), {"gross": "net * (1 + l_tax)", "net": "l_extendedprice * (1 - l_discount)", "root": "sqrt(abs(net))"})
    return out.select("l_orderkey", "l_linenumber", F.round("net", 4).alias("net"), F.round("gross", 6).alias("gross"), F.round("root", 6).alias("root"))


@book("SELECT c_nationkey, c_mktsegment, count(DISTINCT c_custkey % 11) AS peers FROM customer GROUP BY 1, 2 HAVING count(DISTINCT c_custkey % 11) >= 3")
def quorum(spark, d):
    return sync.quorum(read(spark, d, "customer").withColumn("peer", F.col("c_custkey") % 11), "c_nationkey", "c_mktsegment", "peer", 3)


@book("SELECT l_partkey, count(DISTINCT l_suppkey) AS available FROM lineitem GROUP BY 1")
def rarest_first(spark, d):
    return sync.rarest_first(read(spark, d, "lineitem"), "l_partkey", "l_suppkey")


QUERIES, ORACLE = book.queries, book.sql
