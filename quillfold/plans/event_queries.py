"""Queries over the events table, read as a log of writes to its users."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfold.operators import analytics, fold, records, worlds
from quillfold.plans.registry import Book, read

book = Book()

#: The events as a log: a user's first event creates it, some replace its value, the others set one field and k.
LOG = """SELECT event_id AS seq, CASE WHEN event_id = min(event_id) OVER (PARTITION BY user_id) THEN 'INS' WHEN event_id % 16 = 0 THEN 'SEG' WHEN event_id % 16 = 1 THEN 'EVA' ELSE 'DEF' END AS op,
'app.users.u' || user_id AS target, event_type AS field, CAST(value AS VARCHAR) AS value, json_extract_string(props, '$.k') AS k, ts, 'agent' || (event_id % 5) AS agent, user_id FROM events"""


def event_log(spark, d) -> DataFrame:
    e = read(spark, d, "events")
    first = e.groupBy("user_id").agg(F.min("event_id").alias("_first"))
    op = F.when(F.col("event_id") == F.col("_first"), "INS").when(F.col("event_id") % 16 == 0, "SEG").when(F.col("event_id") % 16 == 1, "EVA").otherwise("DEF")
    operand = F.create_map(F.col("event_type"), F.col("value").cast("string"), F.lit("k"), F.get_json_object("props", "$.k"))
    return e.join(first, "user_id").select(
        F.col("event_id").alias("seq"), op.alias("op"), F.concat(F.lit("app.users.u"), "user_id").alias("target"), operand.alias("operand"), F.concat(F.lit("agent"), F.col("event_id") % 5).alias("agent"), "ts", "event_type", "value", "user_id"
    )


_FIELDS = f"""l AS ({LOG}), r AS (SELECT target, max(seq) AS since FROM l WHERE op <> 'DEF' GROUP BY 1), w AS (SELECT target, seq, field, value FROM l UNION ALL SELECT target, seq, 'k', k FROM l),
f AS (SELECT w.target, w.field, arg_max(w.value, w.seq) AS value, max(w.seq) AS seq FROM w JOIN r USING (target) WHERE w.seq >= since GROUP BY 1, 2)"""


@book(f"WITH {_FIELDS} SELECT target, field, value, seq FROM f")
def state_lww(spark, d):
    return fold.last_writes(event_log(spark, d))


@book(f"WITH l AS ({LOG}) SELECT target, arg_max(op, seq) AS last_op, arg_max(agent, seq) AS last_agent, max(seq) AS last_seq, 3 AS depth FROM l GROUP BY 1")
def state_rows(spark, d):
    return fold.state(event_log(spark, d)).select("target", "last_op", "last_agent", "last_seq", "depth")


@book(_FIELDS.replace("l AS", "WITH l AS", 1).replace("FROM events", "FROM events WHERE event_id <= 500", 1) + " SELECT target, field, value FROM f")
def asof_state(spark, d):
    return fold.last_writes(event_log(spark, d), upto=500).select("target", "field", "value")


@book(
    """WITH x AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    y AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM x)
    SELECT user_id, CAST(run AS BIGINT) AS run, event_type, count(*) AS n FROM y GROUP BY 1, 2, 3"""
)
def trajectory_runs(spark, d):
    return analytics.runs(read(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"]).select("user_id", "run", "event_type", "n")


@book(
    """WITH x AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    p AS (SELECT user_id, string_agg(event_type, '.' ORDER BY ts, event_id) AS path, count(*) AS n_runs FROM x WHERE n = 1 GROUP BY 1) SELECT user_id, path, substr(sha256(path), 1, 16) AS fingerprint, n_runs FROM p"""
)
def op_fingerprint(spark, d):
    return analytics.trajectory(read(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"])


_SEC = "CAST(floor(epoch(ts)) AS BIGINT)"


@book(f"SELECT event_id, {_SEC} - lag({_SEC}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events")
def event_intervals(spark, d):
    return analytics.intervals(read(spark, d, "events"), "user_id", "ts", ["ts", "event_id"]).select("event_id", "gap")


_BURST = f"SELECT user_id, max(n) AS most_in_hour FROM (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY {_SEC} RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS n FROM events) GROUP BY 1"


@book(_BURST)
def burst_hour(spark, d):
    return analytics.most_in_hour(read(spark, d, "events"), "user_id", "ts")


@book(
    f"""WITH g AS (SELECT user_id, ts, {_SEC} - lag({_SEC}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events), b AS ({_BURST}),
    l AS (SELECT user_id, count(*) AS n_events, max({_SEC}) AS t, list_sort(list(gap) FILTER (WHERE gap IS NOT NULL)) AS gaps FROM g GROUP BY 1),
    m AS (SELECT *, gaps[CAST(floor(len(gaps) / 2) AS BIGINT) + 1] AS median_gap FROM l) SELECT user_id, n_events, median_gap, most_in_hour,
    CASE WHEN t < (SELECT max({_SEC}) FROM events) - 30 * 86400 THEN 'dormant' WHEN most_in_hour > 3 THEN 'burst' WHEN n_events < 3 THEN 'sparse'
    WHEN len(list_filter(gaps, lambda x: abs(x - median_gap) <= 0.2 * median_gap)) / len(gaps) > 0.6 THEN 'periodic' ELSE 'steady' END AS cadence FROM m JOIN b USING (user_id)"""
)
def intervals_cadence(spark, d):
    e = read(spark, d, "events")
    now = e.agg(F.max("ts")).first()[0]
    return analytics.cadence(e, "user_id", "ts", ["ts", "event_id"], now)


@book("SELECT user_id, count(*) AS agents, count(DISTINCT v) AS \"values\" FROM (SELECT user_id, event_id % 5 AS a, arg_max(value, event_id) AS v FROM events GROUP BY 1, 2) GROUP BY 1 HAVING count(*) > 1 AND count(DISTINCT v) > 1")
def contested_keys(spark, d):
    e = read(spark, d, "events").withColumn("a", F.col("event_id") % 5)
    return analytics.contested(e, "user_id", "a", "value", "event_id")


@book("SELECT user_id, count(*) AS n_defs, count(DISTINCT event_id % 5) AS n_agents, CASE WHEN count(*) > 1 THEN round(count(*) / max(event_id), 9) ELSE 0.0 END AS rate FROM events GROUP BY 1")
def supersession(spark, d):
    e = read(spark, d, "events").withColumn("a", F.col("event_id") % 5)
    return analytics.supersession(e, "user_id", "a", "event_id").withColumn("rate", F.round("rate", 9))


@book(
    """SELECT event_id, event_type AS changed_to, previous FROM (SELECT *, lag(event_type) OVER w AS previous, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
    WHERE n = 1 OR event_type IS DISTINCT FROM previous"""
)
def audit_changes(spark, d):
    return records.audit_trail(read(spark, d, "events"), F.col("event_type"), ["user_id"], ["event_id"]).select("event_id", "changed_to", "previous")


@book(
    """WITH w AS (SELECT event_id, user_id, event_type, event_id % 2 AS f FROM events), p AS (SELECT w.event_id, w.event_type, arg_max(o.event_type, o.event_id) AS before, count(o.event_id) AS n
    FROM w LEFT JOIN w o ON o.user_id = w.user_id AND o.f = w.f AND o.event_id < w.event_id GROUP BY 1, 2) SELECT event_id, n > 0 AND event_type = before AS no_op FROM p"""
)
def no_op_events(spark, d):
    e = read(spark, d, "events")
    log = e.select(F.col("event_id").alias("seq"), F.lit("DEF").alias("op"), F.col("user_id").alias("target"), F.create_map(F.concat(F.lit("f"), F.col("event_id") % 2), F.col("event_type")).alias("operand"))
    return fold.no_ops(log).select(F.col("seq").alias("event_id"), "no_op")


@book(
    """WITH s AS (SELECT event_id % 2 AS side, user_id || '.' || event_type AS target, arg_max(value, event_id) AS v, max(event_id) AS seq FROM events GROUP BY 1, 2)
    SELECT coalesce(o.target, t.target) AS target, CASE WHEN o.seq IS NULL THEN t.v WHEN t.seq IS NULL OR o.v = t.v OR o.seq >= t.seq THEN o.v ELSE t.v END AS value,
    CASE WHEN o.seq IS NULL THEN 'copied' WHEN t.seq IS NULL THEN 'ours' WHEN o.v = t.v THEN 'equal' ELSE 'resolved' END AS outcome
    FROM (SELECT * FROM s WHERE side = 0) o FULL JOIN (SELECT * FROM s WHERE side = 1) t ON o.target = t.target"""
)
def branch_absorb(spark, d):
    e = read(spark, d, "events").withColumn("target", F.concat_ws(".", "user_id", "event_type"))
    side = lambda n: e.where(F.col("event_id") % 2 == n).groupBy("target").agg(F.max_by("value", "event_id").alias("value"), F.max("event_id").alias("seq"), F.lit(f"a{n}").alias("agent"))
    return fold.absorb(side(0), side(1), "last-write-wins").select("target", "value", "outcome")


def _writes(spark, d):
    return read(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id") % 20).alias("entity"), F.concat(F.lit("s"), F.col("user_id") % 40).alias("source"), F.col("event_type").alias("field"), F.col("value").cast("string").alias("value"), "ts", F.col("event_id").alias("seq"))


_W = "w AS (SELECT 'u' || (user_id % 20) AS entity, 's' || (user_id % 40) AS source, event_type AS field, CAST(value AS VARCHAR) AS value, ts, event_id AS seq FROM events)"


@book(f"WITH {_W} SELECT entity, field, value, seq FROM (SELECT *, row_number() OVER (PARTITION BY entity, field ORDER BY ts DESC, seq DESC) AS n FROM w) WHERE n = 1")
def projection_lww(spark, d):
    return worlds.as_of(_writes(spark, d)).select("entity", "field", "value", "seq")


@book(
    f"""WITH {_W}, x AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY entity, field, source ORDER BY ts, seq) = 1 THEN 1 ELSE 0 END AS n FROM w)
    SELECT seq, CAST(s AS BIGINT) AS sources FROM (SELECT seq, sum(n) OVER (PARTITION BY entity, field ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS s FROM x) WHERE s > 1"""
)
def divergence(spark, d):
    return worlds.divergence(_writes(spark, d)).select("seq", "sources")


@book(
    f"""WITH {_W}, link AS (SELECT 's' || i AS source, 's' || (i % 20) AS head, i AS place, (SELECT make_timestamp((epoch_us(min(ts)) + epoch_us(max(ts))) // 2) FROM events) AS merged FROM range(20, 40) AS r(i)),
    never AS (SELECT source AS entity, field, value FROM (SELECT *, row_number() OVER (PARTITION BY source, field ORDER BY ts DESC, seq DESC) AS n FROM w) WHERE n = 1),
    always AS (SELECT head AS entity, field, value FROM (SELECT coalesce(l.head, w.source) AS head, field, value, row_number() OVER (PARTITION BY coalesce(l.head, w.source), field ORDER BY ts DESC, seq DESC) AS n FROM w LEFT JOIN link l USING (source)) WHERE n = 1),
    past AS (SELECT head AS entity, field, value FROM (SELECT head, field, value, row_number() OVER (PARTITION BY head, field ORDER BY place DESC, ts DESC, seq DESC) AS n FROM w JOIN link USING (source) WHERE ts <= merged) WHERE n = 1),
    own AS (SELECT * FROM never WHERE entity NOT IN (SELECT source FROM link))
    SELECT 'never' AS world, * FROM never UNION ALL SELECT 'always', * FROM always
    UNION ALL SELECT 'canonical', coalesce(own.entity, past.entity), coalesce(own.field, past.field), coalesce(own.value, past.value) FROM past FULL JOIN own ON past.entity = own.entity AND past.field = own.field"""
)
def three_worlds(spark, d):
    links = spark.createDataFrame([(f"s{i}", f"s{i % 20}", i) for i in range(20, 40)], "source string, into string, place int")
    middle = read(spark, d, "events").agg(F.timestamp_micros(F.expr("(unix_micros(min(ts)) + unix_micros(max(ts))) div 2")).alias("ts"))
    return worlds.worlds(_writes(spark, d), links.crossJoin(F.broadcast(middle)))


@book(f"WITH {_W} SELECT entity, field, arg_min(value, source) AS value, count(DISTINCT source) AS sources FROM (SELECT entity, field, source, arg_max(value, seq) AS value FROM w GROUP BY 1, 2, 3) GROUP BY 1, 2")
def stance_clearing(spark, d):
    last = worlds.as_of(_writes(spark, d), by=("entity", "source"))
    return worlds.stance(last, "clearing")


@book(
    """WITH o AS (SELECT user_id, event_type, count(*) AS k, max(event_id) AS s FROM events GROUP BY 1, 2) SELECT user_id, CAST(sum(k) AS BIGINT) AS n_events, max(s) AS last_seq,
    (array_agg(event_type ORDER BY k DESC, event_type))[1] AS dominant, arg_max(event_type, s) AS recent, count(*) AS spread FROM o GROUP BY 1"""
)
def target_cards(spark, d):
    return analytics.cards(read(spark, d, "events"), "user_id", "event_type", "ts", "event_id").select("user_id", "n_events", "last_seq", "dominant", "recent", "spread")


@book(f"WITH l AS ({LOG}) SELECT target, min(seq) AS first_seq, arg_min(op, seq) AS first_op, min(seq) FILTER (WHERE op <> 'SIG') AS permanent_seq FROM l GROUP BY 1")
def site_lifecycle(spark, d):
    return fold.site_lifecycle(event_log(spark, d))


@book("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(spark, d):
    e = read(spark, d, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "total")


@book("SELECT user_id, strftime(day, '%Y-%m-%d') AS day, n FROM (SELECT user_id, date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1, 2)")
def events_per_day(spark, d):
    return read(spark, d, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


def _level(rows: str, key: str) -> str:
    return f"SELECT target, {key} AS k, sha256(string_agg(k || ':' || d, '|' ORDER BY k, d)) AS d, CAST(sum(n) AS BIGINT) AS n FROM ({rows}) GROUP BY target, {key}"


_CHAIN = f"SELECT target, seq AS k, sha256(concat_ws('|', seq, op, agent, field, value)) AS d, 1 AS n FROM ({LOG})"
for _key in ("k >> 10",) * 4 + ("k * 0",):
    _CHAIN = _level(_CHAIN, _key)


@book(f"SELECT target, d AS hash, n FROM ({_CHAIN})")
def chained_hashes(spark, d):
    return fold.chain_hash(event_log(spark, d), ["seq", "op", "agent", "event_type", "value"])


@book(f"SELECT count(*) AS n, CAST(sum(CAST('0x' || substr(sha256(target || ':' || d), 1, 15) AS BIGINT)) AS VARCHAR) AS fingerprint FROM ({_CHAIN})")
def store_digest(spark, d):
    return fold.store_fingerprint(chained_hashes(spark, d))


@book(
    f"""WITH g AS (SELECT user_id, value, {_SEC} AS t, {_SEC} - lag({_SEC}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events),
    a AS (SELECT user_id, count(*) AS n, avg(gap) AS m, stddev_samp(gap) AS sd, (min(t) + max(t)) / 2 AS half, stddev_samp(value) AS spread FROM g GROUP BY 1),
    s AS (SELECT a.user_id, a.user_id % 4 AS collection, CASE WHEN any_value(a.n) >= 3 AND any_value(m) > 0 THEN greatest(0.0, 1 - any_value(sd) / any_value(m)) ELSE 0.0 END AS periodicity,
    count(*) FILTER (WHERE t > half) / any_value(a.n) AS momentum, any_value(spread) AS spread FROM a JOIN g USING (user_id) GROUP BY a.user_id),
    x AS (SELECT user_id, collection, unnest(['holon', 'protogon', 'emanon']) AS class, unnest([periodicity, momentum, spread]) AS v FROM s),
    y AS (SELECT *, avg(v) OVER c AS lm, stddev_samp(v) OVER c AS ls, count(*) OVER c AS k, avg(v) OVER e AS gm, stddev_samp(v) OVER e AS gs FROM x WINDOW c AS (PARTITION BY collection, class), e AS (PARTITION BY class)),
    z AS (SELECT *, least(1.0, k / 10) * coalesce((v - lm) / nullif(ls, 0), 0) + (1 - least(1.0, k / 10)) * coalesce((v - gm) / nullif(gs, 0), 0) AS score FROM y),
    o AS (SELECT *, row_number() OVER w AS place, lead(score) OVER w AS second FROM z WINDOW w AS (PARTITION BY user_id ORDER BY score DESC, class DESC))
    SELECT user_id, collection, class, round(score, 6) AS score, round(CASE WHEN score > 0 THEN least(1.0, (score - second) / score) ELSE 0.0 END, 6) AS confidence FROM o WHERE place = 1"""
)
def entity_classes(spark, d):
    e = read(spark, d, "events").withColumn("collection", F.col("user_id") % 4)
    s = analytics.entity_signals(e, "user_id", "ts", "value", ["ts", "event_id"]).join(e.select("user_id", "collection").distinct(), "user_id")
    out = analytics.classify_entities(s, "user_id", "collection", {"periodicity": "holon", "momentum": "protogon", "spread": "emanon"})
    return out.select("user_id", "collection", "class", F.round("score", 6).alias("score"), F.round("confidence", 6).alias("confidence"))


@book(
    """WITH x AS (SELECT event_id, user_id, event_type = 'error' AS c, max(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id) AS last FROM events),
    y AS (SELECT a.event_id, (SELECT count(*) FROM events b WHERE b.user_id = a.user_id AND b.event_id <= a.event_id AND b.event_id > coalesce(a.last, -1)) AS streak FROM x a) SELECT event_id, streak, streak > 0 AND streak % 5 = 0 AS fires FROM y"""
)
def stability(spark, d):
    e = read(spark, d, "events")
    out = analytics.stability_streaks(e, "user_id", "event_id", F.col("event_type") == "error", 5)
    return out.select("event_id", F.col("streak").cast("long").alias("streak"), "fires")


QUERIES, ORACLE = book.queries, book.sql
