"""Edge cases of browsing, validating and migrating the log."""

from pyspark.sql import functions as F

from quillfold.functions import values
from quillfold.operators import browse

LOG = "seq long, op string, target string, operand map<string,string>, agent string, ts timestamp"


def log_of(spark, *rows):
    return spark.createDataFrame([(*r, None) if len(r) == 5 else r for r in rows], LOG).withColumn("ts", F.coalesce("ts", F.timestamp_seconds(F.col("seq") * 86400)))


def test_pages_of_an_empty_and_a_short_log(spark):
    log = log_of(spark, (1, "INS", "app.a", {"x": "1"}, "u"), (2, "DEF", "app.a", {"x": "Two"}, "u"), (3, "NUL", "app.ab", None, "v"))
    assert [r.seq for r in browse.tail(log, 1).collect()] == [2, 3]
    assert [r.seq for r in browse.page_before(log, 3, 9).collect()] == [1, 2]
    assert browse.page_before(log.limit(0), 3, 9).count() == 0
    assert [r.seq for r in browse.matching(log, prefix="app.a", text="two").collect()] == [2]  # app.ab is no child of app.a
    assert browse.matching(log, agent="w").count() == 0


def test_invalid_events_give_their_first_reason(spark):
    log = log_of(spark, (1, None, "app.a", {"x": "1"}, "u"), (2, "DEF", None, {"x": "1"}, "u"), (3, "DEF", "app..a", {"x": "1"}, "u"), (4, "DEF", "app.a", {}, "u"), (5, "NUL", "app.a", None, "u"), (6, "DEF", "app.a", {"x": "1"}, ""))
    assert {r.seq: r.reason for r in browse.invalid(log).collect()} == {1: "unknown op", 2: "no target", 3: "empty segment", 4: "empty operand", 6: "no agent"}


def test_migration_keeps_other_targets_and_missing_fields(spark):
    state = spark.createDataFrame([("app.t.1", {"a": "1", "n": "x"}), ("app.t.2", {"b": "old"}), ("app.tt.1", {"a": "1"})], "target string, value map<string,string>")
    out = {r.target: r.value for r in browse.migrate(state, "app.t", [("rename", "a", "b"), ("coerce", "n", "int"), ("set", "v", 2), ("delete", "z")]).collect()}
    assert out == {"app.t.1": {"b": "1", "n": None, "v": "2"}, "app.t.2": {"b": "old", "v": "2"}, "app.tt.1": {"a": "1"}}


def test_undone_tells_a_null_before_from_no_change(spark):
    current = spark.createDataFrame([("t", "f", "now"), ("t", "g", "same")], "target string, field string, value string")
    changes = spark.createDataFrame([("t", "f", 5, None), ("t", "f", 7, "mid")], "target string, field string, seq long, prev string")
    at = lambda n: {r.field: r.value for r in browse.undone(current, changes, n).collect()}
    assert at(4) == {"f": None, "g": "same"}
    assert at(5) == {"f": "mid", "g": "same"}
    assert at(7) == {"f": "now", "g": "same"}


def test_prototypes_break_ties_by_the_least_cell(spark):
    rows = spark.createDataFrame([("a", 1.0, 2), ("a", 3.0, 1), ("b", None, 4)], "k string, x double, cell int")
    out = {r.k: (r.members, r.mean_x, r.dominant) for r in browse.prototypes(rows, "k", ["x"], "cell").collect()}
    assert out == {"a": (2, 2.0, 1), "b": (1, None, 4)}


def test_mutual_and_stale(spark):
    links = spark.createDataFrame([(1, 2), (2, 1), (2, 1), (3, 3), (1, 4)], "source long, dest long")
    assert [tuple(r) for r in browse.mutual(links).collect()] == [(1, 2)]
    log = log_of(spark, (1, "EVA", "app.a", {"x": "1"}, "u"), (2, "EVA", "app.b", {"x": "1"}, "u"), (3, "DEF", "app.b", {"x": "1"}, "u"), (40, "EVA", "app.c", {"x": "1"}, "u"))
    now = log.agg(F.max("ts")).first()[0]
    assert [r.target for r in browse.stale(log, now, 10).collect()] == ["app.a"]


def test_hashes_of_texts(spark):
    def fnv(s):
        h = 2166136261
        for c in s:
            h = (h ^ ord(c)) * 16777619 & 0xFFFFFFFF
        return h

    texts = ["", "a", "app.users.u1", "ü€𝄞"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", values.fnv1a(F.col("t")).alias("h"), values.shard(F.col("t"), 7).alias("s")).collect()
    assert {r.t: r.h for r in got} == {t: fnv(t) for t in texts}
    assert all(0 <= r.s < 7 for r in got)
