"""Merging, healing, showing; looking back over split histories, against plain loops."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillfold.functions import display
from quillfold.functions import similarity as S
from quillfold.operators import analytics, dedup, fold, graph, merging, ordered, records
from quillfold.sources import records as sources
from quillfold.streaming import live


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("bits", [1, 3, 20])
def test_split_histories_are_whole(spark, monkeypatch, bits):
    monkeypatch.setattr(ordered, "BITS", bits)
    rng = random.Random(bits)
    rows = [(f"k{rng.randrange(4)}", seq, rng.choice([None, "a", "b"]), rng.randrange(5)) for seq in rng.sample(range(200), 90)]
    df = spark.createDataFrame(rows, "k string, seq long, v string, n int").repartition(5)
    got = {r["seq"]: r for r in ordered.lagged(df, ["k"], ["seq"], ["v"]).collect()}
    sums = {r["seq"]: r["s"] for r in ordered.running(df, ["k"], ["seq"], "n", "s").collect()}
    for k in ("k0", "k1", "k2", "k3"):
        mine, total, before = sorted(r for r in ((s, v, n) for kk, s, v, n in rows if kk == k)), 0, None
        for s, v, n in mine:
            total += n
            assert sums[s] == total and got[s]["_first"] == (before is None) and got[s]["prev_v"] == (before and before[0])
            before = (v,)


def test_hours_across_days(spark):
    rng, start = random.Random(5), datetime(2024, 1, 1, 22)
    rows = [("u", start + timedelta(minutes=rng.randrange(60 * 50))) for _ in range(150)]
    times = sorted(t for _, t in rows)
    want = max(sum(t - timedelta(hours=1) <= x <= t for x in times) for t in times)
    assert analytics.most_in_hour(spark.createDataFrame(rows, "u string, ts timestamp"), "u", "ts").first()["most_in_hour"] == want


def test_no_ops_follow_the_reader(spark):
    rng, log = random.Random(7), []
    for seq in range(1, 200):
        op = rng.choice(["INS", "SEG", "DEF", "DEF", "DEF", "DEF"])
        log.append((seq, op, f"t{rng.randrange(3)}", {f: rng.choice([None, "x", "y"]) for f in rng.sample("abc", rng.randrange(0, 3))}))
    log += [(300, "DEF", "t9", {"a": "x"}), (301, "DEF", "t9", {"b": "y"}), (302, "DEF", "t9", {"a": "x"}), (303, "DEF", "t9", {"b": "x"})]
    state, want = {}, {}
    for seq, op, target, operand in log:
        if op == "DEF":
            there = state.get(target)
            want[seq] = there is not None and all(f in there and there[f] == v for f, v in operand.items())
            state[target] = {**(there or {}), **operand}
        else:
            state[target] = dict(operand)
    got = {r["seq"]: r["no_op"] for r in fold.no_ops(spark.createDataFrame(log, "seq long, op string, target string, operand map<string,string>")).collect()}
    assert {k: v for k, v in want.items() if k in got} == got and set(want) == set(got)
    assert got[302] is True and got[303] is False


def test_merges_chain(spark):
    state = spark.createDataFrame([("a", {"x": "1", "y": "1"}), ("b", {"x": "2"}), ("c", {"z": "3"}), ("d", {})], "target string, value map<string,string>")
    merges = spark.createDataFrame([("a", "b", "m", 1), ("c", "gone", "c", 2)], "a string, b string, into string, seq long")
    got = {r["target"]: r["value"] for r in merging.merged(state, merges).collect()}
    assert got == {"m": {"y": "1", "x": "2"}, "a": {"_alias": "m"}, "b": {"_alias": "m"}, "c": {"z": "3"}, "d": {}}
    survivor = spark.createDataFrame([("a", "b", "a", 1)], merges.schema)
    assert {r["target"]: r["value"] for r in merging.merged(state, survivor).collect()}["a"] == {"y": "1", "x": "2"}
    links = spark.createDataFrame([("a", "b"), ("a", "d"), ("b", "d"), ("d", "a")], "source string, dest string")
    assert sorted(map(tuple, merging.rewired(links, merges.where("seq = 1")).collect())) == [("d", "m"), ("m", "d")]


def test_healing(spark):
    schema = "seq long, op string, target string, operand map<string,string>, agent string, ts timestamp"
    at = datetime(2024, 1, 1)
    log = spark.createDataFrame([(1, "INS", "a", {}, "p", at), (2, "DEF", "b", {"x": "1"}, "p", at)], schema)
    events, branch = merging.forked(log, "main", "b1", "p", at)
    assert [(r["seq"], r["op"]) for r in events.orderBy("seq").collect()] == [(3, "SEG"), (4, "NUL")] and branch.first()["fork_seq"] == 4
    failed = log.withColumn("error", F.when(F.col("seq") == 2, "no such target"))
    assert merging.retried(failed, log).count() == 0
    later = log.unionByName(spark.createDataFrame([(3, "INS", "b", {}, "p", at)], schema))
    assert [r["seq"] for r in merging.retried(failed, later).collect()] == [2]
    assert [one(spark, merging.existence(p, F.lit("v"))) for p in ("dissecting", "clearing", "binding")] == ["v", None, "conflict:v"]
    assert merging.promoted(log).collect()[0]["target"] == "b"
    assert merging.reviewed(spark.createDataFrame([(1, 2, "pending"), (3, 4, "pending"), (5, 6, "auto")], "a int, b int, decision string"), spark.createDataFrame([(1, 2, True), (5, 6, False)], "a int, b int, approve boolean"))[1].collect() == [(1, 2, 1)]


def test_shown_values(spark):
    assert [one(spark, display.name(F.lit(x))) for x in ("tblSalesOrder", "fld", "recA", "name")] == ["Sales Order", "fld", "A", "name"]
    assert [one(spark, display.short_agent(F.lit(x))) for x in ("@jo:host", "system", "", ":x")] == ["jo", "system", "unknown", ":x"]
    assert [tuple(one(spark, display.user_and_device(F.lit(x)))) for x in ("u|d", "u|", "|d", "")] == [("u", "d"), ("u|", None), ("|d", None), (None, None)]
    assert one(spark, display.canonical(F.create_map(F.lit("b"), F.lit('x"\\'), F.lit("a"), F.lit(None).cast("string")))) == '{"a":null,"b":"x\\"\\\\"}'
    got = one(spark, display.triples(F.lit("junk <triplet> A b <subj> C <obj> likes <subj> D <triplet> no end <subj> x <triplet> E <subj> F <obj> is")))
    assert [tuple(t) for t in got] == [("A b", "likes", "C D"), ("E", "is", "F")]


def test_bindings(spark):
    state = spark.createDataFrame([("app.a.r1", {"type": "x"}), ("app.a.r1.f", {}), ("app.b.r2", {"type": "y"})], "target string, value map<string,string>")
    links = spark.createDataFrame([("app.a.r1", "app.b.r2")], "source string, dest string")
    picks = [records.bind(state, "hierarchy", "app.a"), records.bind(state, "depth", None, 4), records.bind(state, "type", kind="y"), records.bind(state, "connection", "app.a.r1", edges=links)]
    assert [[r["target"] for r in p.collect()] for p in picks] == [["app.a.r1"], ["app.a.r1.f"], ["app.b.r2"], ["app.b.r2"]]
    with pytest.raises(ValueError):
        records.bind(state, "other")


def test_own_measures_and_aggregates(spark):
    S.register("same_length", S.by_texts(lambda a, b: float(len(a) == len(b))))
    assert one(spark, S.similarity("same_length", F.lit("ab"), F.lit("cd"))) == 1.0
    df = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("b", 2.0)], "k string, x double")
    got = {r["k"]: r["r"] for r in df.groupBy("k").agg(analytics.custom_aggregate(lambda v: float(v.max() - v.min()))("x").alias("r")).collect()}
    assert got == {"a": 3.0, "b": 0.0}


def test_every_record_has_a_canopy(spark):
    rows = [(i, t) for i, t in enumerate(["red big box", "red big box", "red small cup", "red flat pan", "blue flat pan", "odd", "", "red thin rod of iron"], 1)]
    got = dedup.canopies(spark.createDataFrame(rows, "id int, name string"), "name").collect()
    assert {r["id"] for r in got} == set(range(1, 9)) and (2, 1) in {(r["id"], r["canopy"]) for r in got} and (7, 7) in {(r["id"], r["canopy"]) for r in got}


def test_files_are_split_where_they_can_be(spark, tmp_path):
    plain, broken = tmp_path / "p.csv", tmp_path / "b.csv"
    plain.write_text("a,b\n" + "\n".join(f"{i},x" for i in range(5000)))
    broken.write_text('a,b\n1,"x\ny"\n')
    assert not sources._broken(spark, str(plain)) and sources._broken(spark, str(broken))
    assert sources.read_delimited(spark, str(plain)).count() == 5000
    lines = tmp_path / "l.json"
    lines.write_text('{"id": "r1", "t": "x"}\n{"cases": [{"id": "c1"}]}\n{"id": "r2"}\n')
    assert sorted(r["target"] for r in sources.read_json(spark, str(lines), lines=True).collect()) == ["app.import.cases.c1", "app.import.records.r1", "app.import.records.r2"]


def test_ids_remembered_for_ever(spark, tmp_path):
    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    rows = [(at(0), "a"), (at(50), "b"), (at(1), "a"), (at(2), "c")]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "ts timestamp, client_event_id string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = live.follow(spark, str(tmp_path / "in"), spark.createDataFrame([], "ts timestamp, client_event_id string").schema, 1)
    q = live.once_each(stream, late=None).writeStream.format("memory").queryName("for_ever").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert sorted(r["client_event_id"] for r in spark.table("for_ever").collect()) == ["a", "b", "c"]


def test_walks_keep_the_least_distance(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(0, 4), (4, 0), (4, 4)], "source int, dest int")
    got = {r["node"]: r["distance"] for r in graph.traverse(edges, spark.createDataFrame([(0,)], "node int"), 8, settle_every=2).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 1, 5: 2, 6: 3, 7: 4, 8: 5, 9: 6}


def _plain_violations(log, state, edges, back, needs):
    equal = lambda a, b: a is not None and a == b
    there = {t for t, _, _ in state}
    defs = {t: max(s for s, o, u in log if o == "DEF" and u == t) for _, op, t in log if op == "DEF" and t is not None}
    made = {t for _, op, t in log if op == "INS"}
    out = {(t, "missing_ins") for t, _, _ in state if t is None or t not in made}
    for kind, end, one_way, other in (("asymmetric_con", 0, edges, back), ("asymmetric_con_rev", 1, back, edges)):
        out |= {(e[end], kind) for e in one_way if not any(equal(e[0], x[0]) and equal(e[1], x[1]) for x in other)}
    for kind, end in (("orphan_con_source", 0), ("orphan_con_dest", 1)):
        out |= {(e[end], kind) for e in edges if e[end] is None or e[end] not in there}
    out |= {(t, "stale_def") for t, op, seq in state if op == "DEF" and t in defs and seq is not None and seq != defs[t]}
    return out | {(t, "missing_eva_dep") for t, dep in needs if dep is None or dep not in there}


def _violations(spark, log, state, edges, back, needs=None):
    ends = "source string, dest string"
    frames = [spark.createDataFrame(r, s) for r, s in ((log, "seq long, op string, target string"), (state, "target string, last_op string, last_seq int"), (edges, ends), (back, ends))]
    return merging.violations(*frames, *([] if needs is None else [spark.createDataFrame(needs, "target string, dep string")]))


@pytest.mark.parametrize("seed", range(3))
def test_violations_like_plain_python(spark, monkeypatch, seed):
    """Nulls, repeated rows, edges to themselves, states twice; in several tasks."""
    monkeypatch.setattr(merging, "NOTES", 7)
    rng = random.Random(seed)
    name = lambda: rng.choice([None, *"abcdefgh"])
    link = lambda n: [(name(), name()) for _ in range(n)]
    log = [(rng.randrange(9), rng.choice([None, "INS", "DEF", "DEF", "SEG"]), name()) for _ in range(14)]
    state = [(name(), rng.choice([None, "INS", "DEF", "DEF"]), rng.choice([None, *range(9)])) for _ in range(8)]
    edges, needs = link(12), link(6)
    back = edges[:6] + link(5)
    got = [tuple(r) for r in _violations(spark, log, state, edges, back, needs).collect()]
    assert len(got) == len(set(got)) and set(got) == _plain_violations(log, state, edges, back, needs)
    assert not _violations(spark, [], [], [], []).collect()


def test_violations_in_tasks_of_bounded_size(spark, monkeypatch):
    """Inputs are dealt out by their number and join nothing, also where one target has all events and edges."""
    dealt, deal = [], merging._dealt
    monkeypatch.setattr(merging, "NOTES", 200)
    monkeypatch.setattr(merging, "_dealt", lambda rows, *how: dealt.append(deal(rows, *how)) or dealt[-1])
    edges = [(f"s{i}", "hub") for i in range(1_000)]
    out = _violations(spark, [(i, "DEF", "hub") for i in range(1_000)], [("hub", "DEF", 5)], edges, edges[1:])
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {tuple(r) for r in out.collect()}
    assert got == {("hub", "missing_ins"), ("hub", "stale_def"), ("s0", "asymmetric_con"), *((s, "orphan_con_source") for s, _ in edges)}
    for rows, mean in zip(dealt, (100, 200), strict=True):
        sizes = rows.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
        assert sum(sizes) > 1_000 and max(sizes) < 2 * mean
