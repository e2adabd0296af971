"""Operators on small inputs, and the fold against a sequential reader of random logs."""

import random

import pytest
from pyspark.sql import functions as F

from quillfold.functions import paths, values
from quillfold.functions import similarity as S
from quillfold.operators import analytics, dedup, edges, fold, formulas, graph, horizon, records, segments, sync, worlds
from quillfold.sources import records as sources
from quillfold.streaming import live


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "value, op, want, result",
    [
        ("Abc", "equals", "aBC", True), ("1.0", "equals", 1, True), (None, "equals", "null", False), (None, "not_equals", "x", True), ("abc", "gt", 1, False), ("", "lt", 1, True), (None, "lt", 1, False),
        ("true", "gte", 1, True), ("10", "gt", "9", True), ("NaN", "gt", 0, False), ("a%b", "contains", "%", True), ("abc", "starts_with", "AB", True), ("abc", "ends_with", "BC", True),
        ("", "is_empty", None, True), ("0", "is_empty", None, False), (None, "is_not_empty", None, False), ("abc", "like", "A_c", True), ("abc", "not_like", "b%", True), ("B", "in", ["a", "b"], True), ("abc", "not_contains", "z", True),
    ],
)
def test_predicates(spark, value, op, want, result):
    assert one(spark, values.predicate(F.lit(value).cast("string"), op, *([] if want is None else [want]))) is result


def test_values(spark):
    assert one(spark, values.leading_number(F.lit(" 12.5abc"))) == 12.5 and one(spark, values.leading_number(F.lit("abc"))) is None
    names = [r[0] for r in spark.createDataFrame([("rec10",), ("Rec2",), ("rec1",), (None,)], "n string").orderBy(values.natural_key(F.col("n"))).collect()]
    assert names == [None, "rec1", "Rec2", "rec10"]
    assert one(spark, values.timestamp(F.lit("1700000000"))) == one(spark, values.timestamp(F.lit("1700000000000"))) == one(spark, values.timestamp(F.lit("2023-11-14T22:13:20Z")))
    with pytest.raises(ValueError):
        values.predicate(F.lit("a"), "between", 1)


def test_paths(spark):
    t = F.lit("app.tbl.rec1.f")
    assert one(spark, paths.depth(t)) == 4 and one(spark, paths.parent(t)) == "app.tbl.rec1" and one(spark, paths.parent(F.lit("app"))) is None
    assert one(spark, paths.ancestors(t)) == ["app", "app.tbl", "app.tbl.rec1"] and one(spark, paths.ancestors(F.lit("app"))) == []
    assert not one(spark, paths.under(F.lit("app.tbl2.r"), "app.tbl"))


@pytest.mark.parametrize(
    "pattern, target, want",
    [("app.*", "app.a", True), ("app.*", "app.a.b", False), ("app.**", "app", True), ("app.**", "app.a.b", True), ("**", "a.b", True), ("app.**.x", "app.x", True), ("app.**.x", "app.a.b.x", True), ("app.**.x", "appx", False), ("a.*.c", "a.b.c", True), ("a+b.*", "aab.c", False)],
)
def test_globs(spark, pattern, target, want):
    assert one(spark, paths.glob(F.lit(target), pattern)) is want


def test_similarity_vectors(spark):
    x = lambda fn, a, b: round(one(spark, fn(F.lit(a), F.lit(b))), 4)
    assert one(spark, S.fingerprint(F.lit("Smith, John"))) == one(spark, S.fingerprint(F.lit("john SMITH"))) == "john smith" and one(spark, S.fingerprint(F.lit(""))) == ""
    assert one(spark, S.ngram_fingerprint(F.lit("abc"))) == "abbc"
    assert one(spark, S.soundex(F.lit("Ashcraft"))) == "A226" and one(spark, S.soundex(F.lit(""))) == "0000" and one(spark, S.soundex(F.lit("Robert"))) == "R163"
    assert x(S.levenshtein, "kitten", "sitten") == round(1 - 1 / 6, 4) and x(S.levenshtein, "", "") == 1
    assert x(S.osa, "ca", "ac") == 0.5 and S._osa("ca", "abc") == 3
    assert x(S.jaro_winkler, "martha", "marhta") == 0.9611 and x(S.jaro_winkler, "", "") == 1 and x(S.jaro_winkler, "a", "") == 0
    assert x(S.jaccard, "", "") == 1 and x(S.dice, "a b", "b c") >= x(S.jaccard, "a b", "b c")
    assert x(S.tfidf_cosine, "a b", "a b") == 1 and x(S.affine_gap, "abc", "") == 0 and x(S.smith_waterman, "hello", "yellow") == 0.8
    assert x(S.affine_gap, "abc", "abd") == round(4 / 6, 4)
    words = {"Knight": "NT", "Phone": "FN", "Thin": "0N", "Sign": "SN", "Wright": "RT", "Judge": "JJ", "Science": "SNS", "School": "SKL", "Nation": "NXN", "Lamb": "LM", "Back": "BK", "Xavier": "SFR", "White": "WT", "Aesop": "ESP", "Match": "MX", "": ""}
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", S.metaphone(F.col("w")).alias("m")).collect()
    assert {r["w"]: r["m"] for r in got} == words


LOG = "seq long, op string, target string, operand map<string,string>, agent string, ts timestamp, branch string, client_event_id string"


def random_log(seed: int, n: int = 120) -> list[tuple]:
    rng, seen, out = random.Random(seed), set(), []
    for seq in range(1, n + 1):
        t = f"app.t.r{rng.randint(1, 6)}"
        op = "INS" if t not in seen else rng.choice(["DEF"] * 6 + ["SEG", "EVA", "NUL"])
        seen.add(t)
        operand = {rng.choice("abcd"): str(rng.randint(0, 5)) for _ in range(rng.randint(1, 3))}
        out.append((seq, op, t, None if op == "NUL" else operand, f"u{rng.randint(1, 3)}", None, rng.choice(["main", "main", "side"]), f"e{seq}"))
    return out


def serial(log: list[tuple]) -> dict:
    state = {}
    for _, op, t, operand, *_ in log:
        if op in ("INS", "SEG", "EVA"):
            state[t] = dict(operand)
        elif op == "DEF":
            state[t] = {**state.get(t, {}), **operand}
    return state


@pytest.mark.parametrize("seed", range(4))
def test_fold_equals_the_serial_reader(spark, seed):
    log = random_log(seed)
    shuffled = log[:]
    random.Random(seed).shuffle(shuffled)
    got = {r["target"]: r["value"] for r in fold.state(spark.createDataFrame(shuffled, LOG).repartition(3)).collect()}
    assert got == serial(log)
    upto = {r["target"]: r["value"] for r in fold.state(spark.createDataFrame(shuffled, LOG), upto=60).collect()}
    assert upto == serial(log[:60])


def test_ingest_checks(spark):
    log = spark.createDataFrame([(1, "DEF", "a", {"x": "1"}, "u", None, "main", "e1"), (2, "INS", "a", {"x": "2"}, "u", None, "main", "e2"), (3, "INS", "a", {}, "u", None, "main", "e3"), (4, "DEF", "a", {"x": "3"}, "u", None, "main", "e2"), (5, "NUL", "a", None, "u", None, "main", None), (0, "NUL", "a", None, "u", None, "main", None)], LOG)
    assert sorted(r["seq"] for r in fold.deduplicate(log).collect()) == [0, 1, 2, 3, 5]
    good, bad = fold.quarantine(log)
    assert {r["seq"]: r["error"] for r in bad.collect()} == {1: "no such target", 3: "target exists"} and good.count() == 4
    assert {r["seq"]: r["nul_state"] for r in fold.null_states(log).collect()} == {0: "never-set", 5: "cleared"}


def test_edges_aliases_and_integrity(spark):
    con = spark.createDataFrame([(1, "CON", "a", ["b", "c"], None, "x"), (2, "CON", "a", None, ["b"], "x"), (3, "CON", "a", ["c"], None, "y"), (4, "CON", "d", ["e"], ["e"], "x")], "seq long, op string, target string, added array<string>, removed array<string>, edge_type string")
    e = fold.edges(con)
    assert [tuple(r) for r in e.collect()] == [("a", "c", "y", 3)]
    a = fold.aliases(spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(9)] + [("n9", "n9")], "target string, into string"))
    assert {r["canonical"] for r in a.collect()} == {"n9"} and a.count() == 9
    assert {r["target"] for r in fold.resolve(spark.createDataFrame([("n3",), ("z",)], "target string"), a).collect()} == {"n9", "z"}
    state = spark.createDataFrame([("a", {"x": "1"})], "target string, value map<string,string>")
    assert [(r["missing"], r["end"]) for r in fold.integrity(state, e).collect()] == [("c", "dest")]
    tree = spark.createDataFrame([("app", {"x": "1", "y": "0"}, 1), ("app.t", {"y": "2"}, 2), ("app.t.r", {"z": "3"}, 3)], "target string, value map<string,string>, depth int")
    assert {(r["target"], r["field"]): (r["value"], r["distance"]) for r in fold.grounds(tree).collect()} == {("app.t", "x"): ("1", 1), ("app.t.r", "x"): ("1", 2), ("app.t.r", "y"): ("2", 1)}
    cut = fold.crossing_edges(spark.createDataFrame([("p.a", "p.b"), ("p.a", "q.c"), ("px.a", "p")], "source string, dest string"), "p")
    assert cut.count() == 2
    gone = fold.soft_delete(state, "a")
    assert gone.first()["is_deleted"] and not fold.soft_delete(gone, "a", restore=True).first()["is_deleted"]


def test_branches_and_merges(spark):
    log = spark.createDataFrame(random_log(9), LOG)
    rows = {(r["target"], r["field"]): r["value"] for r in fold.branch_state(log, ["main", "side"]).collect()}
    assert rows and all(t.startswith("app.t.") for t, _ in rows)
    assert fold.branch_history(log, [("main", 50), ("side", None)]).where("branch = 'main' and seq > 50").isEmpty()
    side = lambda *rows: spark.createDataFrame(rows, "target string, value string, seq long, agent string")
    ours, theirs = side(("a", "1", 5, "u"), ("b", "1", 5, "u"), ("c", "1", 5, "u"), ("e", None, 5, "u")), side(("a", "2", 6, "v"), ("b", "1", 9, "v"), ("d", "4", 1, "v"), ("e", "2", 5, "v"))
    want = {"binding": None, "clearing": None, "last-write-wins": "2", "first": "1", "timestamp-ordered": "2", "cultivating": "1", "tending": None}
    for policy, value in want.items():
        got = {r["target"]: r for r in fold.absorb(ours, theirs, policy).collect()}
        assert got["a"]["value"] == value and got["b"]["outcome"] == "equal" and got["c"]["outcome"] == "ours" and got["d"]["value"] == "4"
    assert {r["target"]: r["value"] for r in fold.sandbox(spark.createDataFrame([("a", None), ("z", "9")], "target string, value string"), side(("a", "1", 1, "u")).select("target", "value")).collect()} == {"a": None, "z": "9"}
    with pytest.raises(ValueError):
        fold.absorb(ours, theirs, "composing")


def test_hashes_do_not_depend_on_partitions(spark):
    log = spark.createDataFrame(random_log(3), LOG)
    a, b = (fold.chain_hash(x, ["seq", "op", "agent"]) for x in (log.repartition(2), log.repartition(5, "seq")))
    assert fold.store_fingerprint(a).first() == fold.store_fingerprint(b).first()
    assert fold.store_fingerprint(fold.chain_hash(log.where("seq < 100"), ["seq"])).first() != fold.store_fingerprint(a).first()


def test_graph(spark):
    e = spark.createDataFrame([("a.1", "b.1"), ("b.1", "a.1"), ("b.1", "c.1"), ("x.1", "y.1")], "source string, dest string")
    got = {r["node"]: r["distance"] for r in graph.traverse(e, spark.createDataFrame([("a.1",)], "node string"), 5).collect()}
    assert got == {"a.1": 0, "b.1": 1, "c.1": 2}
    back = {r["node"] for r in graph.traverse(e, spark.createDataFrame([("c.1",)], "node string"), 1, "reverse").collect()}
    assert back == {"c.1", "b.1"}
    d = {r["node"]: (r["degree"], r["mutual"], r["role"]) for r in graph.degrees(e).collect()}
    assert d["b.1"] == (3, 1, "bridge") and d["x.1"] == (1, 0, "leaf")
    assert {r["node"]: r["component"] for r in graph.components(e).collect()} == {"a.1": "a.1", "b.1": "a.1", "c.1": "a.1", "x.1": "x.1", "y.1": "x.1"}
    assert {r["node"] for r in graph.reaches_itself(e, 3).collect()} == {"a.1", "b.1"}
    assert graph.components(e.limit(0)).count() == 0


def test_matching(spark):
    people = spark.createDataFrame([(1, "John Smith", "j@x.org"), (2, "Smith, John", "j@x.org"), (3, "John Brown", "b@x.org"), (4, "Jon Smith", "j@x.org"), (5, None, None), (6, "", "")], "id long, name string, email string")
    assert [tuple(r) for r in dedup.key_blocks(people, ["name"]).collect()] == [(1, 2)]
    assert dedup.key_classes(people, ["name"]).where("members > 1").count() == 2
    assert dedup.sorted_neighbourhood(people, ["name"], 2).count() == 5
    pairs = dedup.union_pairs(dedup.key_blocks(people, ["email"]), dedup.lsh_pairs(people, ["name"], 32, 16))
    how = dedup.Matching((dedup.Comparison("name", "jaro_winkler", 2.0), dedup.Comparison("email", "exact")), 0.7, 0.5)
    scored = dedup.compare(pairs, people, how)
    auto = {(r["a"], r["b"]) for r in scored.where("decision = 'auto'").collect()}
    assert (1, 4) in auto
    names = {r["id"]: r["cluster"] for r in dedup.clusters(scored).collect()}
    assert names[4] == names[1] == 1
    for scoring in ("mean", "fellegi_sunter"):
        assert all(0 <= r["score"] <= 1 for r in dedup.compare(pairs, people, dedup.Matching(how.comparisons, scoring=scoring)).collect())
    stats = dedup.job_stats(scored, 6).first()
    assert stats["pairs"] == scored.count() and 0 < stats["reduction"] < 1
    for preset in dedup.PRESETS.values():
        dedup.compare(pairs, people, preset).collect()
    assert dedup.canopies(people, "name").where("id = 4").count() >= 1


def test_nearby_compares_records_of_common_traits(spark):
    rows = [(i, f"t{i % 2}", f"w{i % 7}" if i % 5 else None, i % 3) for i in range(450)]
    want = {}
    for a in rows:
        shared = sorted((-sum(x is not None and x == y for x, y in zip(a[1:], b[1:], strict=True)), b[0]) for b in rows if b[0] != a[0])
        want |= {(a[0], b): (-n, max(1, 3 + n + 1)) for n, b in shared[:10] if n}
    got = horizon.nearby(spark.createDataFrame(rows, "id int, type string, worker string, size int"), ["type", "worker", "size"], "id").collect()
    assert len(got) == 4500 and {(r["id"], r["other"]): (r["shared"], r["distance"]) for r in got} == want


def test_edge_discovery(spark):
    cases = spark.createDataFrame([("CASE-001", "ATT-001", ["ATT-001", "ATT-002"]), ("CASE-002", "ATT-009", ["ATT-001", "ATT-002", "ATT-003"])], "id string, lead string, team array<string>")
    people = spark.createDataFrame([(f"ATT-00{i}", f"n{i % 2}") for i in range(1, 5)], "id string, name string")
    long = sources.long_form(cases, "cases", "id").unionByName(sources.long_form(people, "attorneys", "id"))
    ids = edges.id_fields(long)
    assert {(r["collection"], r["field"], r["pattern"]) for r in ids.collect()} == {("cases", "id", "prefixed"), ("attorneys", "id", "prefixed")}
    refs = {(r["field"], r["target"]): (r["n"], r["share"]) for r in edges.references(long, ids).collect()}
    assert refs == {("lead", "attorneys"): (1, 0.5), ("team", "attorneys"): (5, 1.0)}
    hit, miss = edges.resolve(long, "lead", people.select(F.lit("attorneys").alias("target"), "id"))
    assert hit.count() == 1 and [r["value"] for r in miss.collect()] == ["ATT-009"]
    assert {(r["a"], r["b"]): r["n"] for r in edges.co_occurrence(long.where("field = 'team'"), "record", "value").collect()}[("ATT-001", "ATT-002")] == 2


def test_records(spark):
    rows = spark.createDataFrame([("r1", "Red", None), ("r2", "blue", "2024-01-05"), ("r10", None, "2024-02-01")], "id string, colour string, day string")
    assert [r["id"] for r in records.select(rows, ["id"], order_by=[("id", False)], natural=True).collect()] == ["r1", "r2", "r10"]
    assert records.select(rows, limit=0).count() == 0
    assert {r["id"] for r in records.free_text(rows, "RED").collect()} == {"r1"}
    assert {r["id"] for r in records.time_range(rows, "day", "2024-01-05", "2024-01-31").collect()} == {"r2"}
    assert {r["id"] for r in records.time_range(rows, "day", "2024-01-06", missing="show").collect()} == {"r1", "r10"}
    assert records.named_view(rows, {"columns": ["id"], "filters": [("colour", "is_empty")]}).first()["id"] == "r10"
    long = sources.long_form(rows, "c", "id")
    assert {r["field"]: r["type"] for r in records.infer_columns(long).collect()}["day"] == "date"
    old, new = (spark.createDataFrame(x, "record string, field string, value string") for x in ([("r", "a", "1"), ("r", "b", None)], [("r", "a", "2"), ("r", "c", "3")]))
    assert {r["field"] for r in records.changed_fields(old, new).collect()} == {"a", "c"}


def test_worlds(spark):
    w = spark.createDataFrame([("x", "a", "n", "1", 1, 1), ("x", "b", "n", "2", 2, 2), ("x", "s", "n", "3", 9, 3), ("x", "a", "m", "7", 3, 4)], "entity string, source string, field string, value string, ts int, seq long")
    links = spark.createDataFrame([("a", "s", 5, 0), ("b", "s", 5, 1)], "source string, into string, ts int, place int")
    got = {(r["world"], r["entity"], r["field"]): r["value"] for r in worlds.worlds(w, links).collect()}
    assert got[("never", "a", "n")] == "1" and got[("always", "s", "n")] == "3" and got[("canonical", "s", "n")] == "3" and got[("canonical", "s", "m")] == "7"
    before = {(r["world"], r["entity"], r["field"]): r["value"] for r in worlds.worlds(w, links, 5).collect()}
    assert before[("canonical", "s", "n")] == "2"
    assert worlds.divergence(w).count() == 2
    assert {how: worlds.stance(w.where("field = 'n'"), how).first()["value"] for how in ("clearing", "binding", "dissecting", "composing", "tracing")} == {"clearing": "1", "binding": "1 | 2 | 3", "dissecting": "conflict: 1 | 2 | 3", "composing": "2.0", "tracing": "3"}
    timed = w.withColumn("ts", F.timestamp_seconds("ts"))
    assert worlds.timeline(timed, 3).where("step = 2 and field = 'n'").first()["value"] == "3"


def test_segments(spark):
    text = "The first sentence is here, with a clause; and one more. The second follows!\nA new line of text"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "x" * 1500)], "doc_id long, text string")
    sentences, clauses = segments.spans(docs, "sentence"), segments.spans(docs, "clause")
    for r in sentences.where("doc_id = 1").collect():
        assert text[r["start"] : r["end"]] == r["text"]
    assert sentences.where("doc_id = 1").count() == 3 and max(len(r["text"]) for r in sentences.collect()) <= segments.LONGEST
    assert segments.parents(clauses.where("doc_id = 1"), sentences).count() == clauses.where("doc_id = 1").count()
    assert one(spark, segments.script(F.lit("Привет"))) == "cyrillic"


def test_streaks_and_runs(spark):
    ev = spark.createDataFrame([(i, "u", "x" if i == 3 else "y") for i in range(1, 12)], "seq long, u string, op string")
    got = {r["seq"]: r["streak"] for r in analytics.stability_streaks(ev, "u", "seq", F.col("op") == "x", 4).collect()}
    assert [got[i] for i in (1, 2, 3, 4, 11)] == [1, 2, 0, 1, 8]
    assert analytics.trajectory(ev, "u", "op", ["seq"]).first()["path"] == "y.x.y"


def test_sources(spark, tmp_path):
    csv = tmp_path / "in.csv"
    csv.write_text('name;n;ok;note\n"A; ""b""";1.50;TRUE;\nB;007;null;"two\nlines"\n')
    rows = sources.read_delimited(spark, str(csv)).orderBy("seq").collect()
    assert [r["target"] for r in rows] == ["app.import.rec001", "app.import.rec002"]
    assert rows[0]["operand"] == {"name": 'A; "b"', "n": "1.5", "ok": "true"} and rows[1]["operand"] == {"name": "B", "n": "7", "note": "two\nlines"}
    events = tmp_path / "ev.csv"
    events.write_text('op,target,operand\nINS,app.a,"{""x"":1}"\nBAD,app.b,{}\nDEF,app.a,nope\n')
    got = sources.read_events(spark, str(events)).collect()
    assert [(r["op"], r["operand"]) for r in got] == [("INS", {"x": "1"}), ("DEF", None)] or [(r["op"]) for r in got] == ["INS", "DEF"]
    js = tmp_path / "in.json"
    js.write_text('{"cases": [{"id": "c1", "t": "x"}], "people": [{"id": "p1"}, {"t": "y"}]}')
    assert sources.read_json(spark, str(js)).count() == 3
    log = spark.createDataFrame(random_log(1, 20), LOG)
    path = str(tmp_path / "log")
    assert sources.append(log.where("seq <= 12"), path).count() == 12
    assert sources.append(log, path).count() == 8 and spark.read.parquet(path).count() == 20
    assert one(spark, sources.normalised(F.lit('[{"id":"r1"},{"id":"r2"}]'), "linkedRecord")) == "r1,r2"
    assert [one(spark, sources.field_class(F.lit(k))) for k in ("number", "linkedRecord", "formula", "autoNumber")] == ["def", "con", "eva", "skip"]


def test_streams(spark, tmp_path):
    from datetime import datetime

    at = lambda m: datetime(2024, 1, 1, 0, m)
    schema = "seq long, op string, target string, ts timestamp, client_event_id string"
    rows = [(i, "CON" if i == 4 else "SIG" if i > 9 else "DEF", "app.t.r1", at(i), f"e{i % 12}") for i in range(1, 15)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = live.follow(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
    assert stream.isStreaming

    def run(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"cp_{name}")).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    assert len(run(live.subscribe(stream, "app.*.r1", ("SIG",)), "subscribed")) == 5
    assert len(run(live.once_each(stream), "once")) == 12
    assert [r["seq"] for r in run(live.stable_scopes(stream, 5), "stable")] == [9, 14]
    assert [(r["n_live"]) for r in run(live.signals(stream), "signals")] == [5]
    assert sum(r["n"] for r in run(live.counts_per_window(stream, "target", "ts", "10 minutes"), "windows", "complete")) == 14
    got = []
    live.deliver(stream, str(tmp_path / "cp_deliver"), lambda df, n: got.append(df.count())).awaitTermination(120)
    assert sum(got) == 14


def test_horizon(spark):
    state = spark.createDataFrame([("app.t.r1", {"name": "x"}), ("app.t.r1.score", {"value": "5"}), ("app.t.r1.name", {"value": "y"}), ("app.t.r1.a.b", {"value": "z"}), ("app.t.r2", {"name": "w"})], "target string, value map<string,string>")
    assert {r["target"]: r["value"] for r in horizon.figures(state).collect()} == {"app.t.r1": {"name": "x", "score": "5"}, "app.t.r2": {"name": "w"}}
    rules = spark.createDataFrame([("app.t", "a"), ("app.t.r1", "b"), ("app", "c")], "target string, rule string")
    assert {r["target"]: (r["rule"], r["scope"]) for r in horizon.governance(state.where("target like 'app.t.r_'"), rules).collect()} == {"app.t.r1": ("b", "direct"), "app.t.r2": ("a", "ancestor")}
    assert {r["target"]: r["siblings"] for r in horizon.ancestry(state).where("distance = 1").collect()}["app.t.r1"] == 1
    cases = spark.createDataFrame([(1, "theft", "ann"), (2, "theft", "bob"), (3, "fraud", "ann"), (4, "other", None)], "id int, type string, worker string")
    assert {(r["id"], r["other"]): r["distance"] for r in horizon.nearby(cases, ["type", "worker"], "id").collect()} == {(1, 2): 2, (2, 1): 2, (1, 3): 2, (3, 1): 2}


def test_formulas(spark):
    rows = spark.createDataFrame([(1, 4.0, 1.0)], "id int, a double, b double")
    got = formulas.evaluate(rows, {"d": "c + 1", "c": "sqrt(a)", "m": "a + nowhere"}).first()
    assert got["c"] == 2 and got["d"] == 3 and got["m"] is None
    assert formulas.is_volatile("a + NOW()") and not formulas.is_volatile("known + 1")
    with pytest.raises(ValueError):
        formulas.column("reflect('java.lang.System', 'exit')", ["a"])
    with pytest.raises(formulas.CycleError):
        formulas.evaluate(rows, {"a": "b + 1", "b": "a + 1"})
    halves = formulas.fixed_point(rows, {"a": "b / 2 + 1", "b": "a / 2 + 1"})
    assert halves.outcome == "converged" and abs(halves.records.first()["a"] - 2) < 1e-6
    swap = formulas.fixed_point(rows, {"a": "b", "b": "a"})
    assert swap.outcome == "oscillation" and swap.cycle_length == 2
    assert formulas.fixed_point(rows, {"a": "a + 1"}, rounds=4).outcome == "bail"


def test_replicas(spark):
    e = spark.createDataFrame([(1, "r", 10), (2, "r", 10), (3, "r", 9), (4, "r", 12)], "seq long, replica_id string, wall_ms long")
    assert [(r["hlc_wall"], r["hlc_logical"]) for r in sync.ticked(e).orderBy("seq").collect()] == [(10, 0), (10, 1), (10, 2), (12, 0)]
    a, b = (spark.createDataFrame([(x,) for x in xs], "client_event_id string") for xs in ("abc", "bcd"))
    we, they = sync.missing(a, b)
    assert [r[0] for r in we.collect()] == ["d"] and [r[0] for r in they.collect()] == ["a"]
    g = spark.createDataFrame([("m", "grant", "admin", 1), ("m", "revoke", None, 2), ("n", "revoke", None, 1), ("n", "grant", "user", 2)], "member string, action string, role string, seq long")
    assert [tuple(r) for r in sync.grants(g).collect()] == [("n", "user")]


def test_entry_module(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())


def test_crystallised(spark):
    rows = spark.createDataFrame([("a.b", "x", 1), ("a.b", "x", 2), ("a.b", "y", 3), (None, "x", 4), ("a.b", None, 5), ("a.c", "x", 6), ("a.c", "x", 6), ("a.b.c.d.e.f.g.h", "x", 7), ("a.b.c.d.e.f.g.h", "x", 8)], "scope string, trait string, key int")
    now = analytics.crystallised(rows, "scope", ["trait"], "key")
    assert [(r["scope"], r["members"], r["status"]) for r in now.collect()] == [("a.b", 2, "active")]
    fewer = analytics.crystallised(rows.where("key <> 2"), "scope", ["trait"], "key", known=now).collect()
    assert [(r["scope"], r["members"], r["status"]) for r in fewer] == [("a.b", 1, "inert")]
    gone = analytics.crystallised(rows.where("false"), "scope", ["trait"], "key", known=now).collect()
    assert [(r["scope"], r["members"], r["status"]) for r in gone] == [("a.b", 0, "inert")]


def test_nearby_joins_classes_of_equal_records_once(spark, monkeypatch):
    rows = [(i, f"t{i % 3}", f"w{i % 3}" if i % 3 else None) for i in range(600)] + [(7, "t9", "w2"), (None, "t1", "w1")]
    made = []
    monkeypatch.setattr(horizon, "settled", lambda df: made.append(graph.settled(df)) or made[-1])
    got = horizon.nearby(spark.createDataFrame(rows, "id long, type string, worker string"), ["type", "worker"], "id", 4).collect()
    entries = made[0].collect()
    assert len(entries) == 1 + 3 + 3 + 3 and max(len(r["_keys"]) for r in entries) == 5  # a class and set each, however many records
    want = {}
    for a in range(600):
        shared = {}
        for x in [r for r in rows if r[0] == a]:
            for y in rows:
                n = sum(p is not None and p == q for p, q in zip(x[1:], y[1:], strict=True))
                if y[0] not in (a, None) and n:
                    shared[y[0]] = max(n, shared.get(y[0], 0))
        want |= {(a, b): n for n, b in sorted((-n, b) for b, n in shared.items())[:4] for n in [-n]}
    assert len(got) == len(want) and {(r["id"], r["other"]): r["shared"] for r in got} == want


def test_minhash_functions_differ(spark):
    names = spark.createDataFrame([(1, "red widget small"), (2, "red widget smell"), (3, "green sprocket")], "id long, name string")
    mins = {r["id"]: r["m"] for r in names.select("id", dedup.minhash(F.col("name")).alias("m")).collect()}
    assert all(len(set(m)) == 64 for m in mins.values())
    agree = lambda a, b: sum(x == y for x, y in zip(mins[a], mins[b], strict=True)) / 64
    assert 0.4 < agree(1, 2) < 0.95 and agree(1, 3) < 0.2


def test_spans_come_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(segments, "SPANS", 3)
    monkeypatch.setattr(segments, "TEXTS", 2)
    docs = spark.createDataFrame([(i, f"A sentence of number {i}. " * (5 * i) if i % 4 else None) for i in range(12)], "doc_id long, text string").coalesce(1)
    got = segments.spans(docs, "sentence")
    assert {(r["doc_id"], r["n"]) for r in got.collect()} == {(i, n) for i in range(12) if i % 4 for n in range(5 * i)}
    sizes = got.mapInArrow(lambda bs: (b.from_pydict({"n": [b.num_rows]}) for b in bs), "n long").collect()
    assert sum(r["n"] for r in sizes) == got.count()
    assert next(segments._spans("One sentence here. Another one.", segments._SENTENCE, 8)) == (0, 18)  # made one at a time


def test_dangling_counts_ends(spark):
    state = spark.createDataFrame([("a",), ("b",)], "target string")
    links = spark.createDataFrame([("a", "b"), ("a", "x"), ("b", "x"), ("y", "x"), ("y", "y"), ("a", None)], "source string, dest string")
    assert {(r["missing"], r["n"]) for r in fold.dangling(state, links).collect()} == {("x", 3), ("y", 3), (None, 1)}
    assert fold.integrity(state, links).count() == 7
