"""Pairs and discovery on classes larger than a task should hold, against plain Python."""

from collections import Counter
from itertools import combinations

import pytest

from quillfold.operators import dedup, edges, pairs
from quillfold.plans import record_queries
from quillfold.sources import records as sources


def _plain(rows):
    return Counter((min(x, y), max(x, y)) for (k, x), (j, y) in combinations(rows, 2) if None not in (k, j, x, y) and k == j and x != y)


@pytest.mark.parametrize("chunk", [1024, 40, 7])
def test_pairs_within(spark, monkeypatch, chunk):
    """Classes of 300, 41, 40, 2 and 1 rows, an id twice, nulls; with small limits large classes are cut into chunks."""
    monkeypatch.setattr(pairs, "CHUNK", chunk)
    monkeypatch.setattr(pairs, "PAIRS", 2_000)
    rows = [(k, i) for k, n in (("a", 300), ("b", 41), ("c", 40), ("d", 2), ("e", 1)) for i in range(n)] + [("a", 5), ("d", 1), (None, 1), (None, 2), ("d", None)]
    out = pairs.within(spark.createDataFrame(rows, "k string, id long"), ["k"], "id")
    assert Counter((r["a"], r["b"]) for r in out.collect()) == _plain(rows)
    if chunk < 1024:  # the class of 300 is not one task's
        sizes = out.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
        assert max(sizes) < 0.5 * sum(sizes)


def test_pairs_within_nothing(spark):
    out = pairs.within(spark.createDataFrame([], "k string, id long"), ["k"], "id")
    assert out.columns == ["a", "b"] and out.count() == 0


def test_key_blocks_pairs(spark):
    people = spark.createDataFrame([(i, "Ann Lee" if i % 2 else "lee, ann") for i in range(30)] + [(99, "")], "id long, name string")
    assert {(r["a"], r["b"]) for r in dedup.key_blocks(people, ["name"]).collect()} == set(combinations(range(30), 2))


def test_nearby_traits_unknown(spark, tmp_path):
    """A part without brand, type or size has no traits to share, as in the SQL; pairs come in as many tasks as they need."""
    rows = [(i, "Brand#1", "small", 3) for i in range(8)] + [(8, None, "small", 3), (9, None, "small", 3), (10, "Brand#1", "small", None)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = record_queries.nearby_traits(spark, str(tmp_path))
    assert sorted((r["a"], r["b"]) for r in got.collect()) == list(combinations(range(8), 2))


def test_nearby_traits_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pairs, "PAIRS", 500)
    rows = [(i, f"Brand#{i % 20}", "small", 3) for i in range(1000)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_type string, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    sizes = record_queries.nearby_traits(spark, str(tmp_path)).rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert sum(sizes) == 20 * 50 * 49 // 2 and max(sizes) < 0.4 * sum(sizes)


@pytest.mark.parametrize("chunk", [1024, 16])
def test_co_occurrence_large_group(spark, monkeypatch, chunk):
    """Groups of 120 items and of 2 to 5, items twice in a group, nulls; small groups make their pairs without a join."""
    monkeypatch.setattr(pairs, "CHUNK", chunk)
    monkeypatch.setattr(pairs, "PAIRS", 1_000)
    groups = {0: set(range(120))} | {g: set(range(g, g + 2 + g % 4)) for g in range(1, 60)}
    rows = [(g, i) for g, items in groups.items() for i in items] * 2 + [(None, 1), (None, 2), (3, None)]
    out = edges.co_occurrence(spark.createDataFrame(rows, "g long, i long"), "g", "i", 2)
    want = Counter(p for items in groups.values() for p in combinations(sorted(items), 2))
    assert {(r["a"], r["b"]): r["n"] for r in out.collect()} == {p: n for p, n in want.items() if n >= 2}
    if chunk == 1024:
        assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_keyed_events_renamed(spark):
    """Records called otherwise than their ids, and a list that is null: its record keeps its other fields."""
    cases = spark.createDataFrame([("r1", "C-1", ["P-1", "P-2"], "x"), ("r2", "C-2", None, "x"), ("r3", "C-3", ["P-2", "P-9"], None)], "row string, id string, team array<string>, kind string")
    people = spark.createDataFrame([("P-1", "a"), ("P-2", "a")], "id string, name string")
    long = sources.long_form(cases, "cases", "row").where("field <> 'row'").unionByName(sources.long_form(people, "people", "id"))
    got = Counter(tuple(r) for r in edges.keyed_events(long).select("op", "target", "field", "value").collect())
    fields = [("cases.C-1", "id", "C-1"), ("cases.C-1", "team", "P-1"), ("cases.C-1", "team", "P-2"), ("cases.C-1", "kind", "x"), ("cases.C-2", "id", "C-2"), ("cases.C-2", "kind", "x"), ("cases.C-3", "id", "C-3"), ("cases.C-3", "team", "P-2"), ("cases.C-3", "team", "P-9")]
    fields += [(f"people.{i}", f, v) for i in ("P-1", "P-2") for f, v in (("id", i), ("name", "a"))]
    want = Counter(("INS", f"import.{t}", f, v) for t, f, v in fields)
    want += Counter(("DEF", f"import.{t}", f, v) for t, f, v in fields if f in ("kind", "name"))
    want += Counter(("CON", f"import.{t}", f, f"import.people.{v}") for t, f, v in fields if f == "team" and v != "P-9")
    assert got == want + Counter([("DEF", "import.cases._schema.team.type", "link", "import.people")])
