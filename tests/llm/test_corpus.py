"""Operators that need the whole corpus, against brute force."""

import hashlib
import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from quillfold.llm import components, hmm, mixing, packing, simhash, sketch

from .conftest import awkward_rows, prose


def small(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def brute_components(rows):
    prints = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        n = max(1, len(w) - 3) if w else 0
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(n)]
        prints.append(sum((2 * sum(x >> b & 1 for x in h) > n) << b for b in range(64)) if n else 0)
    name = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4 and name[i] != name[j]:
                name = [name[i] if x == name[j] else x for x in name]
    ids = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            ids[name[i]] = min(ids.get(name[i], k), k)
    return [(k, f"{p:016x}", ids.get(name[i])) for i, ((k, _), p) in enumerate(zip(rows, prints, strict=True))]


def near_copies():
    base = prose(11, 500).split()
    return [(200 + i, " ".join(base[:i] + ["changed"] + base[i + 1 :])) for i in range(0, 60, 3)]


def test_simhash_matches_brute_force(spark, awkward):
    rows = [(r[0], r[1]) for r in awkward_rows()] + near_copies() + [(300 + i, prose(100 + i)) for i in range(30)]
    got = simhash.near_duplicates(small(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_components(rows), key=str)


def test_simhash_empty(nothing):
    assert simhash.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("bits", [2, 9, 40])
def test_trie_join_connects_what_links_connect(bits):
    rng = np.random.default_rng(bits)
    a = np.unique(rng.integers(0, 1 << bits, 700, dtype=np.uint64) << np.uint64(7))
    b = np.unique(rng.integers(0, 1 << bits, 300, dtype=np.uint64) << np.uint64(7))

    def parts(n, links):
        name = np.arange(n)
        for x, y in links:
            name[name == name[x]] = name[y]
        return len(np.unique(name))

    for left, right in ((a, None), (a, b)):
        members = left if right is None else np.concatenate([np.sort(left), np.sort(right)])
        pairs = np.argwhere(np.bitwise_count(left[:, None] ^ (left if right is None else right)[None]) <= 4)
        every = [(i, j + (0 if right is None else len(left))) for i, j in pairs]
        got = simhash.trie_links(left.astype(np.int64), None if right is None else right.astype(np.int64))
        at = {int(v): i for i, v in enumerate(members[: len(left)].astype(np.int64))}
        to = at if right is None else {int(v): i + len(left) for i, v in enumerate(np.sort(right).astype(np.int64))}
        links = [(at[x], to[y]) if right is not None else (at[x], at[y]) for x, y in got]
        assert set(links) <= {tuple(p) for p in every} | {(y, x) for x, y in every}
        assert parts(len(members), links) == parts(len(members), every) and len(links) < len(members)


def test_large_buckets_are_cut_into_chunks(spark):
    fps = [int(x) for x in np.unique(np.random.default_rng(3).integers(0, 1 << 12, 300))]
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    one, cut = (components.components(simhash.links(df, n)).collect() for n in (4096, 16))
    assert sorted(map(tuple, one)) == sorted(map(tuple, cut))


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}


def test_dedup_stage_keeps_one_of_each_group(spark, awkward):
    out = simhash.dedup_stage(spark, awkward, "")
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    rows = [(r[0], r[1]) for r in awkward_rows()]
    groups = {g for g in brute_components(rows)}
    want = sorted({c for _, _, c in groups if c is not None})
    got = [r["doc_id"] for r in out.collect()]
    assert sorted(x for x in got if x is not None) == want and got.count(None) == 1


def test_hmm_counts_and_scores(spark, awkward, nothing):
    rows = [(r[0], r[1]) for r in awkward_rows()] + [(50 + i, prose(i, 80)) for i in range(40)]
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k, _ in rows if k is not None}
    words = lambda t: [*(t or "").encode().lower().split(), b"\0"]
    c = Counter(w for k, t in rows if k is not None and not held[k] for w in words(t))
    n, v = sum(c.values()), len(c)
    for r in hmm.score(small(spark, rows)).collect():
        texts = [t for k, t in rows if k == r["doc_id"]]
        fits = [t for t in texts if math.isclose(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(t)), r["base_score"], rel_tol=1e-9) and r["n_tokens"] == len(words(t)) and r["n_known"] == sum(c[w] > 0 for w in words(t))]
        assert fits and r["train_tokens"] == n and r["held_out"] == held.get(r["doc_id"], False) and r["score"] <= 0
    assert hmm.score(nothing).count() == 0


def test_forward_sums_over_all_paths():
    import itertools

    model = hmm.initial(np.array([0.5, 0.3, 0.2]), 2)
    sequences = [np.array(s, np.uint16) for s in ([0], [1, 2, 0], [2, 2, 1, 0, 1])]
    for s, got in zip(sequences, hmm.forward(model, sequences), strict=True):
        total = sum(model.first[p[0]] * np.prod([model.move[a, b] for a, b in itertools.pairwise(p)]) * np.prod([model.emit[x, k] for x, k in zip(s, p, strict=True)]) for p in itertools.product(range(2), repeat=len(s)))
        assert math.isclose(got, math.log10(total), rel_tol=1e-9)


def test_baum_welch_counts_match_enumeration():
    import itertools

    model = hmm.initial(np.array([0.5, 0.3, 0.2]), 2)
    s = np.array([2, 0, 1, 0], np.uint16)
    got = hmm.expected(model, [s])
    want, total = np.zeros(len(got)), 0.0
    for p in itertools.product(range(2), repeat=len(s)):
        w = model.first[p[0]] * np.prod([model.move[a, b] for a, b in itertools.pairwise(p)]) * np.prod([model.emit[x, k] for x, k in zip(s, p, strict=True)])
        total += w
        want[p[0]] += w
        for a, b in itertools.pairwise(p):
            want[2 + 2 * a + b] += w
        for x, k in zip(s, p, strict=True):
            want[6 + 2 * x + k] += w
    assert np.allclose(got[:-1], want[:-1] / total, atol=1e-5) and math.isclose(got[-1], math.log(total), rel_tol=1e-6)


@pytest.mark.parametrize("sticky", [0.0, 0.999])
def test_baum_welch_reads_whole_texts(monkeypatch, sticky):
    rng = np.random.default_rng(3)
    model = hmm.initial(rng.dirichlet(np.ones(20)), 4)
    model.move = (1 - sticky) * model.move + sticky * np.eye(4)
    texts = [rng.integers(0, 20, n).astype(np.uint16) for n in (1, 500, 7, 8, 3, 64, 1, 129)]
    whole = hmm.expected(model, texts)  # blocks of 192: most texts are one block
    for block in (1, 5, 64, 1000):
        monkeypatch.setattr(hmm, "BLOCK", block)
        assert np.allclose(hmm.expected(model, texts), whole, rtol=1e-3, atol=2e-3)
    k, moves = 4, np.zeros((4, 4))
    for t in texts:
        a = [model.first * model.emit[t[0]]]
        a[0] = a[0] / a[0].sum()
        for x in t[1:]:
            a.append(a[-1] @ model.move * model.emit[x])
            a[-1] /= a[-1].sum()
        b = np.ones(k)
        for i in range(len(t) - 1, 0, -1):
            pair = a[i - 1][:, None] * model.move * (model.emit[t[i]] * b)
            moves += pair / pair.sum()
            b = model.move @ (model.emit[t[i]] * b)
            b /= b.sum()
    assert np.allclose(whole[k : k + k * k].reshape(k, k), moves, rtol=1e-3, atol=2e-3)


def test_training_raises_the_likelihood(spark, tables):
    out = hmm.op4_hmm(spark, tables).groupBy("held_out").sum("score", "base_score").collect()
    assert all(r["sum(score)"] > r["sum(base_score)"] for r in out if not r["held_out"])


def test_sketches(spark, awkward, nothing):
    one, other = prose(1, 400), prose(2, 400)
    sk = sketch.Sketcher()
    a, b = sk(one.encode()), sk(other.encode())
    assert sketch.likeness(a, a) == 1 and sketch.likeness(a, b) < 0.05
    assert sketch.likeness(a, sk(f"{one} {other}".encode())) > 0.9  # contained in a longer text
    assert (sketch.decode(sketch.encode(a)) == a).all() and sketch.decode(sketch.merge(sketch.encode(a), sketch.encode(b))).tolist() == sorted({*a.tolist(), *b.tolist()})
    assert sketch.neighbours(nothing).count() == 0


def test_fingerprints_follow_the_order(spark):
    rows = [(r[0], r[1]) for r in awkward_rows()] + [(20 + i, prose(i % 7, 60 + i)) for i in range(40)]
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    got = sketch.neighbours(small(spark, rows).repartition(5)).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got) == len(rows)
    ids = sorted({k for k, _ in rows if k is not None}, reverse=True)
    texts = {k: t or "" for k, t in rows}
    by_id = {r["doc_id"]: r for r in got}
    for k, after in zip(ids, ids[1:], strict=False):
        if k == 1:
            continue  # repeated: the next one is its copy
        t = texts[k]
        changed = t[: len(t) - len(t) // 2] + texts[after][: len(t) // 2]
        assert by_id[k]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest() and by_id[k]["n_chars"] == len(t)
    same = {}
    for k, t in rows:
        if k is not None:
            assert same.setdefault(t or "", by_id[k]["fingerprint"]) == by_id[k]["fingerprint"]
    for r in got:
        one, two = (set(sketch.decode(r[c]).tolist()) for c in ("fingerprint", "edited_fingerprint"))
        assert r["near_edited"] == (len(one & two) / min(len(one), len(two)) if one and two else float(one == two))
    for k, after in zip(ids, ids[1:], strict=False):
        if k != 1:
            one, two = (set(sketch.decode(by_id[x]["fingerprint"]).tolist()) for x in (k, after))
            assert by_id[k]["near_next"] == (len(one & two) / min(len(one), len(two)) if one and two else float(one == two))


def test_fingerprints_of_any_id(spark):
    """The least and the largest id, and very many rows without one: each has one next row, and all rows make one circle."""
    rows = [(-(2**63), "least one"), (2**63 - 1, "largest one"), (0, "zero"), *((None, f"text {i % 40}") for i in range(300))]
    ordered = [r[2] for r in sorted(sketch.in_order(small(spark, rows).repartition(3), "doc_id", "text").where("not ahead").collect(), key=lambda r: r[0])]
    assert sorted(ordered) == sorted(t for _, t in rows) and ordered[:3] == ["largest one", "zero", "least one"]
    got = sketch.neighbours(small(spark, rows).repartition(3)).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    for k, t, after in ((2**63 - 1, "largest one", "zero"), (0, "zero", "least one")):
        assert by_id[k]["edited_sha256"] == hashlib.sha256(sketch.edited(t, after).encode()).hexdigest()
    assert sketch.in_order(small(spark, rows), "doc_id", "text").where("doc_id is null").select("part").distinct().count() > 2


def test_one_row_is_its_own_next(spark):
    (r,) = sketch.neighbours(small(spark, [(1, "a b c d e f")])).collect()
    assert r["near_next"] == 1.0


def test_encoder_matches_the_tokenizer():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(packing.TOKENIZER))
    e, rng = packing.Encoder(), np.random.default_rng(4)
    alphabet = "aé ß\n\t\r\x85\xa0　 \x1c１²½٣日本'sd'll!?#$.,0129"
    texts = [f"a{chr(c)}b {chr(c)}1{chr(c)}{chr(c)} \n{chr(c)}" for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 13 == 0)]
    texts += ["a" * 20_000, " " * 20_000 + "x", "a" + " " * 1_200_000 + "x", "ab" * 10_000]
    texts += ["".join(alphabet[i] for i in rng.integers(0, len(alphabet), rng.integers(0, 40))) for _ in range(1500)]
    texts += ["<|endoftext|> x", "a<|endoftext|>", "x  <|endoftext|>\n\n y<|endoftext|><|endoftext|>", "<|endoftext", "  <|endoftext|>  "]
    texts += [a + run + b for a in ("", "x", "x\n") for run in (" " * 3000, "\n" * 1000 + " ", " \t\u3000" * 800) for b in ("", "x", "<|endoftext|>", "<|endo", " 1")] + [(" " * 1500 + "q") * 3]
    assert [np.frombuffer(x, "<u4").tolist() for x in e(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def check_packed(rows, packed, capacity=packing.CAPACITY):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(packing.TOKENIZER))
    want = Counter()
    for k, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity
        for n, s in enumerate([0, *range(first, len(ids), capacity)]):
            piece = ids[s : first if n == 0 else s + capacity]
            want[k, n, s, len(piece), zlib.crc32(piece.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == want
    bins = {}
    for r in packed:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing(spark, awkward, nothing, tables):
    rows = [(r[0], r[1]) for r in awkward_rows()]
    check_packed(rows, packing.pack(awkward).collect())
    assert packing.pack(nothing).count() == 0
    real = [tuple(r) for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()]
    packed = packing.op7_packing(spark, tables).collect()
    assert check_packed(real, packed) <= math.ceil(sum(r["length"] for r in packed) / packing.CAPACITY) + 1


def test_fullest_is_the_best_subset():
    import itertools

    rng = np.random.default_rng(5)
    for _ in range(60):
        items, room = rng.integers(1, 40, 9).tolist(), int(rng.integers(1, 90))
        got = packing.fullest(room, Counter(items))
        assert not Counter(got) - Counter(items)
        assert sum(k * n for k, n in got.items()) == max(sum(s) for r in range(10) for s in itertools.combinations(items, r) if sum(s) <= room)


def test_mixing_meets_its_targets(spark, tables):
    docs, labels = (spark.read.parquet(f"{tables}/{t}.parquet") for t in ("documents", "labels"))
    rows = mixing.mix(docs, labels).collect()
    p = np.array([[r[f"p_{d}"] for d in mixing.DOMAINS] for r in rows])
    n, rate = np.array([r["n_tokens"] for r in rows]), np.array([r["rate"] for r in rows])
    got, target = (n * rate) @ p, mixing.EPOCHS * (n * p[:, 0]) @ p
    assert len(rows) == docs.count() and (rate >= 0).all() and np.allclose(p.sum(1), 1)
    assert np.abs(got - target).max() <= 1e-3 * target.sum()
    assert (rate[p[:, 0] < 0.05] < 0.1).all() and (rate[p[:, 0] > 0.9] > 1).all()


def plain_least_squares(n, p, target):
    """The least squared error, each by its target's scale, of rates of 0 and more: many small projected steps."""
    scale = np.maximum(target, 1e-3 * target.sum())
    r, m = np.ones(len(n)), p / scale
    step = 1 / np.linalg.eigvalsh(m.T * n @ m).max()
    for _ in range(20_000):
        r = np.maximum(0, r - step * m @ (((n * r) @ p - target) / scale))
    return float(np.square(((n * r) @ p - target) / scale).sum())


@pytest.mark.parametrize("seed, weights, spread", [(6, (0.9, 0.09, 0.01), 0.5), (7, (0.5, 0.3, 0.2), 3.0), (8, (0.9, 0.1, 0.0), 3.0), (9, (0.2, 0.0, 0.8), 0.3), (10, None, 0.5), (11, (0.6, 0.2, 0.2), 8.0)])
def test_rates_solve_the_least_squares(spark, seed, weights, spread):
    rng = np.random.default_rng(seed)
    p, n = rng.dirichlet([spread] * 3, 200), rng.integers(1, 500, 200)
    df = spark.createDataFrame([(int(i), int(t), *map(float, x)) for i, (t, x) in enumerate(zip(n, p, strict=True))], "doc_id long, n_tokens long, p_clean double, p_low double, p_toxic double").coalesce(1).cache()
    steps = mixing.fit_rates(df, weights, 1.0)
    rates = [np.array([r["r"] for r in df.orderBy("doc_id").select(mixing.rate(steps[:i]).alias("r")).collect()]) for i in range(len(steps) + 1)]
    target = (n * p[:, 0]) @ p if weights is None else np.array(weights) / weights[0] * (n @ p)[0]
    scale = np.maximum(target, 1e-3 * target.sum())
    errors = [float(np.square(((n * r) @ p - target) / scale).sum()) for r in rates]
    df.unpersist()
    assert all((r >= 0).all() for r in rates) and all(y < x for x, y in itertools.pairwise(errors))
    assert errors[-1] <= 1.05 * plain_least_squares(n, p, target) + 1e-6


def test_mixing_edges(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (9, 0, 1), (None, 1, 1), (8, None, None), (77, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    assert mixing.mix(awkward, labels).count() == len(awkward_rows())
    assert mixing.mix(awkward, labels.limit(0)).count() == len(awkward_rows())
    assert mixing.mix(nothing, labels).count() == 0
    out = mixing.mixing_stage(spark, awkward, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"] and mixing.mixing_stage(spark, nothing, "/root/testdata/sf0.001").count() == 0
