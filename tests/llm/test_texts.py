"""Operators that judge each text alone, against brute force."""

import glob
import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from quillfold.llm import extract, language, pii, quality, urls

from .conftest import awkward_rows, prose


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), failed


def test_quality_matches_brute_force(spark, awkward, tables):
    texts = [(r[0], r[1]) for r in awkward_rows()] + [(100, "a b c d e f g h\na b c d e f g h\n \n"), (101, "x|y #*$%&<> " * 3)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = sorted((tuple(r)[:7] for r in quality.compression_bands(docs).collect()), key=str)
    assert got == sorted(((i, *brute_quality(t)) for i, t in texts), key=str)
    assert all(not r["kept"] for r in quality.compression_bands(docs).where("base_failed").collect())
    real = spark.read.parquet(f"{tables}/documents.parquet")
    want = {r["doc_id"]: brute_quality(r["text"]) for r in real.collect()}
    assert {r["doc_id"]: tuple(r)[1:7] for r in quality.op10_quality(spark, tables).collect()} == want


def test_repeats_with_very_many_words():
    words = [str(i).encode() for i in range(9000)]  # so many that windows need ranks
    assert quality.repeat_words(words) == 0
    assert quality.repeat_words(words + words[10:17]) == 14


def test_compression_verdicts():
    press, bands = zstandard.ZstdCompressor(level=3), quality.Bands()
    rng = np.random.default_rng(0)
    noise = " ".join(bytes(rng.integers(33, 120, 9)).decode() for _ in range(400)).encode()
    again = b" ".join(b"one two three four five six %d" % i for i in range(300))
    assert not quality.measure(noise, bands, press)[6]
    assert not quality.measure(again, bands, press)[6]


def test_quality_keeps_real_texts(spark):
    texts = [open(f, encoding="utf-8").read() for f in sorted(glob.glob("/usr/share/common-licenses/*"))]
    for f in sorted(glob.glob("/usr/share/gnupg/help.*.txt")):
        lines = open(f, encoding="utf-8", errors="ignore").read().split("\n")
        texts.append("\n".join(x for x in lines if x.strip() and x[0] not in ".#"))
    if len(texts) < 10:
        pytest.skip("no texts on this machine")
    texts += [" ".join(t.split()) for t in texts]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    judged = {r["doc_id"]: r for r in quality.compression_bands(docs).where("not base_failed").collect()}
    kept = {r["doc_id"] for r in quality.quality_stage(spark, docs, "").collect()}
    assert len(judged) > 10 and kept == set(judged)
    few = " ".join(np.random.default_rng(1).choice("alpha beta gamma delta epsilon zeta eta theta".split(), 900)).encode()
    got = quality.measure(few, quality.Bands(), zstandard.ZstdCompressor(level=3))
    assert not got[5] and not got[6]  # eight words over and over pass the base rules, not the bands


def test_quality_empty_and_stage(spark, awkward, nothing):
    assert quality.compression_bands(nothing).count() == 0
    kept = quality.quality_stage(spark, awkward, "")
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(not brute_quality(r["text"])[5] for r in kept.collect())


_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_KINDS = {"email": _EMAIL, "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")}


def brute_spans(text):
    out = []
    for n, (kind, pattern) in enumerate(_KINDS.items()):
        for m in pattern.finditer(text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255:
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), n, m.end(), kind))
    return sorted(out)


def test_base_spans_match_plain_patterns():
    rng = np.random.default_rng(1)
    for alphabet in ("ab.@_-1 ", "12.. ", "+1() -4.", "0123456789 -+.@a"):
        for _ in range(3000):
            s = "".join(alphabet[i] for i in rng.integers(0, len(alphabet), rng.integers(0, 40)))
            assert pii.base_spans(s) == [x[:3] for x in brute_spans(s)], s


@pytest.fixture(scope="module")
def field(spark):
    return pii.train(pii.labelled_table(spark))


def test_pii_rows(spark, awkward, nothing, field):
    got = pii.find(awkward, field).collect()
    assert len(got) == len(awkward_rows())
    want = {r[0]: brute_spans(r[1]) for r in awkward_rows() if r[0]}
    for r in got:
        if r["doc_id"]:
            base = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want[r["doc_id"]])
            assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
            assert set(filter(None, base.split(","))) <= set(r["spans"].split(","))
    assert pii.find(nothing, field).count() == 0


def test_field_learns_and_adds_spans(field):
    decoder = pii.Decoder(field)
    texts = ["call (275) 555-5927 for more of the same", "4111111111111111 5500005555555559", "the man is in the house and it rains", ""]
    (b0, s0), (b1, s1), (_, s2), (_, s3) = pii.all_spans(texts, decoder)
    assert not b0 and [texts[0][a:b] for a, _, b in s0] == ["(275) 555-5927"]
    assert not b1 and [texts[1][a:b] for a, _, b in s1] == texts[1].split()  # the pattern reads both numbers as one and drops it
    assert s2 == s3 == []


#: Spans that the patterns miss, in sentences that no template has.
PLANTED = [
    ("My number is {} and I am at home.", ["020 7946 0958", "0171 4432 8876", "0345 678 1234"]),
    ("You may phone {} all day.", ["(275) 555-5927", "212-555-0188", "415.555.0134"]),
    ("Tel {} please", ["0049 30 1234 567", "030/1234567"]),
    ("Blocked IP: {} twice.", ["10[.]0[.]0[.]1", "192[.]168[.]7[.]44", "172 . 16 . 9 . 8"]),
    ("the server at {} is down", ["10 dot 20 dot 30 dot 40", "8[dot]8[dot]4[dot]4"]),
    ("Please mail {} soon.", ["jane (at) mailbox (dot) org", "bob at site dot com", "kim [at] host [dot] net"]),
    ("She paid with card {} on Monday", ["4111 1111 1111 1111 123", "5500.0055.5555.5559", "4012/8888/8888/1881"]),
]
CLEAN = [
    "In 1999 there were 12 345 people and 300 400 houses in the town.", "Version 10.4.2 came out on 2024-05-17 with 1200 changes.", "He sat at home and looked at the dot on the wall.",
    "The score was 3-2 and 110-98 in the other game.", "See section 12.3.4 on page 1024 of the manual.", "Order 1234 5678 has 3 items at 12.50 each.", "Between 2001-02-03 and 2002-03-04 nothing was sold.",
    "Meet me at noon. Dot your letters.", "Total 4111 1111 of 5000 0000 were used.",
]


def test_field_finds_what_patterns_miss(field):
    texts = [(s.format(x), x) for s, values in PLANTED for x in values]
    found = pii.all_spans([t for t, _ in texts], pii.Decoder(field))
    assert not any(base for base, _ in found)
    hit = sum(any(t[a:b] == x or x.startswith(t[a:b]) and b - a > 14 for a, _, b in spans) for (t, x), (_, spans) in zip(texts, found, strict=True))
    assert hit >= 0.9 * len(texts)
    assert [s for _, s in pii.all_spans(CLEAN, pii.Decoder(field))] == [[]] * len(CLEAN)


def test_field_slopes_match_enumeration():
    import itertools

    rng = np.random.default_rng(8)
    k, f = 3, 7
    weights = [rng.normal(size=(f, k)) for _ in range(3)] + [rng.normal(size=(k, k)), rng.normal(size=k)]
    seq, gold, live = rng.integers(0, f, (4, 5, 3)), rng.integers(0, k, (4, 5)), np.arange(5) < np.array([5, 3, 1, 4])[:, None]
    gold, seq = np.where(live, gold, 0), np.where(live[:, :, None], seq, 0)

    def likelihood(w):
        total = 0.0
        for s, g, on in zip(seq, gold, live, strict=True):
            n = int(on.sum())
            emit = np.array([w[0][s[i]].sum(0) + (w[1][s[i - 1]].sum(0) if i else 0) + (w[2][s[i + 1]].sum(0) if i + 1 < n else 0) for i in range(n)])
            score = lambda p: w[4][p[0]] + sum(emit[i, x] for i, x in enumerate(p)) + sum(w[3][a, b] for a, b in itertools.pairwise(p))  # noqa: B023, E731
            total += score(g[:n].tolist()) - np.log(sum(np.exp(score(p)) for p in itertools.product(range(k), repeat=n)))
        return total

    # beyond a text's end stands feature 0, whose weights training leaves at 0
    for w in weights[:3]:
        w[0] = 0.0
    value, slopes = pii.slopes(pii.Field({}, *weights), seq, gold, live)
    assert np.isclose(value, likelihood(weights))
    for n, w in enumerate(weights):
        for at in np.ndindex(*w.shape):
            if n < 3 and at[0] == 0:
                continue
            up, down = ([x.copy() for x in weights] for _ in range(2))
            up[n][at] += 1e-5
            down[n][at] -= 1e-5
            assert np.isclose((likelihood(up) - likelihood(down)) / 2e-5, slopes[n][at], atol=1e-6)


def test_viterbi_is_the_best_path(monkeypatch):
    import itertools

    rng = np.random.default_rng(2)
    sizes = np.array([6, 1, 0, 4, 6, 3])
    emit, move, first = rng.normal(size=(20, 3)), 2 * rng.normal(size=(3, 3)), rng.normal(size=3)
    long = rng.normal(size=(400, 3))
    score, back = first + long[0], []
    for e in long[1:]:
        back.append((score[:, None] + move).argmax(0))
        score = (score[:, None] + move).max(0) + e
    plain = [int(score.argmax())]
    for b in back[::-1]:
        plain.append(int(b[plain[-1]]))
    for block in (1, 2, 5, 128):
        monkeypatch.setattr(pii, "BLOCK", block)
        got = np.split(pii.viterbi(emit, move, first, sizes), np.cumsum(sizes)[:-1])
        for e, tags in zip(np.split(emit, np.cumsum(sizes)[:-1]), got, strict=True):
            score_of = lambda p: first[p[0]] + sum(e[i, t] for i, t in enumerate(p)) + sum(move[a, b] for a, b in itertools.pairwise(p))  # noqa: B023, E731
            assert tuple(tags) == (max(itertools.product(range(3), repeat=len(e)), key=score_of) if len(e) else ())
        assert pii.viterbi(long, move, first, np.array([400])).tolist() == plain[::-1]


def test_long_texts_are_one_path(field, monkeypatch):
    texts = [pii._WORD.findall(" ".join([prose(5, 300), "Call +1 (275) 555-5927 now.", prose(6, 300), "card 4111 1111 1111 1111"])), [], ["call", "(275)", "555-5927"]]
    tags = pii.Decoder(field).tags(texts)
    monkeypatch.setattr(pii, "BLOCK", 3)
    assert [t.tolist() for t in pii.Decoder(field).tags(texts)] == [t.tolist() for t in tags] and tags[0].any() and tags[2].any()


def test_pii_stage_masks(spark, awkward):
    out = {r["doc_id"]: r for r in pii.pii_stage(spark, awkward, "").collect()}
    assert "jo.doe" not in out[9]["text"] and "[EMAIL]" in out[9]["text"] and "[CARD]" in out[9]["text"]
    assert out[2]["text"] is None and out[8]["text"] == "a b c" and out[9]["n_chars"] == len(out[9]["text"])


def test_url_rules_and_classifier(spark, tables):
    rows = [
        (1, "https://www.example.com/en/1"), (2, "http://a.example.com/en/x?y"), (3, "http://x.net/es/1"), (4, "http://x.NET/de/"), (5, None), (6, "no host"), (7, "http://cheappills.example.org/buy"),
        (8, "http://example.com"), (8, "http://example.com"), (9, "ftp://A.COM/x#y"), (10, "http://freecasinobonus.example.org/#/en/"), (11, "http://notexample.com/en/"),
    ]
    pages = spark.createDataFrame([(*r, "x", None) for r in rows], "page_id long, url string, host string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages).collect()}
    assert got[1] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[2] == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert got[3] == ("x.net", "/es/1", "net/es/", "block")
    assert got[4] == ("x.net", "/de/", None, "allow")
    assert got[5][:3] == got[6][:3] == ("", "", None)
    assert got[7] == ("cheappills.example.org", "/buy", None, "block")
    assert got[8] == ("example.com", "", None, "allow")
    assert got[9] == ("a.com", "/x", "com/", "allow")
    assert got[10][1:] == ("/", None, "block")
    assert got[11][2:] == ("com/", "allow")
    assert urls.judge(pages.limit(0)).count() == 0
    assert urls.op2_urls(spark, tables).count() == 50


def test_segmentation_is_the_cheapest_split():
    import itertools

    words = urls.Words({"free": 1.0, "bets": 1.5, "be": 1.2, "ts": 3.0}, (4.0, 1.0), 4, {}, {}, 0.0)
    assert urls.segment("freebets", words) == ["free", "bets"]
    assert urls.segment("xxfree", words) == ["xx", "free"]
    assert urls.segment("", words) == []
    rng = np.random.default_rng(4)
    lexicon = {"".join(rng.choice(list("abc"), n)): float(rng.uniform(0.5, 6)) for n in rng.integers(1, 5, 30)}
    words = urls.Words(lexicon, (3.0, 1.3), 4, {}, {}, 0.0)
    cost = lambda parts: sum(min(lexicon.get(p, np.inf), 3.0 + 1.3 * len(p)) for p in parts)
    for _ in range(200):
        name = "".join(rng.choice(list("abcd"), rng.integers(1, 10)))
        cuts = (c for k in range(len(name)) for c in itertools.combinations(range(1, len(name)), k))
        best = min(cost([name[i:j] for i, j in itertools.pairwise((0, *c, len(name)))]) for c in cuts)
        got = urls.segment(name, words)
        assert "".join(got) == name and np.isclose(cost(got), best)


def test_bayes_scores_match_counting(spark, tables):
    words = urls.learn(spark.read.parquet(f"{tables}/pages.parquet"), spark.read.parquet(f"{tables}/documents.parquet").select("text"))
    seen = [[w for u in us for w in urls.tokens(*u.split("/", 1), words)] for us in (urls.BLOCKED, urls.ALLOWED)]
    every = set(seen[0]) | set(seen[1])
    for host, path in (("freebigcasino.example", "/pills"), ("daily-science.example", "/article/library"), ("zzzz.example", "/")):
        odds = np.log((len(urls.BLOCKED) + 1) / (len(urls.ALLOWED) + 2))
        for w in urls.tokens(host, path, words):
            if w in every:
                odds += np.log((seen[0].count(w) + 1) / (len(seen[0]) + len(every) + 1)) - np.log((seen[1].count(w) + 1) / (len(seen[1]) + len(every) + 1))
        assert np.isclose(urls.score(host, path, words), odds)


#: Names of which none is in the labelled table.
HELD_OUT = [
    (True, "megacasinospins.example/play bigbonuspoker.example/x adultsexvideos.example/ cheapviagraorder.example/ fastcashloans.example/apply freepornclips.example/ spamclickads.example/ replicabags-sale.example/ "
     "winjackpotslots.example/ warez-crack.example/ bannerads.example/click onlinebetting.example/casino"),
    (False, "dailyscience.example/article villagelibrary.example/books cityweather.example/today gardenclub.example/meeting musicschool.example/course localhistory.example/guide familyhealth.example/advice "
     "opensoftware.example/blog footballteam.example/results artmuseum.example/show freebooks.example/catalog farmmarket.example/season"),
]


def test_classifier_on_held_out_names(spark, tables):
    words = urls.learn(spark.read.parquet(f"{tables}/pages.parquet"), spark.read.parquet(f"{tables}/documents.parquet").select("text"))
    judged = [(bad, urls.score(u.split("/", 1)[0], u.split("/", 1)[1], words) > 0) for bad, names in HELD_OUT for u in names.split()]
    assert sum(x == y for x, y in judged) >= 22 and not any(y for x, y in judged if not x)


def test_urls_of_any_length(spark):
    rows = [(1, "http://" + "cheappills" * 2000 + ".example/" + "x" * 50_000), (2, "http://" + "a/b-" * 20_000), (3, "://"), (4, "http://?q#f")]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[1]["verdict"] == "block" and got[1]["words"].startswith("cheap pills cheap pills") and len(got[1]["path"]) == 50_001
    assert got[2]["host"] == "a" and got[3]["host"] == got[4]["host"] == "" and got[4]["path"] == ""


def test_extraction(spark):
    page = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site name</header><nav><a href=x>Home</a></nav>
    <div class="ad">Buy this and that of the other in the shop.</div><div id=cookie-banner><p>We use cookies to make the site better for you and for all of us who are here.</p></div>
    <article><h1>Title &amp; more</h1><p><b>The man   and the dog went&nbsp;to the house of the lake.<br><p>Short.</p><aside>Related</aside><p>And then it was over, as it is with all of the things that we have.</p></article>
    <section class="comments"><p>I think that this is the best of all the articles that I have read in the year.</p></section><form><p>Name</p></form><footer>&copy; 2024</footer></body></html>"""
    want = "Title & more\nThe man and the dog went to the house of the lake.\nShort.\nAnd then it was over, as it is with all of the things that we have."
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p>cut &am"), (5, "u", "<div>" * 3000 + "deep" + "</div>" * 3000), (None, None, "plain text")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, n_chars int, text string")
    got = extract.extract(df).collect()
    texts = {r["page_id"]: r["text"] for r in got}
    assert texts[1] == want and texts[2] == texts[3] == "" and texts[5] == "deep" and texts[None] == "plain text" and texts[4].startswith("cut")
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert extract.extract(df.limit(0)).count() == 0


GOLD = [
    # a blog with a side column, share links and comments
    (
        """<!doctype html><html><head><meta charset=utf-8><title>My blog - Bread</title><link rel=x href=y><body class=home><div id="header"><h2>My blog</h2></div><div class="sidebar-left"><ul><li><a href=1>One</a>
        <li><a href=2>Two</a></ul></div><div id="content" class="post"><h1>How to bake bread</h1><p>It is not hard to bake a loaf of bread at home if you have the time for it and a warm oven.<p>Mix.<p>Wait for an
        hour, then put it in the oven &ndash; that&#39;s all.</p><div class="share"><a href=t>Tweet</a> <a href=f>Post</a></div></div><div id="comments"><h3>2 comments</h3><p>This is the best bread that I have ever had in my life.</p></div>
        <div class="footer">All rights reserved to the owner of this site and to all of its authors.</div></body></html>""",
        "How to bake bread\nIt is not hard to bake a loaf of bread at home if you have the time for it and a warm oven.\nMix.\nWait for an hour, then put it in the oven – that's all.",
    ),
    # no structure but paragraphs and a table of links
    (
        """<BODY><TABLE><TR><TD><A HREF="/">Home</A> | <A HREF="/news">News</A></TD></TR></TABLE><P>The city council said on Monday that the bridge will be closed for most of the summer.</P><P>Work begins in June.</P>
        <P>Those who live to the north of the river will have to use the old road, which is longer.</P><script>if (a < b) document.write("<p>no</p>")</script></BODY>""",
        "The city council said on Monday that the bridge will be closed for most of the summer.\nWork begins in June.\nThose who live to the north of the river will have to use the old road, which is longer.",
    ),
    # stray quotes, a quoted >, references, an unclosed head
    (
        """<html><head><title>Don't</title><meta name=d content="a>b"><main><h1 title=it's>Rain &amp; wind</h1><p title="x > y" data-z='"'>There was rain in the north and it was not warm in any of the towns on the coast.</p><p id=a"b>Later: sun.</p></main>""",
        "Rain & wind\nThere was rain in the north and it was not warm in any of the towns on the coast.\nLater: sun.",
    ),
    # an article of short blocks, another language, an advert and a form within
    (
        """<nav><a href=a>Start</a></nav><article><h1>Kurz</h1><p>Erstens.</p><p>Zweitens.</p><div class="ad-box">Jetzt kaufen und sparen!</div><form action=x><label>Name</label><input name=n></form><p>Drittens.</p></article><footer>Impressum</footer>""",
        "Kurz\nErstens.\nZweitens.\nDrittens.",
    ),
    # a list and a quotation in the text, links in running text, white space of all kinds
    (
        """<article>\n<p>The three\u00a0 parts are\tas follows, and each of them has\n a <a href=1>page</a> of its own on this site:</p>\n<ul><li>the first of them</li><li>the second</li></ul><blockquote>It is what it is, and that is all that there is to say about it.</blockquote></article>""",
        "The three parts are as follows, and each of them has a page of its own on this site:\nthe first of them\nthe second\nIt is what it is, and that is all that there is to say about it.",
    ),
]


@pytest.mark.parametrize("page, want", GOLD)
def test_gold_pages(page, want):
    assert extract.main_text(page) == want


def test_second_pass_matches_brute_force():
    rng = np.random.default_rng(9)
    words = "the of and is in that it".split()
    for _ in range(300):
        made = []
        for _ in range(int(rng.integers(1, 14))):
            kind, n = int(rng.integers(0, 4)), int(rng.integers(1, 4))
            text = " ".join(["zzz"] * n) if kind < 2 else " ".join(rng.choice(words, 30))
            made.append(extract.Block(text, len(text) if kind == 3 and rng.random() < 0.5 else 0, bool(rng.random() < 0.2), bool(rng.random() < 0.6), int(rng.integers(0, 4))))
        first = []
        for b in made:
            linked = b.link_chars > 0.5 * len(b.text.replace(" ", ""))
            first.append(False if b.boilerplate or linked else True if len(b.text) >= 70 else None)
        want = list(first)
        for i, b in enumerate(made):
            if first[i] is not None:
                continue
            near = []
            for same in (lambda x: x.section == b.section, lambda x: x.main == b.main, lambda x: True):  # noqa: B023
                known = [j for j, x in enumerate(made) if first[j] is not None and not x.boilerplate and same(x)]
                near = [first[max(j for j in known if j < i)]] if any(j < i for j in known) else []
                near += [first[min(j for j in known if j > i)]] if any(j > i for j in known) else []
                if near:
                    break
            want[i] = True if not near else near[0] if len(set(near)) == 1 else b.main
        assert [b.label for b in extract.classify(made)] == want


def test_extraction_is_linear():
    import time

    def took(n):
        began = time.process_time()
        for page in ("<svg>x" * n, "<p><div>" * n + "</p>" * n, "<p a='" * n + '<p b="' * n, "<!--" * n, "<title>" * n, "<" * n, "&" * n):
            extract.main_text(page)
        return time.process_time() - began

    took(500)
    assert took(16_000) < 40 * took(1_000) + 1


def test_automaton_finds_longest_matches():
    text = "abcabxabcd"
    nodes = language.Automaton(text.encode()).next
    subs = {text[i:j] for i in range(len(text)) for j in range(i + 1, len(text) + 1)}
    import itertools

    for n in range(1, 6):
        for s in map("".join, itertools.product("abcdx", repeat=n)):
            at = 0
            for c in s.encode():
                at = nodes[at].get(c)
                if at is None:
                    break
            assert (at is not None) == (s in subs)


def test_phrases_are_greedy():
    def brute(text, known):
        n = i = 0
        while i < len(text):
            k = 1
            while i + k < len(text) and text[i : i + k + 1] in known and text[i : i + k] in known:
                k += 1
            i, n = i + k, n + 1
        return n

    labelled = {"en": "the cat sat on the mat and that was that", "de": "die katze sass auf der matte und das war das"}
    model = language.learn(labelled)
    texts = ["the mat was that", "katze und matte", "zzqqé the", "t", "", "a" * 900]
    got = language.phrases(texts, model, model.symbols())
    assert got.tolist() == [[brute(t, labelled[k]) for k in model.languages] for t in texts]


def test_phrases_know_all_characters_of_all_languages():
    rng = np.random.default_rng(3)
    alphabets = {f"l{n}": [chr(0x4E00 + 900 * n + i) for i in range(400)] for n in range(3)}
    make = lambda k, n: "".join(alphabets[k][i] for i in rng.integers(0, 400, n))
    words = {k: [make(k, 3) for _ in range(60)] for k in alphabets}
    texts = {k: " ".join(w[i] for i in rng.integers(0, 60, 300)) for k, w in words.items()}
    model = language.learn({k: t[:900] for k, t in texts.items()})
    counts = language.phrases([t[900:] for t in texts.values()], model, model.symbols())
    assert (counts * model.bits).argmin(1).tolist() == [0, 1, 2]
    for (k, t), row in zip(texts.items(), counts, strict=True):
        others = [c for name, c in zip(model.languages, row, strict=True) if name != k]
        assert min(others) >= 295 * 3 // 4 and row[model.languages.index(k)] < min(others) / 2


def test_language_sample_is_whole(spark):
    words = {n: [f"{chr(97 + n % 26)}{chr(97 + n // 26)}{chr(97 + i)}" for i in range(26)] for n in range(70)}
    rows = [(100 * n + i, " ".join(words[n][(i + j) % 26] for j in range(20)), f"x{n:02d}") for n in range(70) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["lang"] == r["lang_pred"] for r in got) and len(got) == 420
    long = spark.createDataFrame([(1, "ab " * 3000 + "tail", "en"), (2, "cd " * 30000 + "ef " * 30000, "de")], docs.schema)
    sample = language.labelled_sample(long, "doc_id", "text", "lang", F.lit(True))
    assert sample["en"].endswith(" tail") and "cd cd" in sample["de"] and sample["de"].count("ef ef") > 1000
    many = spark.range(300).selectExpr("id AS doc_id", "'some words' AS text", "concat('l', id) AS lang")
    with pytest.raises(ValueError, match="256 languages"):
        language.labelled_sample(many, "doc_id", "text", "lang", F.lit(True))


def test_language_rows_and_accuracy(spark, awkward, nothing, tables):
    got = {r["doc_id"]: r for r in language.identify(awkward).collect()}
    assert got[2]["lang_pred"] == got[3]["lang_pred"] == got[6]["lang_pred"] == "und" and got[2]["score"] == 0
    assert got[None]["held_out"] is False
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language.identify(nothing).count() == 0
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    held = language.op8_language(spark, tables).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
