"""URL filter: rules by host and path, and a classifier of the words that hosts and paths are made of.

Names such as `cheappillsonline` are split by a unigram Viterbi: a word costs by its count in all texts and all URLs, an
unknown one by its length. Multinomial naive Bayes, trained from a small labelled table of URLs, then scores the words. A
rule that fits decides before the classifier does.

A null URL, or one without `://`, has an empty host and path, no rule and no words; the classifier's prior decides. URLs
are read whole, in time that grows with their length alone. A tie of splits goes to the one whose last word is longer, a
score of 0 allows. Every row is judged alone, repeated rows get equal results, further columns are ignored, an empty table
gives an empty result. Without texts the words of the labelled URLs are the lexicon.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfold.llm.common import map_batches, raw, table, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, start of the path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Labelled URLs from which the classifier learns by default: names of kinds of sites, made up for this table.
BLOCKED = (
    "best-casino-bonus.example/slots", "online-poker-bets.example/win", "cheap-viagra-pharmacy.example/order", "free-porn-tube.example/adult", "sexcam-live.example/xxx",
    "loan-cash-now.example/apply", "winbigcasino.example/jackpot", "buycheappills.example/pharmacy", "adtracker.example/banner", "clickfarm.example/ads",
    "spamoffers.example/deal", "freebetsonline.example/bonus", "replica-watches.example/cheap", "hotadult.example/sex", "torrent-warez.example/crack",
    "casino-royal-spins.example/roulette", "bet-and-win-slots.example/betting", "viagra-cialis-pills.example/buy", "diet-pills-miracle.example/offer", "payday-loans-fast.example/cash",
    "xxx-videos-adult.example/porn", "escort-girls.example/sex", "spam-mailer.example/bulk", "popup-ads-network.example/click", "tracking-pixel-ads.example/track",
    "link-farm-seo.example/backlinks", "keygen-crack-serial.example/warez", "crypto-doubler-win.example/free", "lottery-winner-prize.example/claim", "cheap-replica-bags.example/sale",
    "pharmacy-pills-discount.example/order", "gambling-odds-bets.example/casino", "adserver-banner.example/ad", "content-farm-spam.example/clickbait", "hot-singles-cam.example/chat",
)
ALLOWED = (
    "news-daily.example/world", "city-library.example/catalog", "open-science.example/article", "gardenblog.example/post", "university.example/course",
    "weather-report.example/today", "history-museum.example/guide", "cookingschool.example/recipe", "local-sports.example/team", "musicreview.example/album",
    "travelguide.example/city", "healthcentre.example/advice", "bookclub.example/review", "artgallery.example/show", "technews.example/blog",
    "familydoctor.example/home", "schoolboard.example/meeting", "webforum.example/thread", "townhall.example/minutes", "sciencedaily.example/study",
    "farm-and-garden.example/season", "organic-farm-shop.example/order", "free-software.example/download", "free-library-online.example/books", "best-hikes.example/track",
    "running-track-club.example/results", "public-health.example/pills", "hospital-pharmacy.example/contact", "bank-of-the-valley.example/loan", "film-society.example/videos",
    "chess-online.example/win", "county-fair.example/prize", "watchmaker.example/watches", "village-market.example/offer", "second-hand-books.example/cheap",
    "railway-timetable.example/now", "language-course.example/live", "radio-station.example/live", "parish-church.example/sunday", "bird-watching.example/club",
    "mountain-rescue.example/call", "open-data-portal.example/dataset", "student-union.example/vote", "theatre-season.example/tickets", "cycling-map.example/route",
)


def _parts(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The rule that fits, written host and path, and its verdict. The longest is the one of the most characters; of
    equal ones the later in the list."""
    name = verdict = F.lit(None).cast("string")
    for rule_host, start, what in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(start)
        name, verdict = F.when(fits, rule_host + start).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


@dataclass(frozen=True)
class Words:
    """Lexicon with costs, and the classifier. The lexicon has MAX_WORDS words and those of the labelled table at most."""

    cost: dict[str, float]
    unknown: tuple[float, float]  # of a word that isn't there: once, and for each letter
    longest: int
    block: dict[str, float]
    allow: dict[str, float]
    prior: float


def segment(name: str, words: Words) -> list[str]:
    """The cheapest split of a name. Linear in its length."""
    n, (once, letter) = len(name), words.unknown
    best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
    low, at = 0.0, 0  # the cheapest start of an unknown word, less its letters so far
    for end in range(1, n + 1):
        cost, start = low + once + letter * end, at
        for i in range(max(0, end - words.longest), end):
            if (w := words.cost.get(name[i:end])) is not None and best[i] + w < cost:
                cost, start = best[i] + w, i
        best[end], back[end] = cost, start
        if cost - letter * end < low:
            low, at = cost - letter * end, end
    out = []
    while n:
        out.append(name[back[n] : n])
        n = back[n]
    return out[::-1]


_SPLIT = re.compile(r"[^a-z]+")
#: Parts of names that say nothing about a site.
COMMON = frozenset("www m blog com org net example html htm php index en de fr es".split())


def tokens(host: str, path: str, words: Words) -> list[str]:
    found = [w for part in _SPLIT.split(host) if part and part not in COMMON for w in segment(part, words)]
    return found + [w for part in _SPLIT.split(path.lower()) if part and part not in COMMON for w in segment(part, words)]


#: The lexicon's bound, and what is no word of a name: it is longer, or it is one letter.
MAX_WORDS, LONGEST = 50_000, 24
FLUSH = 400_000
_MARKS = b".,;:!?()[]{}<>\"'*_-"


def _count(batches):
    """Words of a partition's texts with their counts, in a few parts if there are very many; words are ASCII letters."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
    seen: Counter[bytes] = Counter()

    def out():
        kept = [(w.decode(), n) for w, n in seen.items() if 1 < len(w) <= LONGEST and w.isalpha()]
        seen.clear()
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], schema=schema)

    for batch in batches:
        for text in raw(batch.column(0)):
            seen.update([w.strip(_MARKS) for w in text.lower().split()])
        if len(seen) > FLUSH:
            yield out()
    yield out()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over all of the one column's texts."""
    return map_batches(texts, _count, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


def lexicon(pages: DataFrame, texts: DataFrame | None, url_col: str = "url", max_words: int = MAX_WORDS) -> tuple[dict[str, int], int]:
    """The max_words most frequent words of all texts (one column) and all URLs, with the number of all words.

    Of URLs, words are what names write apart, such as `best-casino-bonus`; a name in one piece may be several words.
    """
    host, path = _parts(F.col(url_col))
    apart = F.filter(F.split(F.concat_ws("/", host, F.lower(path)), r"[^a-z_-]+"), lambda x: x.rlike("[a-z][_-]+[a-z]"))
    sources = pages.select(F.regexp_replace(F.array_join(apart, " "), "[_-]+", " ").alias("t"))
    if texts is not None:
        sources = sources.unionByName(texts.toDF("t"))
    counts = written(word_counts(sources))
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    # a threshold first, so that each task sends only its share of the lexicon to the driver
    least = counts.agg(F.percentile_approx("c", 1 - max_words / total["v"], 100_000)).first()[0] if total["v"] > max_words else 0
    top = counts.where(F.col("c") > least).orderBy(F.col("c").desc(), "word").limit(max_words).collect()
    return {r["word"]: r["c"] for r in top}, total["n"]


def learn(pages: DataFrame, texts: DataFrame | None = None, url_col: str = "url", blocked=BLOCKED, allowed=ALLOWED) -> Words:
    """The lexicon from all pages and texts, the classifier from the labelled URLs. The words that labelled URLs write
    apart are in the lexicon whatever the texts have: each counts as one of those in the middle of it."""
    counts, total = lexicon(pages, texts, url_col)
    common = sorted(counts.values())[len(counts) // 2] if counts else 1
    for url in (*blocked, *allowed):
        for w in _SPLIT.split(url):
            if 1 < len(w) <= LONGEST and w not in COMMON and counts.get(w, 0) < common:
                counts[w] = common
    total = max(total, sum(counts.values()))
    cost = {w: math.log(total / c) for w, c in counts.items()}
    words = Words(cost, (math.log(total), math.log(10)), max(map(len, cost), default=1), {}, {}, 0.0)
    found = [Counter(w for url in urls for w in tokens(*url.split("/", 1), words)) for urls in (blocked, allowed)]
    vocabulary = set(found[0]) | set(found[1])
    size = [sum(c.values()) + len(vocabulary) + 1 for c in found]
    block, allow = ({w: math.log((c[w] + 1) / n) for w in vocabulary} for c, n in zip(found, size, strict=True))
    # words that neither list has are evidence of nothing
    return Words(cost, words.unknown, words.longest, block, allow, math.log((len(blocked) + 1) / (len(allowed) + 2)))


def score(host: str, path: str, words: Words) -> float:
    """Log odds that the URL should be blocked."""
    return words.prior + sum(words.block[w] - words.allow[w] for w in tokens(host, path, words) if w in words.block)


_ARROW = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string()), ("score", pa.float64()), ("words", pa.string())])
SCHEMA = "page_id long, host string, path string, rule string, verdict string, score double, words string"


def _judge(batches, words):
    words, known = words.value, {}
    for batch in batches:
        hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        got = []
        for key in zip(hosts, (re.sub(r"[^A-Za-z]+", "/", p) for p in paths), strict=True):
            if key not in known:
                if len(known) > 50_000:
                    known.clear()
                known[key] = score(*key, words), " ".join(tokens(*key, words))
            got.append(known[key])
        scores = [s for s, _ in got]
        verdict = [v or ("block" if s > 0 else "allow") for v, s in zip(batch.column(4).to_pylist(), scores, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), batch.column(2).cast(pa.string()), batch.column(3).cast(pa.string()), pa.array(verdict, pa.string()), pa.array(scores, pa.float64()), pa.array([w for _, w in got], pa.string())], schema=_ARROW)


def judge(pages: DataFrame, words: Words | None = None, rules=RULES, id_col: str = "page_id", url_col: str = "url", texts: DataFrame | None = None) -> DataFrame:
    """One row with host, path, rule, verdict, the classifier's score and the words it saw for each row of pages."""
    words = pages.sparkSession.sparkContext.broadcast(words or learn(pages, texts, url_col))  # some MB at most
    host, path = _parts(F.col(url_col))
    split = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return map_batches(split.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule")), functools.partial(_judge, words=words), SCHEMA)


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), texts=table(spark, sf_dir, "documents").select("text"))
