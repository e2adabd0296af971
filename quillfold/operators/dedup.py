"""Fuzzy matching of records: candidate pairs by blocking, comparison by field, scores, decisions and clusters."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillfold.functions import similarity as S
from quillfold.operators.graph import components, settled
from quillfold.operators.pairs import within


def key_blocks(records: DataFrame, fields: list[str], id_col: str = "id") -> DataFrame:
    """Pairs (a, b) with equal fingerprints of all fields. A record with an empty field is in no block.

    Equal keys are a class: the pairs of a large class are emitted only where they are asked for; see key_classes.
    """
    return within(_keyed(records, fields, id_col), ["_key"], "_id")


def _keyed(records: DataFrame, fields: list[str], id_col: str) -> DataFrame:
    prints = [S.fingerprint(F.col(f)) for f in fields]
    filled = reduce(lambda a, b: a & b, [p != "" for p in prints])
    return records.where(filled).select(F.col(id_col).alias("_id"), F.concat_ws("|", *prints).alias("_key"))


def key_classes(records: DataFrame, fields: list[str], id_col: str = "id") -> DataFrame:
    """(id, class, members): what key_blocks connects, without its pairs; a class is named by its smallest id."""
    keyed = _keyed(records, fields, id_col)
    named = keyed.groupBy("_key").agg(F.min("_id").alias("class"), F.count("*").alias("members"))
    return keyed.join(named, "_key").select(F.col("_id").alias("id"), "class", "members")


def sorted_neighbourhood(records: DataFrame, fields: list[str], window: int = 3, id_col: str = "id") -> DataFrame:
    """Pairs at most window - 1 places apart in the order of the fields' fingerprints.

    The order is global, but no task sees it whole: rows are ranged by key, numbered by range, and joined by number.
    """
    spark = records.sparkSession
    key = F.concat_ws("|", *(S.fingerprint(F.col(f)) for f in fields))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = records.select(F.col(id_col).alias("_id"), key.alias("_key")).repartitionByRange(n, "_key", "_id").withColumn("_p", F.spark_partition_id())
    ranged = settled(ranged)  # range bounds are sampled: the parts must not be drawn twice
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))  # a row a partition
    inside = Window.partitionBy("_p").orderBy("_key", "_id")
    numbered = ranged.withColumn("_r", F.row_number().over(inside)).join(F.broadcast(before), "_p").select("_id", (F.col("_before") + F.col("_r")).alias("_rank"))
    ahead = numbered.select("_id", F.explode(F.transform(F.sequence(F.lit(1), F.lit(window - 1)), lambda d: F.col("_rank") + d)).alias("_rank"))
    return ahead.alias("x").join(numbered.alias("y"), "_rank").select(F.least("x._id", "y._id").alias("a"), F.greatest("x._id", "y._id").alias("b"))


def minhash(c: Column, hashes: int = 64, n: int = 3) -> Column:
    """Minima of `hashes` hash functions over a text's character n-grams; null for a text without any."""
    s = S.fingerprint(c)
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - n + 1), lambda i: F.substring(s, i, n)))
    seeds = F.sequence(F.lit(0), F.lit(hashes - 1))
    # the array around the n-grams makes them one value that all seeds share
    mins = F.transform(F.array(grams), lambda gs: F.transform(seeds, lambda k: F.array_min(F.transform(gs, lambda g: F.xxhash64(g, k)))))
    return F.when(F.length(s) >= n, mins[0])


def lsh_pairs(records: DataFrame, fields: list[str], hashes: int = 64, bands: int = 16, id_col: str = "id") -> DataFrame:
    """Pairs that agree in a whole band of their minima. Records of equal text are one candidate, by their smallest id."""
    rows = hashes // bands
    text = F.concat_ws(" ", *(F.col(f) for f in fields))
    single = records.groupBy(S.fingerprint(text).alias("_text")).agg(F.min(id_col).alias("_id"))
    banded = single.select("_id", minhash(F.col("_text"), hashes).alias("_m")).where("_m is not null")
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.struct(b.alias("band"), F.xxhash64(F.slice("_m", b * rows + 1, rows)).alias("key")))
    banded = settled(banded.select("_id", F.explode(keys).alias("k")).select("_id", "k.band", "k.key"))  # read twice
    return within(banded, ["band", "key"], "_id").distinct()


def canopies(records: DataFrame, field_: str, loose: float = 0.3, tight: float = 0.7, id_col: str = "id", rounds: int = 20) -> DataFrame:
    """(id, canopy): records as near as `loose` to a canopy's founder that share a word with it; every record has one.

    Round by round, of the records without canopy the smallest id of each word founds one; founders as near as `tight` to
    a smaller one of the round give way to it. Rounds take the place of one greedy pass over all records, which no cluster
    can share. What has no canopy after the last round founds its own. Records without words are alone.
    """
    tokens = F.array_distinct(S.tokens(F.col(field_)))
    words = settled(records.select(F.col(id_col).alias("_id"), F.col(field_).alias("_t"), F.explode_outer(tokens).alias("_w")))
    open_, found = words, None
    for _ in range(rounds):
        heads = open_.where("_w is not null").groupBy("_w").agg(F.min_by("_t", "_id").alias("_head"), F.min("_id").alias("canopy"))
        near = words.join(heads, "_w").select("_id", "canopy", S.jaccard(F.col("_t"), F.col("_head")).alias("_s"))
        founders = heads.select(F.col("canopy").alias("_id")).distinct()
        way = near.where((F.col("_s") >= tight) & (F.col("canopy") < F.col("_id"))).join(founders, "_id", "left_semi").select(F.col("_id").alias("canopy")).distinct()
        new = settled(near.where(F.col("_s") >= loose).join(way, "canopy", "left_anti").select(F.col("_id").alias("id"), "canopy").distinct())
        found = new if found is None else found.unionByName(new)
        open_ = settled(open_.join(new.select(F.col("id").alias("_id")), "_id", "left_anti"))
        if open_.where("_w is not null").isEmpty():
            break
    rest = open_.select(F.col("_id").alias("id"), F.col("_id").alias("canopy"))
    return found.unionByName(rest).distinct()


def union_pairs(*rules: DataFrame) -> DataFrame:
    """Candidate pairs of several blocking rules, each once."""
    return reduce(lambda x, y: x.unionByName(y), rules).distinct()


@dataclass(frozen=True)
class Comparison:
    field: str
    metric: str = "jaro_winkler"
    weight: float = 1.0
    missing: str = "skip"  # or "disagree" or "agree"
    m: float = 0.9
    u: float = 0.1
    agree: float = 0.85


@dataclass(frozen=True)
class Matching:
    comparisons: tuple[Comparison, ...]
    auto: float = 0.9
    pending: float = 0.7
    scoring: str = "weighted"  # or "mean" or "fellegi_sunter"
    blocking: tuple[tuple[str, ...], ...] = field(default_factory=tuple)


#: Ready-made configurations, from exact to forgiving.
PRESETS = {
    "exact": Matching((Comparison("name", "fingerprint"),), 1.0, 1.0, "mean"),
    "phonetic": Matching((Comparison("name", "soundex"), Comparison("name", "jaro_winkler")), 0.95, 0.85, "mean"),
    "edit": Matching((Comparison("name", "levenshtein"),), 0.9, 0.8),
    "tokens": Matching((Comparison("name", "jaccard"), Comparison("name", "cosine")), 0.9, 0.6, "mean"),
    "alignment": Matching((Comparison("name", "smith_waterman"), Comparison("name", "affine_gap")), 0.92, 0.75, "mean"),
}


def _field_score(c: Comparison) -> Column:
    a, b = F.col(f"a_{c.field}"), F.col(f"b_{c.field}")
    missing = {"skip": F.lit(None).cast("double"), "disagree": F.lit(0.0), "agree": F.lit(1.0)}[c.missing]
    absent = a.isNull() | b.isNull() | (a == "") | (b == "")
    return F.when(absent, missing).otherwise(S.similarity(c.metric, a, b))


def compare(pairs: DataFrame, records: DataFrame, how: Matching, id_col: str = "id") -> DataFrame:
    """(a, b, one score per comparison, score, decision) for candidate pairs."""
    fields = sorted({c.field for c in how.comparisons})
    left = records.select(F.col(id_col).alias("a"), *(F.col(f).alias(f"a_{f}") for f in fields))
    right = records.select(F.col(id_col).alias("b"), *(F.col(f).alias(f"b_{f}") for f in fields))
    rows = pairs.join(left, "a").join(right, "b")
    names = [f"{c.field}:{c.metric}" for c in how.comparisons]
    rows = rows.withColumns({n: _field_score(c) for n, c in zip(names, how.comparisons, strict=True)})
    cols = [F.col(f"`{n}`") for n in names]
    if how.scoring == "fellegi_sunter":
        bits = [F.when(s >= c.agree, F.log2(F.lit(c.m / c.u))).when(s.isNotNull(), F.log2(F.lit((1 - c.m) / (1 - c.u)))).otherwise(0.0) for s, c in zip(cols, how.comparisons, strict=True)]
        low = sum(F.when(s.isNotNull(), F.log2(F.lit((1 - c.m) / (1 - c.u)))).otherwise(0.0) for s, c in zip(cols, how.comparisons, strict=True))
        high = sum(F.when(s.isNotNull(), F.log2(F.lit(c.m / c.u))).otherwise(0.0) for s, c in zip(cols, how.comparisons, strict=True))
        score = F.when(high > low, (sum(bits) - low) / (high - low)).otherwise(0.0)
    else:
        weights = [1.0 if how.scoring == "mean" else c.weight for c in how.comparisons]
        total = sum(F.when(s.isNotNull(), F.lit(w)).otherwise(0.0) for s, w in zip(cols, weights, strict=True))
        score = F.when(total > 0, sum(F.coalesce(s, F.lit(0.0)) * w for s, w in zip(cols, weights, strict=True)) / total).otherwise(0.0)
    decision = F.when(F.col("score") >= how.auto, "auto").when(F.col("score") >= how.pending, "pending").otherwise("rejected")
    return rows.withColumn("score", score).withColumn("decision", decision).select("a", "b", *cols, "score", "decision")


def clusters(compared: DataFrame) -> DataFrame:
    """(id, cluster): what automatic matches connect; a cluster is named by its smallest id."""
    auto = compared.where("decision = 'auto'").select(F.col("a").alias("source"), F.col("b").alias("dest"))
    return components(auto).select(F.col("node").alias("id"), F.col("component").alias("cluster"))


def job_stats(compared: DataFrame, n_records: int) -> DataFrame:
    """Counts of the decisions, and how many of all pairs were never compared."""
    possible = n_records * (n_records - 1) / 2
    return compared.agg(F.count("*").alias("pairs"), *(F.count_if(F.col("decision") == d).alias(d) for d in ("auto", "pending", "rejected"))).withColumn("reduction", 1 - F.col("pairs") / F.lit(max(possible, 1.0)))
