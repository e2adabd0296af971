"""Discovering links in untyped collections: id fields, references, co-occurrence.

long: (collection, record, field, value), a row for each value; an array field has a row for each member.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillfold.operators.graph import settled
from quillfold.operators.pairs import within

#: Fixed shapes of ids: letters-digits, UUID, digits only, prefix_suffix.
ID_PATTERNS = {"prefixed": r"^[A-Za-z]+-\d+$", "uuid": r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", "number": r"^\d+$", "record": r"^[A-Za-z]+_?[A-Za-z0-9]{6,}$"}


def counted(long: DataFrame) -> DataFrame:
    """(collection, field, value, n): how often each field has each value; id_fields and references can share it."""
    return long.groupBy("collection", "field", "value").agg(F.count("*").alias("n"))


def id_fields(long: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """The id field of each collection: its values are there in every record and all differ; `id` before `*_id` before others.

    counts: counted(long), where it is there already. Only fields whose values all differ have their records counted.
    """
    values = (counted(long) if counts is None else counts).where("value is not null")
    stats = values.groupBy("collection", "field").agg(F.sum("n").alias("n"), F.count("*").alias("distinct_values"), *(F.avg(F.col("value").rlike(p).cast("int")).alias(f"p_{k}") for k, p in ID_PATTERNS.items()))
    differ = settled(stats.where("n = distinct_values"))  # at most a row a field
    records = long.join(F.broadcast(differ.select("collection", "field")), ["collection", "field"], "left_semi").groupBy("collection", "field").agg(F.count_distinct("record").alias("records"))
    sizes = long.groupBy("collection").agg(F.count_distinct("record").alias("size"))
    unique = differ.join(records, ["collection", "field"]).join(sizes, "collection").where("records = size and n = size")
    rank = F.when(F.lower("field") == "id", 0).when(F.lower("field").endswith("_id"), 1).otherwise(2)
    pattern = F.coalesce(*(F.when(F.col(f"p_{k}") >= 0.9, k) for k in ID_PATTERNS))
    return unique.groupBy("collection").agg(F.min_by(F.struct("field", pattern.alias("pattern")), F.struct(rank.alias("r"), F.col("field").alias("f"))).alias("x"), F.max("size").alias("records")).select("collection", "x.field", "x.pattern", "records")


def references(long: DataFrame, ids: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Fields whose values are ids of a collection's records: (collection, field, target, n, share of the field's values).

    ids: (collection, field) as of id_fields; counts: counted(long), where it is there already.
    """
    i = settled(ids.select(F.col("collection").alias("_c"), F.col("field").alias("_f")))  # a row a collection, used twice
    # counts per value first: a value that very many records hold meets its id once
    values = counted(long) if counts is None else counts
    is_id = (F.col("collection") == F.col("_c")) & (F.col("field") == F.col("_f"))
    known = values.join(F.broadcast(i), is_id).select(F.col("collection").alias("target"), F.col("value").alias("_id"))
    others = values.join(F.broadcast(i), is_id, "left_anti")
    sizes = others.groupBy("collection", "field").agg(F.sum("n").alias("values"))
    hits = others.join(known, others["value"] == known["_id"]).groupBy("collection", "field", "target").agg(F.sum("n").alias("n"))
    return hits.join(sizes, ["collection", "field"]).withColumn("share", F.col("n") / F.col("values"))


def resolve(long: DataFrame, field: str, ids: DataFrame, delimiter: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Matched (record, value, target) and unmatched (record, value) references of a field; ids: (target, id)."""
    values = F.split(F.col("value"), F.lit(f"\\Q{delimiter}\\E")) if delimiter else F.array("value")
    refs = long.where(F.col("field") == field).select("record", F.explode(F.filter(F.transform(values, F.trim), lambda v: v != "")).alias("value"))
    matched = refs.join(ids, refs["value"] == ids["id"]).select("record", "value", "target")
    return matched, refs.join(ids, refs["value"] == ids["id"], "left_anti")


def keyed_events(long: DataFrame, prefix: str = "import", least: float = 0.5) -> DataFrame:
    """Keyed collections as events (op, target, field, value): INS of every record with a row a field; CON of every
    reference to a record of another or the same collection (field is the edge's type, value its target); DEF of each
    reference field's type, `link`; DEF of every other field but the id.

    Fields of which at least a share of `least` values are ids of a collection are references to it; of several the one
    with most. Records without an id field keep their name in `record`.
    """
    counts = settled(counted(long))  # the one aggregate of all values; what follows reads it
    ids = settled(id_fields(long, counts))
    found = references(long, ids, counts).where(F.col("share") >= least)
    links = settled(found.groupBy("collection", "field").agg(F.max_by("target", F.struct("n", "target")).alias("to")))  # a row a field
    i = ids.select("collection", F.col("field").alias("id_field"))
    known = long.join(F.broadcast(i), "collection").where("field = id_field").select("collection", "record", F.col("value").alias("id"))
    rows = long.join(F.broadcast(links), ["collection", "field"], "left").join(F.broadcast(i), "collection", "left")
    # a record that is called by its id needs no look-up of it
    renamed = known.where("not (record <=> id)")
    called = lambda df: df.withColumn("id", F.lit(None).cast("string")) if plain else df.join(renamed, ["collection", "record"], "left")
    plain = renamed.isEmpty()
    target = F.concat_ws(".", F.lit(prefix), "collection", F.coalesce("id", "record")).alias("target")
    link = F.col("to").isNotNull()
    own = ~link & ~F.col("field").eqNullSafe(F.col("id_field"))
    made = called(rows).select(F.explode(F.when(own, F.array(F.lit("INS"), F.lit("DEF"))).otherwise(F.array(F.lit("INS")))).alias("op"), target, "field", "value")
    ends = counts.join(F.broadcast(i), "collection").where("field = id_field").select(F.col("collection").alias("to"), "value")
    con = called(rows.where(link).join(ends, ["to", "value"], "left_semi")).select(F.lit("CON").alias("op"), target, "field", F.concat_ws(".", F.lit(prefix), "to", "value").alias("value"))
    types = links.select(F.lit("DEF").alias("op"), F.concat_ws(".", F.lit(prefix), "collection", F.lit("_schema"), "field", F.lit("type")).alias("target"), F.lit("link").alias("field"), F.concat_ws(".", F.lit(prefix), "to").alias("value"))
    return made.unionByName(con).unionByName(types)


def co_occurrence(items: DataFrame, group: str, item: str, least: int = 1) -> DataFrame:
    """Unordered pairs of items that groups hold together, with the number of groups. items: a row for each member."""
    one = settled(items.select(F.col(group).alias("_g"), F.col(item).alias("_i")).dropna().distinct())  # read twice
    return within(one, ["_g"], "_i").groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def normal_ids(value: Column, delimiter: str = ",") -> Column:
    return F.filter(F.transform(F.split(value, delimiter), F.trim), lambda v: v != "")
