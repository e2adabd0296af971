"""Reading and writing: tables as collections, delimited and JSON files as records or events, the log itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillfold.operators.graph import settled

#: The event log as it is stored.
LOG_SCHEMA = T.StructType(
    [
        T.StructField("seq", T.LongType(), False),
        T.StructField("op", T.StringType(), False),
        T.StructField("target", T.StringType(), False),
        T.StructField("operand", T.MapType(T.StringType(), T.StringType())),
        T.StructField("agent", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("client_event_id", T.StringType()),
        T.StructField("branch", T.StringType()),
    ]
)
OPERATORS = ("NUL", "SIG", "INS", "SEG", "CON", "SYN", "DEF", "EVA", "REC")


def collection(df: DataFrame, name: str, key: str, root: str = "app") -> DataFrame:
    """Records of a table as state rows: target `root.name.<key>` and the other columns' text in a map."""
    fields = [c for c in df.columns if c != key]
    entries = F.map_from_arrays(F.array(*(F.lit(c) for c in fields)), F.array(*(F.col(c).cast("string") for c in fields)))
    return df.select(F.concat_ws(".", F.lit(root), F.lit(name), F.col(key).cast("string")).alias("target"), F.map_filter(entries, lambda k, v: v.isNotNull()).alias("value"))


def long_form(df: DataFrame, name: str, key: str) -> DataFrame:
    """(collection, record, field, value), a row for each value, the key's included; arrays have a row for each member."""
    entry = lambda f, v: F.struct(F.lit(f.name).alias("field"), v.cast("string").alias("value"))
    scalars = F.array(*(entry(f, F.col(f.name)) for f in df.schema if not isinstance(f.dataType, T.ArrayType)))
    # lambdas are slow, so only array fields have one
    members = lambda f: F.transform(F.col(f.name), lambda x: entry(f, x))
    lists = [F.coalesce(members(f), F.slice(scalars, 1, 0)) for f in df.schema if isinstance(f.dataType, T.ArrayType)]
    rows = df.select(F.lit(name).alias("collection"), F.col(key).cast("string").alias("record"), F.explode(F.concat(scalars, *lists) if lists else scalars).alias("x"))
    return rows.select("collection", "record", "x.field", "x.value").where("value is not null")


def coerced(cell: Column) -> Column:
    """A cell's text as the text of its value: blanks are null, numbers and booleans have one spelling."""
    t = F.trim(cell)
    number = t.try_cast("double")
    return (
        F.when(t.isNull() | (t == "") | (F.lower(t) == "null"), F.lit(None).cast("string"))
        .when(F.lower(t).isin("true", "false"), F.lower(t))
        .when(t.rlike(r"^-?[0-9]{1,15}$"), t.try_cast("long").cast("string"))
        .when(number.isNotNull() & t.rlike(r"^-?[0-9]+\.[0-9]+$"), number.cast("string"))
        .otherwise(cell)
    )


def read_delimited(spark: SparkSession, path: str, prefix: str = "app.import", delimiter: str | None = None) -> DataFrame:
    """A CSV or TSV file as INS events. Without a delimiter, the header line's most frequent one of , ; tab and | is taken.

    Ids are the rows' places, rec1 and so on, padded to equal width. They are numbered by file position: each partition's
    rows are counted first. The file is split among tasks unless a quoted field has line breaks, which one pass over its
    lines tells; such a file can't be cut at a line, so one task reads it.
    """
    if delimiter is None:
        head = spark.read.text(path).limit(1).collect()
        line = head[0][0] if head else ""
        delimiter = max(",;\t|", key=line.count)
    rows = spark.read.csv(path, header=True, sep=delimiter, multiLine=_broken(spark, path), escape='"', inferSchema=False)
    fields = rows.columns
    values = F.map_filter(F.map_from_arrays(F.array(*(F.lit(c) for c in fields)), F.array(*(coerced(F.col(f"`{c}`")) for c in fields))), lambda k, v: v.isNotNull())
    at = F.monotonically_increasing_id()
    placed = rows.select(values.alias("operand"), F.shiftright(at, 33).alias("_p"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("_i"))
    counts = {r["_p"]: r["n"] for r in placed.groupBy("_p").agg(F.count("*").alias("n")).collect()}  # a row a partition
    before, total = {}, 0
    for p in sorted(counts):
        before[p], total = total, total + counts[p]
    offsets = F.create_map(*[x for p, n in (before or {0: 0}).items() for x in (F.lit(p).cast("long"), F.lit(n).cast("long"))])
    seq = offsets[F.col("_p")] + F.col("_i") + 1
    width = max(3, len(str(total)))
    return placed.select(seq.alias("seq"), F.lit("INS").alias("op"), F.concat(F.lit(f"{prefix}.rec"), F.lpad(seq.cast("string"), width, "0")).alias("target"), "operand")


def _broken(spark: SparkSession, path: str) -> bool:
    """Whether quotes stay open at a line's end anywhere in a delimited file."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"')))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def read_events(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """A delimited file with the columns op, target, operand (JSON) and others of the log; bad operands have none."""
    rows = spark.read.csv(path, header=True, sep=delimiter, multiLine=_broken(spark, path), escape='"', inferSchema=False)
    operand = F.from_json("operand", "map<string,string>") if "operand" in rows.columns else F.lit(None).cast("map<string,string>")
    return rows.withColumn("operand", operand).where(F.col("op").isin(*OPERATORS) & F.col("target").isNotNull())


def read_json(spark: SparkSession, path: str, prefix: str = "app.import", lines: bool = False) -> DataFrame:
    """A JSON file of `{collection: [records]}` or `[records]`, as (target, value MAP); ids are `id` or a hash.

    One JSON document can't be split, so one task reads each file. With lines, every line is a document or a record of
    its own, and large files are split.
    """
    text = spark.read.text(path, wholetext=not lines).select(F.col("value").alias("j"))
    if lines:
        text = text.select(F.when(F.ltrim("j").startswith("{") & F.from_json("j", "map<string,array<map<string,string>>>").isNull(), F.concat(F.lit("["), "j", F.lit("]"))).otherwise(F.col("j")).alias("j"))
    keyed = text.select(F.explode(F.from_json("j", "map<string,array<map<string,string>>>")).alias("c", "rs")).select("c", F.explode("rs").alias("value"))
    plain = text.select(F.lit("records").alias("c"), F.explode(F.from_json("j", "array<map<string,string>>")).alias("value"))
    rows = keyed.unionByName(plain)
    key = F.coalesce(F.col("value")["id"], F.substring(F.sha2(F.to_json("value"), 256), 1, 12))
    return rows.select(F.concat_ws(".", F.lit(prefix), "c", key).alias("target"), "value")


def append(log: DataFrame, path: str) -> DataFrame:
    """Appends events to the log at path, partitioned by operator, leaving out client ids that it holds; returns what was new."""
    spark = log.sparkSession
    try:
        there = spark.read.parquet(path).select("client_event_id").where("client_event_id is not null").distinct()
        new = log.join(there, "client_event_id", "left_anti").select(*log.columns)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        new = log
    new = settled(new)  # it must not be read again after the log has it
    new.write.mode("append").partitionBy("op").parquet(path)
    return new


def normalised(raw: Column, kind: str) -> Column:
    """A remote system's field as a plain value: ids of links, attachments and collaborators, the text of scalars."""
    if kind in ("linkedRecord", "attachment", "collaborators", "multiSelect"):
        ids = F.from_json(raw, "array<struct<id:string,name:string,url:string>>")
        plain = F.from_json(raw, "array<string>")
        return F.array_join(F.coalesce(F.filter(F.transform(ids, lambda x: F.coalesce(x["id"], x["name"], x["url"])), lambda x: x.isNotNull()), plain), ",")
    if kind == "collaborator":
        return F.coalesce(F.get_json_object(raw, "$.id"), F.get_json_object(raw, "$.name"))
    return coerced(raw)


FIELD_CLASSES = {"def": ("text", "richText", "email", "url", "phone", "number", "currency", "percent", "rating", "duration", "select", "multiSelect", "date", "boolean", "attachment"), "con": ("linkedRecord", "link", "relationship"), "eva": ("formula", "rollup", "lookup", "count"), "skip": ("autoNumber", "createdTime", "lastModifiedTime", "createdBy", "lastModifiedBy")}


def field_class(kind: Column) -> Column:
    """What becomes of a remote field: defined, connected, computed or left out."""
    return F.coalesce(*(F.when(kind.isin(*kinds), name) for name, kinds in FIELD_CLASSES.items()), F.lit("def"))
