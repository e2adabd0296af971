"""The log as a stream: subscriptions, idempotent ingest, short-lived signals, windows, stability of scopes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillfold.functions import paths


def follow(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 8) -> DataFrame:
    """New files of a folder of events, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def subscribe(events: DataFrame, pattern: str | None = None, ops: tuple[str, ...] = ()) -> DataFrame:
    """Events whose target matches a glob and whose operator is one of ops."""
    out = events.where(paths.glob(F.col("target"), pattern)) if pattern else events
    return out.where(F.col("op").isin(*ops)) if ops else out


def deliver(events: DataFrame, checkpoint: str, fn: Callable[[DataFrame, int], None], once: bool = True):
    """Runs fn on every micro-batch; after a failure a batch may come again, with its number."""
    writer = events.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def once_each(events: DataFrame, key: str = "client_event_id", ts: str = "ts", late: str | None = "1 hour") -> DataFrame:
    """Each client id once; ids are remembered as long as events may be late. None: for ever, and no event is too late;
    the state then grows with the ids."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key]) if late else events.dropDuplicates([key])


def counts_per_window(events: DataFrame, by: str, ts: str, width: str = "1 hour", slide: str | None = None, late: str | None = "1 hour") -> DataFrame:
    """Tumbling windows, or sliding ones, of event time. late None: no event is too late, and every window is kept."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    events = events.withWatermark(ts, late) if late else events
    return events.groupBy(w, by).agg(F.count("*").alias("n")).select(by, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")


def sessions(events: DataFrame, by: str, ts: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("s"), by).agg(F.count("*").alias("n")).select(by, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def signals(events: DataFrame, ts: str = "ts", ttl_seconds: int = 300) -> DataFrame:
    """(target, n_live, latest): a row for each batch in which a target gets signals: those of the last five minutes of
    event time. A target without news for that long is forgotten."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        live = list(state.get[0]) if state.exists else []
        for f in frames:
            live += [int(t.timestamp()) for t in f[ts]]
        latest = max(live)
        live = [t for t in live if t > latest - ttl_seconds]
        state.update((live,))
        state.setTimeoutTimestamp(max(latest * 1000 + ttl_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"target": [key[0]], "n_live": [len(live)], "latest": [latest]})

    only = events.where("op = 'SIG'").withWatermark(ts, f"{ttl_seconds} seconds")
    return only.groupBy("target").applyInPandasWithState(update, "target string, n_live long, latest long", "live array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def stable_scopes(events: DataFrame, window: int = 5) -> DataFrame:
    """(scope, seq): whenever a scope has seen `window` events in a row that change no structure (CON, SEG and SYN do).

    Counts every event of a scope in order of seq within a batch; the state is one number a scope.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak, fired = (state.get[0] if state.exists else 0), []
        rows = pd.concat(list(frames)).sort_values("seq")
        for op, seq in zip(rows["op"], rows["seq"], strict=True):
            streak = 0 if op in ("CON", "SEG", "SYN") else streak + 1
            if streak == window:
                fired.append(seq)
                streak = 0
        state.update((streak,))
        yield pd.DataFrame({"scope": [key[0]] * len(fired), "seq": fired})

    scoped = events.withColumn("scope", paths.parent(F.col("target"))).where("scope is not null").select("scope", "op", "seq")
    return scoped.groupBy("scope").applyInPandasWithState(update, "scope string, seq long", "streak int", "append", GroupStateTimeout.NoTimeout)
