"""Streams whose keyed state expires: finding deduplication with TTL, idle sessions, windowed metrics.

State lies in RocksDB on the executors and in the query's checkpoint, by key; a timer in event time clears a key once the watermark
has passed the time after which it can't matter, so state follows the keys in use and not all keys ever seen.
The batch forms in state.py and metrics.py give the same rows.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from tessera.operators.metrics import BUCKETS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Buckets of keys of a deduplicated stream; the number stays with a checkpoint.
BUCKETED = 1024


class _Dedupe(StatefulProcessor):
    """Per bucket of keys the time of each key's last recorded finding; a key goes once ttl has passed since that time."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "keys array<string>, at_ms array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        p = pd.concat(list(rows)).sort_values(["at_ms", "ord"])
        keys, at_ms = self.seen.get() if self.seen.exists() else ([], [])
        last, seen, new = max(at_ms, default=None), dict(zip(keys, at_ms, strict=True)), []
        for k, at in zip(p["key"].tolist(), p["at_ms"].tolist(), strict=True):
            before = seen.get(k)
            fresh = before is None or at - before > self.ttl_ms
            if fresh:
                seen[k] = at
            new.append(fresh)
        passed = timerValues.getCurrentWatermarkInMs()
        held = {k: at for k, at in seen.items() if at + self.ttl_ms >= passed}  # no row earlier than the watermark comes any more
        self.seen.update((list(held), list(held.values())))
        if (now := max(held.values(), default=None)) != last:
            if last is not None:
                self.handle.deleteTimer(last + self.ttl_ms)
            if now is not None:
                self.handle.registerTimer(now + self.ttl_ms)
        yield p[["key", "at_ms", "ord"]].assign(is_new=new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        yield pd.DataFrame({"key": pd.Series(dtype=str), "at_ms": pd.Series(dtype="int64"), "ord": pd.Series(dtype="int64"), "is_new": pd.Series(dtype=bool)})

    def close(self) -> None:
        pass


def dedupe(findings: DataFrame, ttl_ms: int, late: str = "1 hour", buckets: int = BUCKETED) -> DataFrame:
    """findings(key string, ts timestamp, ord bigint) as they come, with at_ms and is_new: never seen, or last recorded more than ttl_ms ago.

    A duplicate doesn't refresh the record. Batches must come in the order of time but for `late`; rows of a batch are sorted. Keys
    are met in `buckets` by their hash, so that a batch costs a call of Python for each bucket and not for each key; a bucket holds
    the keys that are alive.
    """
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int").alias("bucket")
    rows = findings.select(bucket, "key", "ts", F.unix_millis("ts").alias("at_ms"), "ord").withWatermark("ts", late)
    return rows.groupBy("bucket").transformWithStateInPandas(_Dedupe(ttl_ms), "key string, at_ms bigint, ord bigint, is_new boolean", "Append", "EventTime")


class _Sessions(StatefulProcessor):
    """Per session its first and last event and their number; it ends when it was idle for longer than the timeout."""

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", "first_ms bigint, last_ms bigint, events bigint")

    @staticmethod
    def _told(key, ended: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *e) for e in ended], columns=["session", "first_ms", "last_ms", "events"]).astype({"first_ms": "int64", "last_ms": "int64", "events": "int64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = self.state.get() if self.state.exists() else None
        old, ended = now, []
        for at in sorted(x for b in rows for x in b["at_ms"].tolist()):
            if now is not None and at - now[1] > self.timeout_ms:
                ended.append(tuple(now))
                now = None
            now = (at, at, 1) if now is None else (min(now[0], at), max(now[1], at), now[2] + 1)
        if old is not None:
            self.handle.deleteTimer(old[1] + self.timeout_ms)
        self.state.update(now)
        self.handle.registerTimer(now[1] + self.timeout_ms)
        yield self._told(key, ended)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = tuple(self.state.get())
        self.state.clear()
        yield self._told(key, [now])

    def close(self) -> None:
        pass


def idle_sessions(events: DataFrame, timeout_ms: int, late: str = "1 hour") -> DataFrame:
    """(session, first_ms, last_ms, events) of sessions of events(session string, ts timestamp) once they have timed out."""
    rows = events.select("session", "ts", F.unix_millis("ts").alias("at_ms")).withWatermark("ts", late)
    return rows.groupBy("session").transformWithStateInPandas(_Sessions(timeout_ms), "session string, first_ms bigint, last_ms bigint, events bigint", "Append", "EventTime")


def windowed_histogram(samples: DataFrame, series: list[str], value: str, ts: str, every: str, late: str, buckets: list[float] = BUCKETS) -> DataFrame:
    """(start, series.., n, total, b0, b1, ..) for each window: cumulative counts that can be added over windows. A window is told
    when the watermark has passed it; rows that come later than that are dropped, see dropped()."""
    counts = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(sorted(buckets))]
    g = samples.withWatermark(ts, late).groupBy(F.window(ts, every).alias("w"), *series)
    return g.agg(F.count("*").alias("n"), F.sum(value).alias("total"), *counts).select(F.col("w.start").alias("start"), *series, "n", "total", *(f"b{i}" for i in range(len(buckets))))


def in_ranges(df: DataFrame, by: str, parts: int) -> Iterator[DataFrame]:
    """df in `parts` ranges of `by`, in order; nulls are in the first."""
    x = F.col(by).cast("double")
    bounds = df.select(x.alias("x")).approxQuantile("x", [k / parts for k in range(1, parts)], 0.01) if parts > 1 else []
    for lo, hi in zip([None, *bounds], [*bounds, None], strict=True):
        own = (x > lo if lo is not None else F.lit(True)) & (x <= hi if hi is not None else F.lit(True))
        yield df.where(own | x.isNull() if lo is None else own) if bounds else df


def staged(df: DataFrame, by: str, parts: int, folder: str) -> None:
    """df as files in the order of `by`, one write for each of `parts` ranges, so that a stream of the folder meets them in order."""
    for part in in_ranges(df, by, parts):
        part.write.mode("append").parquet(folder)


def source(spark: SparkSession, folder: str, schema, files: int | None = 1) -> DataFrame:
    """The files of a folder as a stream, `files` in each micro-batch (None: all that are new), oldest first."""
    stream = spark.readStream.schema(schema)
    return (stream.option("maxFilesPerTrigger", files) if files else stream).parquet(folder)


def replay(df: DataFrame, by: str, parts: int, folder: str, to: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """df as a stream through `to`, each of `parts` ranges of `by` in a micro-batch of its own; what came out.

    A range is written, then the stream goes on from its checkpoint with all new files: however many files a range has, no
    row of it comes after the watermark has passed it.
    """
    spark = df.sparkSession
    for part in in_ranges(df, by, parts):
        part.write.mode("append").parquet(f"{folder}/in")
        run(to(source(spark, f"{folder}/in", df.schema, None)), folder)
    return spark.read.parquet(f"{folder}/out")


def run(stream: DataFrame, folder: str) -> StreamingQuery:
    """Runs a stream over all that its source holds now, into Parquet under folder/out, state in RocksDB; the finished query."""
    conf, key = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(key, None)
    conf.set(key, ROCKSDB)
    try:
        q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        with contextlib.ExitStack() as stack:
            stack.callback(q.stop)
            q.awaitTermination()
    finally:
        conf.unset(key) if before is None else conf.set(key, before)
    return q


def dropped(query: StreamingQuery) -> int:
    """Rows that came after the watermark had passed them, counted by the state operators (partly aggregated rows count once)."""
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)


def state_rows(query: StreamingQuery) -> list[int]:
    """Keys in state after each micro-batch."""
    return [sum(s.numRowsTotal for s in p.stateOperators) for p in query.recentProgress]
