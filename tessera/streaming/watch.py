"""File changes: sessions, coalescing, batches and incremental index upkeep, in batch form and on streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.prefix import ranges


def sessions(changes: DataFrame, gap_ms: int = 500) -> DataFrame:
    """changes(ts, ord, path, type) with `session`: a change more than gap_ms after the one before opens a new one.

    The debounce is global, one timer for all paths, so order is global; the running count is made in two steps: ranges of
    time with about as many changes each are sorted apart, then offsets of the ranges, a few rows. No single task sorts all changes.
    """
    parts = changes.withColumn("_part", ranges(changes, "ts"))
    w = Window.partitionBy("_part").orderBy("ts", "ord")
    edge = parts.groupBy("_part").agg(F.max("ts").alias("_last"))
    before = edge.select("_part", F.lag("_last").over(Window.orderBy("_part")).alias("_end"))
    parts = parts.join(before, "_part").withColumn("_prev", F.coalesce(F.lag("ts").over(w), "_end"))
    parts = parts.withColumn("_new", (F.col("_prev").isNull() | (F.unix_micros("ts") - F.unix_micros("_prev") > gap_ms * 1000)).cast("long"))
    parts = parts.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    total = parts.groupBy("_part").agg(F.sum("_new").alias("_n"))
    offset = total.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    return parts.join(offset, "_part").withColumn("session", F.col("_run") + F.col("_offset") - 1).select(*changes.columns, "session")


def coalesce_changes(grouped: DataFrame) -> DataFrame:
    """(session, path, type, place): the last change of each path of a session, in order of first appearance."""
    g = grouped.groupBy("session", "path").agg(F.max_by("type", F.struct("ts", "ord")).alias("type"), F.min(F.struct("ts", "ord")).alias("_first"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy("session").orderBy("_first", "path"))).drop("_first")


def batches(coalesced: DataFrame, size: int = 100) -> DataFrame:
    return coalesced.withColumn("batch", F.floor((F.col("place") - 1) / size).cast("int"))


def stream_sessions(changes: DataFrame, gap: str = "500 milliseconds", late: str = "10 seconds") -> DataFrame:
    """The stream twin: (window, path, type) of session windows for each path, once the watermark has passed them."""
    g = changes.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "path")
    return g.agg(F.max_by("type", F.struct("ts", "ord")).alias("type"), F.count("*").alias("changes"))


def index_stream(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Run `apply(batch of (path, type, content), id)` for each micro-batch, one at a time, latest change of a path only."""

    def batch(df: DataFrame, epoch: int) -> None:
        last = df.groupBy("path").agg(F.max_by(F.struct("type", "content"), F.struct("ts", "ord")).alias("l")).select("path", "l.*")
        apply(last, epoch)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
