"""Queries that run as streams over the given tables, each in a new folder under spark.checkpoint.dir."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.indexing import folder
from tessera.streaming import expiry as X

TTL, TIMEOUT, PARTS = 2 * 24 * 3_600_000, 6 * 3_600_000, 4


def _streamed(spark: SparkSession, rows: DataFrame, name: str, to) -> DataFrame:
    """The rows in the order of their time, read as a stream of PARTS micro-batches at least, through `to`; what came out."""
    return X.replay(rows, "ts", PARTS, folder(spark, name), to)


def _events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def finding_dedupe_stream(spark, d):
    """finding_dedupe_ttl as a stream: state of a key goes two days after its last record."""
    rows = _events(spark, d).select(F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("key"), "ts", F.col("event_id").alias("ord"))
    return _streamed(spark, rows, "findings", lambda s: X.dedupe(s, TTL))


def session_stream(spark, d):
    """Sessions of users that have been idle for more than six hours, told as they time out."""
    rows = _events(spark, d).select(F.col("user_id").cast("string").alias("session"), "ts")
    return _streamed(spark, rows, "sessions", lambda s: X.idle_sessions(s, TIMEOUT))


def metric_stream(spark, d):
    """Histograms of each day and event type, told when the day is over by the watermark."""
    rows = _events(spark, d).select("event_type", "ts", "value")
    out = _streamed(spark, rows, "metrics", lambda s: X.windowed_histogram(s, ["event_type"], "value", "ts", "1 day", "1 hour"))
    return out.withColumn("total", F.round("total", 4)).withColumn("start", F.date_format("start", "yyyy-MM-dd"))


QUERIES = {f.__name__: f for f in (finding_dedupe_stream, session_stream, metric_stream)}
_LATEST = "(SELECT epoch_us(max(ts)) // 1000 - 3600000 FROM events)"
ORACLES = {
    "session_stream": f"""WITH e AS (SELECT user_id::VARCHAR AS session, epoch_us(ts) // 1000 AS t FROM events), g AS (SELECT session, t, CASE WHEN t - lag(t) OVER w > {TIMEOUT} THEN 1 ELSE 0 END AS cut FROM e WINDOW w AS (PARTITION BY session ORDER BY t)),
s AS (SELECT session, t, sum(cut) OVER (PARTITION BY session ORDER BY t RANGE UNBOUNDED PRECEDING) AS part FROM g), r AS (SELECT session, part, min(t) AS first_ms, max(t) AS last_ms, count(*) AS events, max(part) OVER (PARTITION BY session) AS latest FROM s GROUP BY session, part)
SELECT session, first_ms, last_ms, events FROM r WHERE part < latest OR last_ms + {TIMEOUT} <= {_LATEST}""",
    "metric_stream": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total, "
    + ", ".join(f"count(*) FILTER (value <= {b}) AS b{i}" for i, b in enumerate(X.BUCKETS))
    + f" FROM events WHERE epoch_us(date_trunc('day', ts)) // 1000 + 86400000 <= {_LATEST} GROUP BY ALL",
}
