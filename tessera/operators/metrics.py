"""Metrics: cumulative histograms, counters, gauges, hit rates, and their text form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of duration histograms in seconds.
BUCKETS = [0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0]
MAX_SERIES = 5000


def histogram(samples: DataFrame, series: list[str], value: str, buckets: list[float] = BUCKETS) -> DataFrame:
    """(series, le, count): cumulative counts, +Inf last. One pass of conditional counts; rows are made after it."""
    counts = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(sorted(buckets))]
    g = samples.groupBy(*series).agg(*counts, F.count("*").alias("inf"), F.sum(value).alias("total"))
    rows = [F.struct(F.lit(_le(b)).alias("le"), F.col(f"b{i}").alias("count")) for i, b in enumerate(sorted(buckets))]
    return g.select(*series, F.explode(F.array(*rows, F.struct(F.lit("+Inf").alias("le"), F.col("inf").alias("count")))).alias("r"), "total").select(*series, "r.le", "r.count", F.col("total").alias("sum"))


def _le(b: float) -> str:
    return str(int(b)) if b == int(b) else repr(b)


def counter(samples: DataFrame, series: list[str], value: Column | None = None) -> DataFrame:
    return samples.groupBy(*series).agg(F.sum(value).alias("value") if value is not None else F.count("*").alias("value"))


def gauge(samples: DataFrame, series: list[str], value: str, order: list[str]) -> DataFrame:
    """The last value of each series."""
    return samples.groupBy(*series).agg(F.max_by(value, F.struct(*order)).alias("value"))


def limit_series(series: DataFrame, order: list[str], most: int = MAX_SERIES) -> DataFrame:
    """The first `most` series, and how many were dropped in each row."""
    total = series.agg(F.greatest(F.lit(0), F.count("*") - most).alias("dropped"))
    return series.orderBy(*order).limit(most).join(F.broadcast(total))


def hit_rate(lookups: DataFrame, layer: str, hit: Column) -> DataFrame:
    return lookups.groupBy(layer).agg(F.count("*").alias("lookups"), F.round(F.avg(hit.cast("int")), 6).alias("hit_rate"))


def labels_text(labels: dict[str, Column]) -> Column:
    """{k="v",...} with keys in order and values escaped."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit('"'), F.lit('\\"'))
    parts = [F.concat(F.lit(f'{k}="'), esc(labels[k].cast("string")), F.lit('"')) for k in sorted(labels)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def exposition(series: DataFrame, name: str, labels: list[str], value: str = "value") -> DataFrame:
    """Lines of the Prometheus text format."""
    return series.select(F.concat(F.lit(name), labels_text({k: F.col(k) for k in labels}), F.lit(" "), F.col(value).cast("string")).alias("line"))
