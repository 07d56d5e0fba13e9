import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.operators import metrics as M
from tessera.plans import streams
from tessera.streaming import expiry as X
from tessera.streaming import state as Z

SF = "/root/testdata/sf0.001"
HOUR = 3_600_000


def events(spark, n=600):
    import random

    r = random.Random(3)
    t0 = datetime(2024, 1, 1)
    rows = [(f"k{r.randrange(n // 20) + k // 60 * 5}", t0 + timedelta(seconds=600 * k + r.randrange(600)), k) for k in range(n)]
    rows += [(rows[5][0], rows[5][1], n + j) for j in range(3)]
    return spark.createDataFrame(rows, "key string, ts timestamp, ord bigint")


def stage(spark, df, path, parts):
    X.staged(df, "ts", parts, f"{path}/in")
    return X.source(spark, f"{path}/in", df.schema, files=len(os.listdir(f"{path}/in")) // parts or 1)


@pytest.mark.parametrize("parts", [1, 5])
def test_stream_of_findings_is_the_batch_and_forgets(spark, tmp_path, parts):
    df = events(spark).coalesce(1)
    q = X.run(X.dedupe(stage(spark, df, tmp_path, parts), 6 * HOUR), str(tmp_path))
    got = {(r["key"], r["at_ms"], r["ord"]): r["is_new"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = Z.dedupe_with_ttl(df.select("key", F.unix_millis("ts").alias("at_ms"), "ord"), 6 * HOUR, f"{tmp_path}/work").collect()
    assert got == {(r["key"], r["at_ms"], r["ord"]): r["is_new"] for r in want} and 0 < sum(got.values()) < len(got)
    keys, rows = df.select("key").distinct().count(), X.state_rows(q)
    assert rows[-1] < keys and (parts == 1 or max(rows) < 2.5 * keys)  # a key's value and its timer


def test_stream_of_sessions(spark, tmp_path):
    df = events(spark).coalesce(1)
    X.run(X.idle_sessions(stage(spark, df.withColumnRenamed("key", "session"), tmp_path, 4), 3 * HOUR), str(tmp_path))
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    times = {}
    for r in df.collect():
        times.setdefault(r["key"], []).append(int(r["ts"].timestamp() * 1000))
    want, end = [], max(map(max, times.values())) - HOUR
    for k, own in times.items():
        own.sort()
        first, n = own[0], 0
        for at, nxt in zip(own, own[1:] + [None], strict=True):
            n += 1
            if nxt is None or nxt - at > 3 * HOUR:
                if nxt is not None or at + 3 * HOUR <= end:
                    want.append((k, first, at, n))
                first, n = nxt, 0
    assert got == sorted(want) and want


def test_windows_are_told_once_and_late_rows_counted(spark, tmp_path):
    schema = "at timestamp, kind string, value double"
    t0 = datetime(2024, 1, 1)
    early = [(t0 + timedelta(minutes=k), "a" if k % 3 else "b", k / 10) for k in range(600)]
    for part in (early, [(t0 + timedelta(hours=30), "a", 1.0)], [(t0 + timedelta(hours=1), "a", 5.0), (t0 + timedelta(hours=31), "b", 0.5)], [(t0 + timedelta(hours=60), "a", 2.0)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    q = X.run(X.windowed_histogram(X.source(spark, f"{tmp_path}/in", schema), ["kind"], "value", "at", "1 hour", "2 hours"), str(tmp_path))
    out = spark.read.parquet(f"{tmp_path}/out")
    assert X.dropped(q) == 1 and out.groupBy("start", "kind").count().where("count > 1").count() == 0
    told = {r["kind"]: r["n"] for r in out.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    assert told == {"a": 401, "b": 201}
    whole = M.histogram(spark.createDataFrame(early, schema), ["kind"], "value").collect()
    sums = {r["kind"]: r for r in out.where("start < '2024-01-01 12:00:00'").groupBy("kind").agg(*(F.sum(f"b{i}").alias(f"b{i}") for i in range(len(M.BUCKETS)))).collect()}
    assert all(sums[r["kind"]][f"b{[M._le(b) for b in M.BUCKETS].index(r['le'])}"] == r["count"] for r in whole if r["le"] != "+Inf")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_streams_over_the_table_are_their_batches(spark):
    from tessera.plans import upkeep

    got = streams.finding_dedupe_stream(spark, SF)
    want = upkeep.finding_dedupe_ttl(spark, SF).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    n = {r["event_type"]: r["n"] for r in streams.metric_stream(spark, SF).groupBy("event_type").agg(F.sum("n").alias("n")).collect()}
    last = spark.read.parquet(f"{SF}/events.parquet").agg(F.date_trunc("day", F.max("ts") - F.expr("interval 1 hour"))).first()[0]
    batch = upkeep._events(spark, SF).where(F.col("ts") < F.lit(last)).groupBy("event_type").count().collect()
    assert n == {r["event_type"]: r["count"] for r in batch}
