"""Cases that the findings of round 3 name, each on a small table that gave another result, or more work, before."""

import hashlib
from datetime import datetime, timedelta

import duckdb
from pyspark.sql import functions as F

from tessera.plans import more, streams
from tessera.streaming import state as Z

HOUR = 3_600_000


def duck(**tables):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for name, path in tables.items():
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return c


def test_an_unknown_session_that_was_used_last_is_kept(spark):
    df = spark.createDataFrame([(None, 100), (1, 90), (2, 80), (None, 10)], "session bigint, at_ms bigint")
    got = {r["session"]: (r["events"], r["kept"]) for r in Z.session_states(df, 110, 1000, 2).collect()}
    assert got == {None: (2, True), 1: (1, True), 2: (1, False)}
    assert Z.session_totals(Z.session_states(df, 110, 1000, 2)).first()["kept"] == 2


def test_text_search_is_its_sql_where_words_cancel(spark, tmp_path):
    code = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
    words = [f"w{k}" for k in range(400)]
    pair = next((a, b) for a in words for b in words if code(a) % 64 == code(b) % 64 and code(a) // 64 % 2 != code(b) // 64 % 2)
    texts = ["the river " * (k % 7) + " ".join(words[k : k + k % 11]) for k in range(200)] + [" ".join(pair), "", None, "License; warranty"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    cols = ["q", "doc_id", "score", "rank"]
    got = more.text_search(spark, str(tmp_path)).select(*cols).collect()
    want = duck(documents=f"{tmp_path}/documents.parquet/*.parquet").sql(f"SELECT {', '.join(cols)} FROM ({more.ORACLES['text_search']})").fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and any("nan" in str(r) for r in want)


def test_streams_whose_ranges_have_unlike_numbers_of_files(spark, tmp_path):
    """Seven files of the first days and one of all: batches by numbers of files were not the ranges, and rows came late."""
    t0 = datetime(2024, 1, 1)
    early = [(k, t0 + timedelta(minutes=10 * (k * 37 % 1400)), k % 5, "view", 1.0) for k in range(700)]
    rest = [(700 + k, t0 + timedelta(minutes=45 * k), k % 40, "view", 1.0) for k in range(900)]
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"
    for k in range(7):
        spark.createDataFrame(early[100 * k : 100 * k + 100], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame(rest, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    got = streams.session_stream(spark, str(tmp_path)).collect()
    want = duck(events=f"{tmp_path}/events.parquet/*.parquet").sql(f"SELECT session, first_ms, last_ms, events FROM ({streams.ORACLES['session_stream']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and want


def test_a_stream_of_findings_has_state_by_buckets(spark, tmp_path):
    from tessera.streaming import expiry as X

    t0 = datetime(2024, 1, 1)
    rows = [(f"k{k % 300}", t0 + timedelta(minutes=k), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, ord bigint")
    df.write.parquet(f"{tmp_path}/in")
    q = X.run(X.dedupe(X.source(spark, f"{tmp_path}/in", df.schema, None), 7 * HOUR, buckets=8), str(tmp_path))
    assert max(X.state_rows(q)) <= 16  # a value and a timer; one of each for every key before
    got = spark.read.parquet(f"{tmp_path}/out").select("key", "at_ms", "ord", "is_new").collect()
    want = Z.dedupe_with_ttl(df.select("key", F.unix_millis("ts").alias("at_ms"), "ord"), 7 * HOUR, f"{tmp_path}/work").select("key", "at_ms", "ord", "is_new").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_calibration_holds_queries_once_and_small_cells_are_one_part(spark, tmp_path):
    import numpy as np

    from tessera.operators import vector_index as V

    x = np.random.default_rng(5).normal(size=(500, 8))
    rows = V.usable(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>"))
    index = V.VectorIndex.build(rows, str(tmp_path / "index"), cells=6)
    assert index.read().agg(F.max("part")).first()[0] == 0
    unit = np.array([r["v"] for r in rows.orderBy("id").collect()])
    got = {}
    for r in V._true_neighbours(index.read(), np.arange(20), unit[:20], 5).collect():
        got.setdefault(r["query"], {})[r["rank"]] = r["id"]
    score = unit[:20] @ unit.T
    score[np.arange(20), np.arange(20)] = -2
    assert got == {i: {k + 1: int(j) for k, j in enumerate(np.argsort(-s)[:5])} for i, s in enumerate(score)}


def test_findings_of_hot_keys_and_others_are_the_same(spark, tmp_path):
    rows = [(f"k{k * k % 7}" if k % 3 else None, None if k % 50 == 0 else 10 * (k * 31 % 900), k % 40) for k in range(1500)]
    df = spark.createDataFrame(rows, "key string, at_ms bigint, ord bigint")
    walked, leapt = (sorted(map(str, map(tuple, Z.dedupe_with_ttl(df, 700, f"{tmp_path}/{h}", hot=h).collect()))) for h in (10**6, 100))
    assert walked == leapt and len(walked) == 1500


def test_no_repeated_passage_stays_however_short(spark, tmp_path):
    import random

    from tessera.llm import line_dedup

    r = random.Random(2)
    own = lambda: " ".join(str(r.randrange(10**6)) for _ in range(9))
    passages = ["\n".join(own() for _ in range(2 + k % 3)) for k in range(60)]
    docs = [(2 * k + j, f"{own()}\n{own()}\n{p}\n{own()}") for k, p in enumerate(passages) for j in (0, 1)]
    spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: x["n_removed_lines"] for x in line_dedup.op8_line_chunks(spark, str(tmp_path)).collect()}
    assert got == {2 * k + j: j * (2 + k % 3) for k in range(60) for j in (0, 1)}


def test_chunks_and_windows_look_at_a_line_once(spark):
    """One step for both, with each passage once; before, lines were split, counted and hashed for chunks and again for windows."""
    from tessera.llm import line_dedup as L

    texts = ["\n".join(" ".join(f"w{(k * j) % 11}" for j in range(1 + (k * n) % 15)) for k in range(n)) for n in range(1, 40)] + ["", None, "a b\n\n c"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    both = df.select(L.chunks_and_windows(F.col("text")).alias("a"), F.array_union(L.chunks(F.col("text")), L.windows(F.col("text"))).alias("b")).collect()
    assert all((r["a"] is None) == (r["b"] is None) and sorted(r["a"] or []) == sorted(r["b"] or []) for r in both) and any(r["a"] for r in both)
    plan = df.select(L.chunks_and_windows(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") <= 4 and plan.count("split(") <= 4
