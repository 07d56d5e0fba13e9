"""The whole job where an operator once did a part of it."""

import os
import random

import brute
import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import line_dedup, mixing


@pytest.mark.parametrize("least_words", [1, 5, 12])
def test_chunks_against_brute_force(spark, least_words):
    r = random.Random(least_words)
    pool = ["", "  ", "a", "b c", "one two three", "x " * 7 + "y", "long " * 20, "é ö ü", "d\te"]
    own = lambda: "\n".join(f"line {r.randrange(10**6)} of its own" for _ in range(r.randint(0, 5)))
    block = "\n".join(f"line {k} of a long passage" for k in range(120))
    docs = {i: "\n".join(r.choice(pool) for _ in range(r.randint(1, 9))) for i in range(60)} | {60: None, 61: "", 62: "\n\n", 63: "b c\n" * 130, 64: "long " * 20, 65: "b c\na\n" * 70}
    docs |= {i: f"{own()}\n{block}\n{own()}" for i in range(66, 70)} | {i: f"{own()}\n\n{docs[i - 60]}\n \n{own()}" for i in range(70, 120)}
    out = {x["row"]["doc_id"]: x for x in line_dedup.dedup_lines(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string"), least_words=least_words).collect()}
    want = brute.line_chunks(docs, least_words=least_words)
    assert {i: x["kept_text"] for i, x in out.items()} == want
    assert all(x["n_removed_lines"] == (docs[i] or "").count("\n") + 1 - (want[i] or "").count("\n") - 1 for i, x in out.items() if docs[i] is not None and want[i] != "")


@pytest.mark.parametrize("n,share", [(2, 0.35), (3, 0.6), (4, 0.75), (6, 0.9), (8, 0.95), (20, 1.0)])
def test_shares_of_passages_that_go_whole(spark, n, share):
    """Passages of n lines between lines of their own: the share in README.md, by boundaries that follow the lines."""
    r = random.Random(n)
    own = lambda: " ".join(str(r.randrange(10**6)) for _ in range(9))
    passages = ["\n".join(own() for _ in range(n)) for _ in range(300)]
    docs = [(2 * k + j, f"{own()}\n{own()}\n{p}\n{own()}") for k, p in enumerate(passages) for j in (0, 1)]
    out = {x["row"]["doc_id"]: x["n_removed_lines"] for x in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert all(out[2 * k] == 0 and out[2 * k + 1] in (0, n) for k in range(300))
    assert sum(out[2 * k + 1] == n for k in range(300)) >= share * 300


def test_a_long_passage_goes_whole(spark, tmp_path):
    """Inside other text; op8_line_chunks, its SQL and the stage of the pipeline."""
    passage = "\n".join(f"line {k} of a passage with eight words" for k in range(20))
    rows = [(i, f"head {i} of its own\n{passage}\ntail {i} of its own", "en", "s", 0) for i in range(12)] + [(20, None, "en", "s", 0), (21, "a\n\n" + "b c\n" * 80, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    gone = line_dedup.op8_line_chunks(spark, str(tmp_path)).toPandas().sort_values("doc_id")
    assert gone["n_removed_lines"].tolist()[:12] == [0] + [20] * 11
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = c.sql(line_dedup.ORACLES["op8_line_chunks"]).df().sort_values("doc_id")[list(gone.columns)]
    assert gone.values.tolist() == want.values.tolist()
    left = {x["doc_id"]: x["text"] for x in line_dedup.stage_lines(spark, docs, str(tmp_path)).collect() if x["doc_id"] < 12}
    assert left == {i: f"head {i} of its own\ntail {i} of its own" if i else rows[0][1] for i in range(12)}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables here")
def test_line_chunks_against_sql(spark):
    c = duckdb.connect()
    c.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    got = line_dedup.op8_line_chunks(spark, "/root/testdata/sf0.001").toPandas().sort_values("doc_id")
    want = c.sql(line_dedup.ORACLES["op8_line_chunks"]).df().sort_values("doc_id")[list(got.columns)]
    assert got.values.tolist() == want.values.tolist() and got["n_removed_lines"].sum() > 50


def sources(spark, sizes: dict, least=20, most=180):
    """documents whose sources hold about so many of them, of least to most words."""
    r = random.Random(5)
    rows = [(s, "w " * r.randint(least, most)) for s, n in sizes.items() for _ in range(n)]
    return spark.createDataFrame([(i, t, "en", s, len(t)) for i, (s, t) in enumerate(rows)], "doc_id bigint, text string, lang string, source string, n_chars bigint").cache()


def test_mixing_stage_meets_targets(spark):
    """Sources of few documents a shard: the copies' words, not only the fractions, follow the targets."""
    docs = sources(spark, {f"s{k:02d}": 40 for k in range(9)} | {"hot": 500})
    target = {r["source"]: r["target"] for r in mixing.mix(docs).select("source", "target").distinct().collect()}
    copies = mixing.stage_mix(spark, docs, "").groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")).collect()
    out = {r["source"]: r["n"] for r in copies}
    assert all(abs(out.get(s, 0) - want) <= 100 for s, want in target.items()), (out, target)
    most = mixing.stage_mix(spark, docs, "").groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert most <= mixing.MOST


def test_mixing_deals_all_words(spark):
    """Sources near their bound beside a hot one, with shards of less than a block."""
    docs = sources(spark, {f"s{k:02d}": 30 for k in range(20)} | {"hot": 520})
    rows = mixing.mix(docs, blocks=256, shards=64).collect()
    total = {s: [sum(r["taken"] for r in rows if r["source"] == s), next(r["target"] for r in rows if r["source"] == s)] for s in {r["source"] for r in rows}}
    block = sum(r["size"] for r in rows) // 256
    assert all(abs(taken - want) <= block for taken, want in total.values()), (block, total)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
