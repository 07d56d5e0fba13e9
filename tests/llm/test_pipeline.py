import os

import brute
import duckdb
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from pyspark.sql import functions as F  # noqa: E402

from tessera.llm import queries, quality  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_quality_against_sql(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = c.sql(queries.ORACLES["op5_quality_rules"]).df().sort_values("doc_id").reset_index(drop=True)
    mine = quality.op5_quality_rules(spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert (want[mine.columns].values == mine.values).all()


def test_stages_keep_columns_and_take_effect(spark, docs, tmp_path):
    own, df = docs.columns, docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, "")
        df.write.parquet(f"{tmp_path}/{name}")
        df = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = df
        if name != "encode":
            assert df.columns == own
    rules = {r["doc_id"]: r["quality"]["kept"] for r in quality.judge(docs).collect()}
    left = {r["doc_id"]: r["text"] for r in seen["quality_rules"].collect()}
    assert set(left) == {i for i, k in rules.items() if k}
    lines = {r["doc_id"]: r["text"] for r in seen["line_dedup"].collect()}
    assert set(lines) == set(left)
    near = {r["doc_id"] for r in seen["near_dedup"].collect()}
    assert near == {i for i, (_, c) in brute.near_duplicates(lines).items() if i == c}
    mixed = seen["mix_sources"].groupBy("doc_id").agg(F.count("*").alias("n")).collect()
    assert {r["doc_id"] for r in mixed} <= near and all(1 <= r["n"] <= 3 for r in mixed)
    out = seen["encode"].collect()
    assert len(out) == sum(r["n"] for r in mixed)
    assert all(r["decoded_sha256"] == brute.sha(lines[r["doc_id"]]) for r in out)


def test_stages_take_empty_tables_and_missing_keys(spark, empty, no_key):
    for table in (empty, no_key):
        df = table
        for _, stage in corpus_pipeline.STAGES:
            df = spark.createDataFrame(stage(spark, df, "").collect(), schema=stage(spark, df, "").schema)
        df.count()
