"""secret_scrub_documents returns every document with a secret of any kind."""

from tessera.plans import scan


def test_scrub_takes_every_rule(spark, tmp_path):
    rows = [(1, "key AKIA" + "ABCDEFGH" * 2, "s"), (2, "ghp_" + "a1" * 18, "s"), (3, 'token = "' + "0a" * 20 + '"', "s"), (4, "nothing", "s"), (5, None, "s")]
    docs = spark.createDataFrame([(i, t, "en", s) for i, t, s in rows], "doc_id bigint, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"] for r in scan.secret_scrub_documents(spark, str(tmp_path)).collect()} == {1, 2, 3}
