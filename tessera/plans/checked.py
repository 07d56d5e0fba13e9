"""Queries that check documents with a defect of their own: all validation rules, findings as SARIF."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import review as R
from tessera.operators import scan as S
from tessera.plans import scan, sql
from tessera.plans.fixture import spread

#: By doc_id modulo 9: what follows a document's text, as SQL for both engines (h: the MD5 of the text), or stands in its place.
_ADDED = {0: "concat('f(a[', h, ')')", 1: "concat('// TODO ', h)", 2: "concat('console.log(', h, ')')", 3: "concat('fetch https://api.', h, '.io/v1 http://example.com/x')", 4: "concat(h, h, h, h)", 8: "concat('}} ', h, ' {[')"}
_INSTEAD = {5: "concat('{\"h\": \"', h, '\"}')", 6: "concat('{\"h\": ', h)", 7: "' '"}
_CONTENT = "CASE doc_id % 9 " + " ".join(f"WHEN {k} THEN concat_ws(chr(10), text, {x})" for k, x in _ADDED.items()) + " ".join(f" WHEN {k} THEN {x}" for k, x in _INSTEAD.items()) + " END"
_KIND = "CASE WHEN doc_id % 9 IN (5, 6) THEN 'plan_output' WHEN doc_id % 9 < 5 THEN 'generated_code' ELSE 'review' END"


def validate_planted(spark, d):
    """All rules over all documents, each with a defect of one of nine kinds (one of them none) made of its MD5."""
    docs = spread(spark.read.parquet(f"{d}/documents.parquet")).withColumn("h", F.md5(F.coalesce("text", F.lit(""))))
    return S.validate(docs.select(F.col("doc_id").alias("id"), F.expr(_CONTENT).alias("content"), F.expr(_KIND).alias("content_type")))


def sarif_security_planted(spark, d):
    """What the security scan finds in documents with planted secrets, as SARIF results."""
    found = S.scan_security(scan.planted(spark, d))
    kind = F.col("type") == "secret"
    f = found.select(
        F.concat_ws(":", "path", "line", "message").alias("ord"), F.concat_ws("/", "type", "severity").alias("id"), F.upper("severity").alias("severity"), F.col("type").alias("category"), F.when(kind, 0.9).otherwise(0.7).alias("confidence"),
        F.col("message").alias("title"), F.when(kind, "Leaked credentials can be used").otherwise("Unsafe code can be run").alias("impact"), F.when(kind, "Remove it").otherwise("Review it").alias("recommendation"),
        F.col("path").alias("file"), F.col("line").alias("lo"), F.lit(None).cast("int").alias("hi"),
    )
    return R.sarif_results(f)


QUERIES = {f.__name__: f for f in (validate_planted, sarif_security_planted)}
_INPUTS = f"inputs AS (SELECT doc_id AS id, {_CONTENT} AS content, {_KIND} AS content_type FROM (SELECT doc_id, text, md5(coalesce(text, '')) AS h FROM documents))"
ORACLES = {
    "validate_planted": f"WITH RECURSIVE {_INPUTS},{sql.VALIDATED} SELECT * FROM v",
    "sarif_security_planted": f"""WITH {scan.PLANTED}, found AS ({scan._SCAN}), findings AS (SELECT concat_ws(':', path, line, message) AS ord, type || '/' || severity AS id, upper(severity) AS severity, type AS category, CASE type WHEN 'secret' THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END AS confidence,
message AS title, CASE type WHEN 'secret' THEN 'Leaked credentials can be used' ELSE 'Unsafe code can be run' END AS impact, CASE type WHEN 'secret' THEN 'Remove it' ELSE 'Review it' END AS recommendation, path AS file, line AS lo, NULL::INT AS hi FROM found)
SELECT ord, CAST({sql._RESULT} AS VARCHAR) AS result FROM findings""",
}
