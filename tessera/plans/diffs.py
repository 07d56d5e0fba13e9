"""Queries that compute diffs between versions in the given tables, and review them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import diffs as D
from tessera.operators import review as R
from tessera.operators.prefix import written
from tessera.plans.fixture import spread
from tessera.plans.indexing import folder

#: A policy for the invented prose of the tables.
POLICY = [
    {"id": "TXT001", "rule": "tools quote what they name", "paths": ["src/**"], "severity": "HIGH", "category": "style", "action": "when_require", "when": r"\bof\b", "require": '"'},
    {"id": "TXT002", "rule": "no secrets", "paths": ["**"], "severity": "CRITICAL", "category": "security", "action": "deny", "deny": r"(?i)\b(password|token|secret)\b"},
    {"id": "TXT003", "rule": "documents end a sentence", "paths": ["docs/**"], "severity": "LOW", "category": "style", "action": "require", "require": r"\."},
]


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return D.turn_pairs(spread(spark.read.parquet(f"{d}/conversations.parquet")))


def _turn_lines(spark: SparkSession, d: str) -> DataFrame:
    return R.diff_lines(D.with_diff(_turns(spark, d)), phantom=False)


def _turn_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of each turn's diff, written: diffs are computed once, however often a query reads them."""
    return written(R.files_of(_turn_lines(spark, d)), folder(spark, "turn-files"))


def _revisions(spark: SparkSession, d: str) -> DataFrame:
    return D.revision_pairs(spread(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source", "text")))


def turn_diffs(spark, d):
    """Each turn as a unified diff against the turn before it."""
    return D.with_diff(_turns(spark, d))


def turn_diff_stats(spark, d):
    return R.diff_stats(_turn_lines(spark, d))


def turn_changes(spark, d):
    return R.classify(R.files_of(_turn_lines(spark, d)))


def turn_risk(spark, d):
    checked = R.preflight(R.files_of(_turn_lines(spark, d)))
    return checked.select("diff_id", F.array_join("hotspots", ",").alias("hotspots"), "public_api", "config", "tests", "binary", "raw_risk", "risk")


def turn_preflight(spark, d):
    files = _turn_files(spark, d)
    return R.preflight_findings(R.preflight(files), R.classify(files))


def turn_policy(spark, d):
    return R.invariant_findings(R.files_of(_turn_lines(spark, d)), POLICY)


def turn_policy_failures(spark, d):
    found = R.invariant_findings(_turn_files(spark, d), POLICY)
    return R.failure_policy(found.withColumn("ord", F.col("id")), "HIGH", ["TXT003"], by=["diff_id"])


def turn_long_lines(spark, d):
    """Lines of over 120 characters of each turn, and whether the turn changed them."""
    pairs = _turns(spark, d)
    lines = pairs.where("new is not null").select("diff_id", F.col("new_path").alias("file"), F.posexplode(F.split("new", "\n", -1)).alias("at", "x")).where(F.length("x") > 120)
    line = (F.col("at") + 1).alias("lo")
    found = lines.select("diff_id", "file", line, line.alias("hi"), F.lit(None).cast("boolean").alias("on_line"))
    return R.on_changed_line(found, _turn_files(spark, d)).select("diff_id", "file", F.col("lo").alias("line"), F.col("on_line").alias("changed"))


def revision_diffs(spark, d):
    """Each document that shares its longest line with an earlier one, as a unified diff against the first of them."""
    return D.with_diff(_revisions(spark, d))


def revision_diff_stats(spark, d):
    return R.diff_stats(R.diff_lines(D.with_diff(_revisions(spark, d)), phantom=False))


def revision_context(spark, d):
    """Numbered lines around the changes of each revision: ranges merged, three lines each way."""
    pairs = _revisions(spark, d)
    files = R.files_of(R.diff_lines(D.with_diff(pairs), phantom=False))
    contents = pairs.select(F.col("new_path").alias("path"), F.col("new").alias("content"))
    return R.context_sections(files, contents, around=3)


QUERIES = {f.__name__: f for f in (turn_diffs, turn_diff_stats, turn_changes, turn_risk, turn_preflight, turn_policy, turn_policy_failures, turn_long_lines, revision_diffs, revision_diff_stats, revision_context)}

#: The longest common subsequence of the lines of p(diff_id, a, b), row by row of its table; edits are what it leaves.
_STATS = """, s AS (SELECT diff_id, 0 AS i, list_transform(range(len(b) + 1), lambda x: 0::BIGINT) AS dp FROM p
UNION ALL SELECT s.diff_id, i + 1, list_reduce(list_concat([[0::BIGINT]], list_transform(range(1, len(b) + 1), lambda j: [CASE WHEN b[j] = a[i + 1] THEN 1::BIGINT ELSE 0 END, dp[j], dp[j + 1]])), lambda acc, e: list_append(acc, CASE WHEN e[1] = 1 THEN e[2] + 1 ELSE greatest(e[3], acc[len(acc)]) END)) FROM s JOIN p ON p.diff_id = s.diff_id AND i < len(a))
SELECT diff_id, 1::BIGINT AS files, len(b) - dp[len(dp)] AS added, len(a) - dp[len(dp)] AS removed FROM s JOIN p USING (diff_id) WHERE i = len(a)"""
ORACLES = {
    "turn_diff_stats": """WITH RECURSIVE p AS (SELECT concat(n.conv_id, '/', n.turn) AS diff_id, coalesce(string_split(o.text, chr(10)), []) AS a, coalesce(string_split(n.text, chr(10)), []) AS b FROM conversations n LEFT JOIN conversations o ON o.conv_id = n.conv_id AND o.turn + 1 = n.turn)""" + _STATS,
    "revision_diff_stats": """WITH RECURSIVE l AS (SELECT doc_id, text, (list_sort(list_transform(range(1, len(string_split(text, chr(10))) + 1), lambda i: {'n': -length(string_split(text, chr(10))[i]), 'i': i}))[1]).i AS i FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, text, string_split(text, chr(10))[i] AS line FROM l WHERE trim(string_split(text, chr(10))[i]) <> ''), f AS (SELECT line, min(doc_id) AS first FROM k GROUP BY line),
p AS (SELECT k.doc_id AS diff_id, string_split(o.text, chr(10)) AS a, string_split(k.text, chr(10)) AS b FROM k JOIN f USING (line) JOIN documents o ON o.doc_id = first WHERE k.doc_id > first)""" + _STATS,
}
