"""Queries of the review family."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import review as R
from tessera.plans.fixture import Fixture, ctes

_A = """diff --git a/src/mcp/tools/x.ts b/src/mcp/tools/x.ts
index 1..2 100644
--- a/src/mcp/tools/x.ts
+++ b/src/mcp/tools/x.ts
@@ -1,3 +1,4 @@ top
 keep
-export const x = 1;
+export const x = 2;
+// fix the bug
 tail
@@ -40 +41,2 @@
-old
+new
+eval(y)
\\ No newline at end of file
diff --git a/docs/a.md b/docs/a.md
new file mode 100644
@@ -0,0 +1 @@
+hello
diff --git a/logo.png b/logo.png
Binary files a/logo.png and b/logo.png differ
"""
_B = "diff --git a/docs/a.md b/docs/b.md\n@@ -1 +1 @@\n-a\n+b\n"
_C = "diff --git a/.github/ci.yml b/.github/ci.yml\n@@ -1,2 +1,2 @@\n a\n-b\n+c\n"
_D = "diff --git a/src/api/u.ts b/src/api/u.ts\nnew file mode 100644\n@@ -0,0 +1,2 @@\n+req.query(x)\n+go()\n"
_E = "diff --git a/src/z.py b/src/z.py\n@@ -1,12 +1,12 @@\n" + "".join(f"-a{i}\n+b{i}\n" for i in range(12))
_F = "diff --git a/tests/a.test.ts b/tests/a.test.ts\ndeleted file mode 100644\n@@ -1 +0,0 @@\n-x\n"
DIFFS = Fixture("diffs", "diff_id int, diff string", [(0, _A), (1, _B), (2, _C), (3, _D), (4, _E), (5, _F), (6, "no diff"), (7, None)])
RULES = [
    {"id": "SEC001", "rule": "queries in the API validate their input", "paths": ["src/api/**"], "severity": "HIGH", "category": "security", "action": "when_require", "when": r"req\.query", "require": r"validate\("},
    {"id": "SEC002", "rule": "no eval", "paths": ["src/**"], "severity": "CRITICAL", "category": "security", "action": "deny", "deny": r"\beval\("},
    {"id": "DOC001", "rule": "documents greet", "paths": ["docs/*.{md,rst}"], "severity": "LOW", "category": "docs", "action": "require", "require": "hello"},
]


def _files(spark):
    return R.files_of(R.diff_lines(DIFFS.df(spark)))


def diff_lines(spark, d):
    return R.diff_lines(DIFFS.df(spark))


def diff_stats(spark, d):
    return R.diff_stats(R.diff_lines(DIFFS.df(spark)))


def change_classification(spark, d):
    return R.classify(_files(spark))


def preflight_risk(spark, d):
    return R.preflight(_files(spark)).withColumn("hotspots", F.array_join("hotspots", ","))


def preflight_findings(spark, d):
    f = _files(spark)
    return R.preflight_findings(R.preflight(f), R.classify(f))


def invariants_eval(spark, d):
    return R.invariant_findings(_files(spark), RULES)


def review_context_plan(spark, d):
    f = _files(spark)
    return R.context_plan(f, R.preflight(f), 2000)


def review_context_sections(spark, d):
    c = spark.createDataFrame([("src/mcp/tools/x.ts", "\n".join(f"row {i}" for i in range(1, 90)))], "path string, content string")
    return R.context_sections(_files(spark), c, 5)


FINDINGS = Fixture(
    "findings",
    "ord int, source int, id string, severity string, category string, confidence double, title string, impact string, recommendation string, file string, lo int, hi int, on_line boolean, priority int, rule string, message string",
    [
        (0, 0, "SEC002", "CRITICAL", "security", 0.95, "no eval", "i", "r", "src/mcp/tools/x.ts", 41, 43, None, 1, "R1", " A  b "),
        (1, 1, "PRE001", "MEDIUM", "reliability", 0.95, "no tests", "i", "r", "b/docs/a.md", 5, 2, None, 2, "", "x"),
        (2, 1, "SEC002", "HIGH", "security", 0.5, "again", "i", "r", "./src/none.ts", 1, None, None, 0, "R1", "a b"),
        (3, 2, "a b/c", "INFO", "style", 0.6, "odd id", "i", "r", "docs/a.md", 1, 1, True, 3, None, "A\tB"),
        (4, 2, "LOW1", "LOW", "style", 0.7, "low", "i", "r", "src/z.py", 3, 4, False, 3, "R2", "m"),
    ],
)


def finding_union_dedupe(spark, d):
    f = FINDINGS.df(spark)
    union = f.where("source = 0").unionByName(f.where("source = 1")).unionByName(f.where("source = 2"))
    return R.first_of_each(union, ["id"], [F.col("source"), F.col("ord")]).select("id", "ord", "severity")


def finding_filter_limit(spark, d):
    return R.post_process(FINDINGS.df(spark), 0.55, ["security", "style"], ["LOW1", ""], 2).select("ord", "id")


def failure_policy(spark, d):
    return R.failure_policy(FINDINGS.df(spark), "HIGH", ["PRE001"])


def changed_line_range_join(spark, d):
    f = R.on_changed_line(FINDINGS.df(spark).select(F.lit(0).alias("diff_id"), "ord", "file", "lo", "hi", "on_line", "priority"), _files(spark))
    return f.select("ord", "on_line")


def changed_lines_only(spark, d):
    f = R.on_changed_line(FINDINGS.df(spark).select(F.lit(0).alias("diff_id"), "ord", "file", "lo", "hi", "on_line", "priority"), _files(spark))
    return R.on_line_only(f).select("ord", "priority")


def sarif_results(spark, d):
    return R.sarif_results(FINDINGS.df(spark))


def sarif_rules(spark, d):
    return R.sarif_rules(FINDINGS.df(spark))


def finding_hashes(spark, d):
    return R.finding_hash(FINDINGS.df(spark)).select("ord", "hash")


RANGES = Fixture("ranges", "k int, lo int, hi int", [(0, 1, 5), (0, 6, 8), (0, 10, 12), (0, 2, 3), (1, 4, 3), (1, 1, 1), (1, 3, 9), (1, 3, 4)])


def range_merge(spark, d):
    return R.merge_ranges(RANGES.df(spark), ["k"])


def range_merge_orders(spark, d):
    """Busy spans of customers: their order numbers in steps of 4000, each 3000 long."""
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_custkey", F.col("o_orderkey").alias("lo"), (F.col("o_orderkey") + 3000).alias("hi"))
    return R.merge_ranges(o, ["o_custkey"])


def review_chunks(spark, d):
    f = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("diff_id"), F.col("o_orderkey").alias("ord"))
    return R.review_chunks(f).select("diff_id", "ord", "chunk")


NS = Fixture("ns", "n int", [(0,), (1,), (3,), (4,), (10,), (40,), (500,)])


def adaptive_timeout(spark, d):
    return NS.df(spark).select("n", R.adaptive_timeout(F.col("n")).alias("timeout_ms"))


OUTPUTS = Fixture("outputs", "id int, output string", [(0, "src/a.ts(3,7): error TS2322: Type 'x' is bad.\r\n  src/b.ts(10,1): error TS1005:  ; expected. \nFound 2 errors."), (1, ""), (2, "x(1,2): warning TS1: no")])
SCANS = Fixture("scans", "id int, output string", [(0, '{"results":[{"check_id":"r.eval","path":"a.js","start":{"line":3},"end":{"line":4},"extra":{"message":"no eval","severity":"ERROR"}},{"path":"b.js","extra":{"severity":"info"}}]}'), (1, "not json")])
REPLIES = Fixture("replies", "id int, reply string", [(0, 'Sure:\n```json\n{"findings":[{"id":"A","severity":"LOW","title":"t","evidence":["1","2","3","4","5","6"]},{"id":"B"}]}\n```'), (1, 'x {"findings":[{"id":"C","severity":"HIGH","title":"u"}]} y'), (2, "nothing")])


def tsc_output(spark, d):
    return R.parse_tsc(OUTPUTS.df(spark)).drop("ord")


def semgrep_output(spark, d):
    return R.parse_semgrep(SCANS.df(spark))


def model_findings(spark, d):
    return R.parse_model_findings(REPLIES.df(spark))


_P = r"'^(.+?)\((\d+),(\d+)\):\s+error\s+TS(\d+):\s+(.*)$'"
QUERIES = {f.__name__: f for f in (
    diff_lines, diff_stats, change_classification, preflight_risk, preflight_findings, invariants_eval, review_context_plan, review_context_sections, finding_union_dedupe, finding_filter_limit,
    failure_policy, changed_line_range_join, changed_lines_only, sarif_results, sarif_rules, finding_hashes, range_merge, range_merge_orders, review_chunks, adaptive_timeout, tsc_output, semgrep_output, model_findings,
)}
_MERGE = "t AS (SELECT *, max(hi) OVER (PARTITION BY k ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM r WHERE lo <= hi), i AS (SELECT *, sum(CASE WHEN top IS NULL OR lo > top + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM t)"
ORACLES = {
    "finding_union_dedupe": ctes(FINDINGS) + " SELECT id, ord, severity FROM findings QUALIFY row_number() OVER (PARTITION BY id ORDER BY source, ord) = 1",
    "finding_filter_limit": ctes(FINDINGS) + " SELECT ord, id FROM findings WHERE confidence >= 0.55 AND category IN ('security', 'style') AND id <> 'LOW1' ORDER BY ord LIMIT 2",
    "failure_policy": ctes(FINDINGS) + ", r AS (SELECT ord, CASE WHEN id = 'PRE001' THEN 'Invariant PRE001 forced-fail' WHEN severity IN ('CRITICAL', 'HIGH') THEN severity || ' ' || id || ': ' || title END AS x FROM findings) SELECT count(x) > 0 AS should_fail, string_agg(x, '; ' ORDER BY ord) AS reasons FROM r",
    "finding_hashes": ctes(FINDINGS) + r" SELECT ord, sha256(concat_ws('|', file, category, severity, nullif(rule, ''), CAST(lo AS VARCHAR), CAST(hi AS VARCHAR), lower(trim(regexp_replace(message, '\s+', ' ', 'g'))))) AS hash FROM findings",
    "range_merge": ctes(RANGES) + f", r AS (SELECT * FROM ranges), {_MERGE} SELECT k, min(lo) AS lo, max(hi) AS hi FROM i GROUP BY k, g",
    "range_merge_orders": f"WITH r AS (SELECT o_custkey AS k, o_orderkey AS lo, o_orderkey + 3000 AS hi FROM orders), {_MERGE} SELECT k AS o_custkey, min(lo) AS lo, max(hi) AS hi FROM i GROUP BY k, g",
    "review_chunks": "SELECT o_custkey AS diff_id, o_orderkey AS ord, CAST(CASE WHEN count(*) OVER (PARTITION BY o_custkey) > 15 THEN (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 10 ELSE 0 END AS INTEGER) AS chunk FROM orders",
    "adaptive_timeout": ctes(NS) + " SELECT n, CAST(greatest(300000, least(3600000, ceil(n / 3) * 60000 * 1.5 + 120000)) AS BIGINT) AS timeout_ms FROM ns",
    "tsc_output": ctes(OUTPUTS) + f", l AS (SELECT id, trim(unnest(regexp_split_to_array(output, '\\r?\\n'))) AS x FROM outputs) SELECT id, regexp_extract(x, {_P}, 1) AS file, CAST(regexp_extract(x, {_P}, 2) AS INTEGER) AS line, CAST(regexp_extract(x, {_P}, 3) AS INTEGER) AS col, 'TS' || regexp_extract(x, {_P}, 4) AS code, trim(regexp_extract(x, {_P}, 5)) AS message FROM l WHERE regexp_matches(x, {_P})",
}
