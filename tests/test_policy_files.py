import pytest

from tessera.operators import review as R
from tessera.plans.review import DIFFS
from tessera.sources.workspace import load_rules

TEXT = """security:
  - id: SEC001
    rule: "If req.query is used, validate() must be there"
    paths: ["src/api/**", 7]
    severity: CRITICAL
    category: security
    action: when_require
    when: { regex: { pattern: "REQ\\\\.query", flags: i } }
    require: { regex: { pattern: "validate\\\\(" } }
  - id: SEC002
    rule: "No eval()"
    paths: ["src/**"]
    severity: HIGH
    category: security
    action: deny
    deny: { regex: { pattern: "\\\\beval\\\\(" } }
  - id: NOPATHS
    rule: x
    severity: LOW
    category: x
notes: none
"""


def test_rules_of_a_policy_file_find_what_they_should(spark):
    pytest.importorskip("yaml")
    rules = load_rules(TEXT)
    assert [(r["section"], r["id"], r["paths"]) for r in rules] == [("security", "SEC001", ["src/api/**"]), ("security", "SEC002", ["src/**"])]
    found = R.invariant_findings(R.files_of(R.diff_lines(DIFFS.df(spark))), rules).select("diff_id", "id").collect()
    assert sorted(map(tuple, found)) == [(0, "SEC002"), (3, "SEC001")]


def test_rules_of_json_and_of_nothing():
    assert load_rules("") == [] and load_rules('{"a": [{"id": "1"}]}') == []
    with pytest.raises(ValueError):
        load_rules("[1]")


def test_findings_of_two_diffs_stay_apart(spark):
    files = spark.createDataFrame([(0, "a.ts", "a.ts", [1, 2]), (1, "a.ts", "a.ts", [9])], "diff_id int, old_path string, new_path string, changed_lines array<int>")
    f = spark.createDataFrame([(d, d, "a.ts", 9, 9, None, 1, "CRITICAL", f"F{d}", "t", 0.9, "c") for d in (0, 1)], "diff_id int, ord int, file string, lo int, hi int, on_line boolean, priority int, severity string, id string, title string, confidence double, category string")
    assert {r["diff_id"]: r["on_line"] for r in R.on_changed_line(f, files).collect()} == {0: False, 1: True}
    assert {r["diff_id"]: r["reasons"] for r in R.failure_policy(f, by=["diff_id"]).collect()} == {0: "CRITICAL F0: t", 1: "CRITICAL F1: t"}
    assert R.post_process(f, most=1, by=["diff_id"]).count() == 2 and R.post_process(f, most=1).count() == 1
