"""Operators that SQL can't express, against plain folds and known results."""

import random

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import code, planning, retrieval, review
from tessera.plans import code as code_queries
from tessera.plans import retrieval as retrieval_queries
from tessera.sources import workspace
from tessera.streaming import state, watch


def test_suppressed_hits_suppress_nothing(spark):
    rows = [(0, "p", "a", "1-10", 0.9), (1, "p", "b", "5-14", 0.8), (2, "p", "c", "11-20", 0.7), (3, "q", "x  y", None, 0.5), (4, "q", "x y", None, 0.4), (5, "q", "z", "3-1", 0.3)]
    df = spark.createDataFrame(rows, "ord bigint, path string, content string, lines string, score double")
    # 1 overlaps 0 by 6 of 10 and goes; 2 overlaps only 1
    assert sorted(r["ord"] for r in retrieval.suppress_overlap(df).collect()) == [0, 2, 3, 5]


def test_overlap_fold_against_python(spark):
    r = random.Random(1)
    rows = []
    for i in range(300):
        a = r.randint(1, 40)
        rows.append((i, f"p{r.randint(0, 5)}", f"c{r.randint(0, 3)}", None if r.random() < 0.2 else f"{a}-{a + r.randint(0, 12)}", round(r.random(), 2)))
    kept = []
    for path in {x[1] for x in rows}:
        mine = []
        for x in sorted((x for x in rows if x[1] == path), key=lambda x: (-x[4], x[0])):
            span = tuple(map(int, x[3].split("-"))) if x[3] else None

            def same(y, x=x, span=span):
                other = tuple(map(int, y[3].split("-"))) if y[3] else None
                if span and other:
                    return max(0, min(span[1], other[1]) - max(span[0], other[0]) + 1) / min(span[1] - span[0] + 1, other[1] - other[0] + 1) >= 0.6
                return x[2] == y[2]

            if not any(map(same, mine)):
                mine.append(x)
        kept += [x[0] for x in mine]
    df = spark.createDataFrame(rows, "ord bigint, path string, content string, lines string, score double")
    assert sorted(x["ord"] for x in retrieval.suppress_overlap(df).collect()) == sorted(kept)


def test_expand_query():
    assert retrieval.expand_query("  ") == []
    assert [v[1] for v in retrieval.expand_query("How is the auth config handled?", 6)][:4] == ["How is the auth config handled?", "where auth config handled is handled", "implementation of auth config handled", "authentication config handled"]
    assert len(retrieval.expand_query("auth config db", 4)) == 4 and len(retrieval.expand_query("where is `x` used", 4)) == 1


def test_smart_snippet(spark):
    rows = {r["id"]: r["snippet"] for r in retrieval_queries.smart_snippet(spark, "").collect()}
    assert rows[0].startswith("export function pad") and "class Big" in rows[1] and "(lines omitted)" in rows[1] and len(rows[1]) <= 4 * 40 + 80


def test_symbols(spark):
    found = {(r["path"], r["name"], r["kind"]): r for r in code_queries.symbol_extract(spark, "").collect()}
    assert found["src/app/store.ts", "load", "method"]["parent"] == "Store"
    assert found["src/app/store.ts", "Store", "class"]["end_line"] == 18
    assert ("src/app/store.ts", "hidden", "function") not in found and ("src/main.c", "main", "function") not in found
    assert found["lib/m.py", "f", "method"]["end_line"] == 7 if ("lib/m.py", "f", "method") in found else ("lib/m.py", "f", "function") in found


def test_imports(spark):
    found = {(r["path"], r["source"]): r["specifiers"] for r in code_queries.import_extract(spark, "").collect()}
    assert found["src/app/store.ts", "./util.js"] == "a,b" and found["lib/m.go", "x/ioutil"] == "io" and found["a.rb", "x/y.rb"] == "y"
    edges = {(r["from"], r["to"]) for r in code_queries.import_edges(spark, "").collect()}
    assert edges == {("src/app/store.ts", "src/app/util.ts"), ("src/app/store.ts", "src/core/base/index.ts")}


def test_chunks_cover_and_end():
    text = code_queries._LONG
    n = len(text.split("\n"))
    for make in (code.definition_chunks_of, code.hierarchical_chunks_of):
        rows = list(make("x.js", text))
        covered = {k for r in rows for k in range(r[3], r[4] + 1)}
        assert covered == set(range(1, n + 1)) and all(r[4] - r[3] < 150 for r in rows)
    assert list(code._pieces(1, 300)) == [(1, 150), (131, 280), (261, 300)]


def test_plan_graphs(spark):
    schema = "plan_id int, step int, depends_on array<int>, blocks array<int>"
    rows = [(0, 1, [], []), (0, 2, [1], []), (0, 3, [2], []), (0, 4, [3], []), (1, 1, [], [2, 3]), (1, 2, [], []), (1, 3, [], []), (1, 4, [2, 3], []), (2, 1, [2], []), (2, 2, [1], [])]
    out = {r["plan_id"]: r for r in planning.analyse(spark.createDataFrame(rows, schema)).collect()}
    assert out[0]["execution_order"] == [1, 2, 3, 4] == out[0]["critical_path"] and out[0]["parallel_groups"] == []
    assert out[1]["parallel_groups"] == ["2,3"] and out[1]["critical_path"] == [1, 2, 4]
    assert out[2]["cyclic"] == [1, 2] and out[2]["execution_order"] == []


def test_step_states_and_breaker(spark):
    from tessera.plans import planning as q

    s = {(r["plan_id"], r["step"]): (r["status"], r["retries"]) for r in q.step_state_machine(spark, "").collect()}
    assert s[0, 1] == ("completed", 1) and s[0, 2] == ("in_progress", 0) and s[0, 3][0] == "skipped"
    assert s[1, 1] == ("failed", 3) and s[1, 2][0] == "blocked" and s[2, 3][0] == "ready"
    b = {(r["key"], r["seq"]): (r["state"], r["allowed"]) for r in q.circuit_breaker(spark, "").collect()}
    assert b[1, 3] == ("open", True) and b[1, 4] == ("open", False) and b[1, 5] == ("half-open", True) and b[1, 6] == ("open", True) and b[1, 8] == ("closed", True)


def test_diffs(spark):
    from tessera.plans import review as q

    rows = [r for r in q.diff_lines(spark, "").collect() if r["diff_id"] == 0]
    assert [(r["type"], r["old_line"], r["new_line"]) for r in rows if r["hunk"] == 0 and r["file_no"] == 0] == [("context", 1, 1), ("remove", 2, None), ("add", None, 2), ("add", None, 3), ("context", 3, 4), ("context", 4, 5)]  # the last: the line break at the end
    kinds = {r["diff_id"]: r["change"] for r in q.change_classification(spark, "").collect()}
    assert kinds == {0: "bugfix", 1: "docs", 2: "infra", 3: "feature", 4: "refactor", 5: "refactor"}
    found = {(r["diff_id"], r["id"]) for r in q.invariants_eval(spark, "").collect()}
    assert found == {(0, "SEC002"), (3, "SEC001"), (1, "DOC001")}
    risk = {r["diff_id"]: r["risk"] for r in q.preflight_risk(spark, "").collect()}
    assert risk[0] == 4 and risk[5] == 1


def test_changed_lines(spark):
    from tessera.plans import review as q

    assert {r["ord"]: r["on_line"] for r in q.changed_line_range_join(spark, "").collect()} == {0: True, 1: False, 2: False, 3: True, 4: False}


def test_globs():
    import re

    hit = lambda g, p: bool(re.match(T.glob_regex(g), p))
    assert hit("src/**/*.ts", "src/a/b.ts") and hit("src/**/*.ts", "src/b.ts") and not hit("src/*.ts", "src/a/b.ts")
    assert hit("*.{js,ts}", "a.ts") and hit("a?c[0-9]", "abc7") and not hit("a?c[!0-9]", "abc7") and hit("**", ".x/y")


def test_workspace(spark, tmp_path):
    for p, t in {"src/a.ts": "export const x = 1\n", "src/node_modules/b.ts": "x", "big.ts": "y" * 2000, ".gitignore": "z"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    files = workspace.read_files(spark, str(tmp_path), 1000)
    assert {r["path"] for r in files.collect()} == {"src/a.ts", "src/node_modules/b.ts"}
    assert [r["path"] for r in workspace.crawl(files, [".ts"]).collect()] == ["src/a.ts"]
    for bad in ("/etc/passwd", "a/../../b", "", "C:\\x"):
        try:
            workspace.valid_path(bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_index_round_trip(spark, tmp_path):
    import json

    doc = {"version": 2, "chunks": [{"id": "a:1", "filePath": "a", "content": "x", "startLine": 1, "endLine": 2, "embedding": [0.5, 1.0]}], "fileHashes": {"a": "h"}}
    (tmp_path / "index.json").write_text(json.dumps(doc))
    workspace.migrate_json_index(spark, str(tmp_path / "index.json"), str(tmp_path / "out"))
    c = spark.read.parquet(str(tmp_path / "out/chunks")).first()
    assert (c["path"], c["start_line"], c["embedding"]) == ("a", 1, [0.5, 1.0])
    workspace.clear_index(spark, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def test_dedupe_stream_is_the_batch(spark, tmp_path):
    r = random.Random(2)
    rows = sorted({(f"k{r.randint(0, 3)}", r.randint(0, 5000), i) for i in range(200)}, key=lambda x: x[1])
    batch = {(x["key"], x["at_ms"]) for x in state.dedupe_with_ttl(spark.createDataFrame(rows, "key string, at_ms bigint, ord bigint"), 700, str(tmp_path / "work")).where("is_new").collect()}
    for k in range(4):
        spark.createDataFrame([x[:2] for x in rows[k * 50 : k * 50 + 50]], "key string, at_ms bigint").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("key string, at_ms bigint").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = state.dedupe_stream(src, 700).writeStream.format("memory").queryName("new_findings").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(x["key"], x["at_ms"]) for x in spark.table("new_findings").collect()} == batch


def test_index_stream_applies_the_last_change(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", 1, "a", "add", "1"), ("2024-01-01 00:00:01", 2, "b", "add", "2"), ("2024-01-01 00:00:02", 3, "a", "unlink", None)]
    df = spark.createDataFrame(rows, "t string, ord bigint, path string, type string, content string").select(F.col("t").cast("timestamp").alias("ts"), "ord", "path", "type", "content")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = {}
    src = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    watch.index_stream(src, lambda b, _: seen.update({r["path"]: r["type"] for r in b.collect()}), str(tmp_path / "cp")).awaitTermination()
    assert seen == {"a": "unlink", "b": "add"}


def test_session_stream(spark, tmp_path):
    rows = [("2024-01-01 00:00:00.0", 1, "a", "add"), ("2024-01-01 00:00:00.3", 2, "a", "change"), ("2024-01-01 00:00:05.0", 3, "a", "unlink"), ("2024-01-01 00:01:00.0", 4, "z", "add")]
    df = spark.createDataFrame(rows, "t string, ord bigint, path string, type string").select(F.col("t").cast("timestamp").alias("ts"), "ord", "path", "type")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = watch.stream_sessions(src).writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["path"], r["type"], r["changes"]) for r in spark.table("sessions").collect()) == [("a", "change", 2), ("a", "unlink", 1)]


def test_workers():
    assert planning.assign_workers([("a", 5), ("b", 3), ("c", 1), ("d", 9)], 2) == [("a", 0), ("b", 1), ("c", 1), ("d", 1)]


def test_model_replies(spark):
    from tessera.plans import review as q

    assert {r["finding"]: r["evidence"] for r in q.model_findings(spark, "").collect()} == {"A": "1; 2; 3; 4; 5", "C": ""}
    assert review.RANK["CRITICAL"] == 5
