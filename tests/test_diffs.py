"""Diffs: shortest scripts, texts that parse back to the edits, reviews of versions in tables."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import diffs as D
from tessera.operators import review as R
from tessera.plans import diffs as P

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def common(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
    return row[-1]


def test_scripts_are_shortest():
    r = random.Random(1)
    for _ in range(1500):
        a, b = ([r.choice("abcd"[: r.randint(1, 4)]) for _ in range(r.randint(0, 12))] for _ in range(2))
        m = D.matches(a, b)
        assert all(a[i : i + n] == b[j : j + n] for i, j, n in m) and sum(n for *_, n in m) == common(a, b)
        assert all(x[0] + x[2] <= y[0] and x[1] + x[2] <= y[1] for x, y in zip(m, m[1:], strict=False))


def applied(old, rows):
    """The new lines, from the old ones and the parsed lines of a diff."""
    out, at = [], 0
    for r in sorted(rows, key=lambda r: (r["hunk"], r["pos"])):
        if r["type"] != "add":
            while at < r["old_line"] - 1:
                out.append(old[at])
                at += 1
            assert old[at] == r["content"]
            at += 1
        elif r["new_line"] - 1 > len(out):
            n = r["new_line"] - 1 - len(out)
            out += old[at : at + n]
            at += n
        if r["type"] != "remove":
            assert len(out) == r["new_line"] - 1
            out.append(r["content"])
    return out + old[at:]


def test_diffs_parse_back_to_their_edits(spark):
    r = random.Random(2)
    pool = ["", " ", "a", "b", "+c", "-d", "@@ -1 +1 @@", "diff --git a/x b/x", "é", "\r"]
    texts = ["\n".join(r.choice(pool) for _ in range(r.randint(1, 25))) for _ in range(160)] + [None, "", "same"]
    pairs = [(f"k{k}", f"x/{k}", f"y/{k}", r.choice(texts), r.choice(texts)) for k in range(300)] + [("same", "s", "s", "same", "same"), ("none", "s", "s", None, None)]
    df = spark.createDataFrame(pairs, "diff_id string, old_path string, new_path string, old string, new string")
    rows = {}
    for x in R.diff_lines(D.with_diff(df), phantom=False).collect():
        rows.setdefault(x["diff_id"], []).append(x)
    for k, old_path, new_path, old, new in pairs:
        a, b = ([] if t is None else t.split("\n") for t in (old, new))
        own = rows[k]
        assert {(x["old_path"], x["new_path"], x["is_new"], x["is_deleted"]) for x in own} == {(old_path, new_path, old is None, new is None and old is not None)}
        real = [x for x in own if x["type"]]
        assert applied(a, real) == b
        n = common(a, b)
        assert (sum(x["type"] == "add" for x in real), sum(x["type"] == "remove" for x in real)) == (len(b) - n, len(a) - n)


def test_hunks_keep_their_distance():
    a = [str(k) for k in range(40)]
    b = a[:10] + ["new"] + a[10:17] + ["other"] + a[17:38] + ["last"] + a[39:]
    heads = [h.split("\n")[0] for h in D.hunks(a, b)]
    assert heads == ["@@ -8,6 +8,7 @@", "@@ -15,6 +16,7 @@", "@@ -36,5 +38,5 @@"]
    b = a[:10] + ["new"] + a[10:16] + ["other"] + a[16:]
    assert len(list(D.hunks(a, b))) == 1 and list(D.hunks(a, a)) == [] and list(D.hunks([], ["x"])) == ["@@ -0,0 +1,1 @@\n+x"]


@tables
def test_turns_are_reviewed(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    text = {(t["conv_id"], t["turn"]): t for t in turns}
    want = {}
    for (c, n), t in text.items():
        old = text.get((c, n - 1))
        a, b = ([] if x is None else x["text"].split("\n") for x in (old, t))
        k = common(a, b)
        want[f"{c}/{n}"] = (t["role"], old is None, len(b) - k, len(a) - k)
    stats = {r["diff_id"]: (r["added"], r["removed"]) for r in P.turn_diff_stats(spark, SF).collect()}
    assert stats == {k: w[2:] for k, w in want.items()}
    changes = {r["diff_id"]: r["change"] for r in P.turn_changes(spark, SF).collect()}
    for k, (role, new, added, removed) in want.items():
        churn = min(added, removed) / max(1, added, removed)
        told = "docs" if role == "user" else "infra" if role not in ("user", "assistant") else "feature" if new or not (added + removed >= 20 and churn >= 0.6) else "refactor"
        assert changes[k] == told
    risk = {r["diff_id"]: r for r in P.turn_risk(spark, SF).collect()}
    for k, (role, *_) in want.items():
        hot, config = role == "assistant", role not in ("user", "assistant")
        assert risk[k]["raw_risk"] == 2.0 + 0.5 * hot + 0.5 * config and risk[k]["hotspots"] == ("src/mcp" if hot else "")
    found = P.turn_preflight(spark, SF).groupBy("id").count().collect()
    n = {r["id"]: r["count"] for r in found}
    assert n["PRE001"] == sum(w == "feature" or w == "refactor" for w in changes.values()) and n["PRE005"] == sum(w[0] == "assistant" for w in want.values())


@tables
def test_policy_and_changed_lines(spark):
    pairs = {r["diff_id"]: r for r in D.turn_pairs(spark.read.parquet(f"{SF}/conversations.parquet")).collect()}
    added = {}
    for r in R.diff_lines(P.turn_diffs(spark, SF), phantom=False).where("type = 'add'").collect():
        added.setdefault(r["diff_id"], {})[r["new_line"]] = r["content"]
    got = {(r["diff_id"], r["line"]): r["changed"] for r in P.turn_long_lines(spark, SF).collect()}
    want = {(k, i): i in added.get(k, {}) for k, p in pairs.items() for i, x in enumerate(p["new"].split("\n"), 1) if len(x) > 120}
    assert got == want and want
    import re

    hits = {(r["diff_id"], r["id"]) for r in P.turn_policy(spark, SF).collect()}
    for k, p in pairs.items():
        own = "\n".join(added.get(k, {})[i] for i in sorted(added.get(k, {})))
        code = p["new_path"].startswith("src/")
        assert ((k, "TXT001") in hits) == bool(code and re.search(r"\bof\b", own) and '"' not in own)
        assert ((k, "TXT003") in hits) == (p["new_path"].startswith("docs/") and "." not in own)
    failed = {r["diff_id"]: r["should_fail"] for r in P.turn_policy_failures(spark, SF).collect()}
    assert all(failed.values()) and set(failed) == {k for k, _ in hits}


@tables
def test_revisions(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    first = {}
    want = {}
    for i in sorted(docs):
        lines = (docs[i]["text"] or "").split("\n")
        line = max(lines, key=len)
        if line.strip(" "):
            want[i] = first.setdefault(line, i)
    want = {i: f for i, f in want.items() if i != f}
    got = {r["diff_id"]: r for r in P.revision_diffs(spark, SF).collect()}
    assert set(got) == set(want) and want
    rows = {}
    for x in R.diff_lines(P.revision_diffs(spark, SF), phantom=False).where("type is not null").collect():
        rows.setdefault(x["diff_id"], []).append(x)
    for i, f in want.items():
        assert applied(docs[f]["text"].split("\n"), rows.get(i, [])) == docs[i]["text"].split("\n")
    for r in P.revision_context(spark, SF).collect():
        lines = docs[r["diff_id"]]["text"].split("\n")
        head = r["section"].split("\n")
        assert head[1] == f"Lines {r['lo']}-{r['hi']}" and head[2] == f"{r['lo']:>5}  {lines[r['lo'] - 1]}"
        assert any(x["type"] == "add" and r["lo"] <= x["new_line"] <= r["hi"] for x in rows[r["diff_id"]])


def test_hot_line_is_met_in_parts(spark):
    docs = spark.createDataFrame([(k, "s", f"the longest line of them all\n{k}") for k in range(200)] + [(300, None, None), (301, "s", ""), (302, "s", "  \n ")], "doc_id bigint, source string, text string")
    out = D.revision_pairs(docs)
    assert out.count() == 199 and {r["old_path"] for r in out.collect()} == {"s/0"}
    assert out.groupBy(F.pmod(F.xxhash64("diff_id"), F.lit(16))).count().count() == 16
