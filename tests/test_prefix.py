import random

from pyspark.sql import functions as F

from tessera.operators import scan as S
from tessera.operators.prefix import chain, ranges, running_max, running_sum, successors
from tessera.streaming.state import dedupe_with_ttl


def test_running_sums_of_hot_groups(spark):
    r = random.Random(1)
    rows = [(r.choice(["hot", "hot", "a", None]), r.choice([None, r.randrange(300)]), k, r.choice([None, r.randrange(9)])) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, x int, tie int, v bigint")
    got = {x["tie"]: x["running"] for x in running_sum(df, "v", ["g"], "x", ["tie"], parts=16).collect()}
    want, sums = {}, {}
    for g, _, k, v in sorted(rows, key=lambda t: (t[1] is not None, t[1] or 0, t[2])):
        if v is not None:
            sums[g] = sums.get(g, 0) + v
        want[k] = sums.get(g)
    assert got == want
    n = df.where("g = 'hot'").withColumn("r", ranges(df, "x", 16)).groupBy("r").count().collect()
    assert len(n) >= 8 and max(c["count"] for c in n if c["r"]) < 400  # nulls apart
    assert running_sum(df.limit(0), "v", ["g"], "x").count() == 0


def _hot(n):
    r = random.Random(3)
    return [(r.choice(["hot", "hot", "a", "b", None]), r.choice([None, *range(0, 4000, 3)] if k % 9 == 0 else range(4000)), r.choice([None, k % 50]), k) for k in range(n)]


def test_successors_and_chains_of_hot_groups(spark, tmp_path):
    rows = _hot(2500)
    df = spark.createDataFrame([x[:2] for x in rows], "g string, x bigint")
    times = {}
    for g, x, _, _ in rows:
        if x is not None:
            times.setdefault(g, set()).add(x)
    later = {(g, x, min(y for y in ts if y > x + 37)) for g, ts in times.items() for x in ts if max(ts) > x + 37}
    assert set(map(tuple, successors(df, ["g"], "x", 37, parts=8).collect())) == later
    want = set()
    for g, ts in times.items():
        at, n = None, 0
        for x in sorted(ts):
            if at is None or x - at > 37:
                at, n = x, n + 1
                want.add((g, x, n))
    assert set(map(tuple, chain(df, ["g"], "x", 37, str(tmp_path / "a"), parts=8).collect())) == want and max(w[2] for w in want) > 64
    assert chain(df.limit(0), ["g"], "x", 37, str(tmp_path / "b")).count() == 0
    greatest = {r["k"]: r["running"] for r in running_max(spark.createDataFrame(rows, "g string, x bigint, v bigint, k bigint"), "v", ["g"], "x", ["k"], parts=8).collect()}
    seen = {}
    for g, _, v, k in sorted(rows, key=lambda t: (t[1] is not None, t[1] or 0, t[3])):
        seen[g] = v if seen.get(g) is None else seen[g] if v is None else max(seen[g], v)
        assert greatest[k] == seen[g]


def test_deduplication_with_a_hot_key_nulls_and_equal_rows(spark, tmp_path):
    rows = [(g, x, v) for g, x, v, _ in _hot(2500)]
    rows += rows[:200]
    got = dedupe_with_ttl(spark.createDataFrame(rows, "key string, at_ms bigint, ord bigint"), 37, str(tmp_path / "a"), parts=8).collect()
    want, state = [], {}
    for key, at, o in sorted(rows, key=lambda t: (t[1] is not None, t[1] or 0, t[2] is not None, t[2] or 0)):
        if at is None:
            want.append((key, at, o, None, None))
            continue
        seen, n = state.get(key, (None, 0))
        new = seen is None or at - seen > 37
        state[key] = (at, n + 1) if new else (seen, n)
        want.append((key, at, o, new, n + new))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert dedupe_with_ttl(spark.createDataFrame([], "key string, at_ms bigint, ord bigint"), 37, str(tmp_path / "b")).count() == 0


def test_required_literals():
    assert S.required(r"AKIA[0-9A-Z]{16}") == ["AKIA"] and S.required(r"\beval\(") == ["eval("]
    assert sorted(S.required(r"(?:mongodb|postgres|redis)://[^\s]{10,}")) in (["mongodb", "postgres", "redis"], ["://"]) and S.required("(?i)abc") == [] == S.required("[ab]+")
    assert S.required(r"x*(?:ab|c?)y") == ["y"] and S.required(r"(?:abc)?d") == ["d"]
    for _, p, _ in S.SECRETS:
        assert S.required(p)


def test_planted_secrets_are_found_by_their_rules(spark):
    texts = ["AKIA" + "Q" * 16, "x akia" + "q" * 16, "password = 'longenough'", "pwd: \"longenough\"", "eval (x)", "retrieval(x)", "a eval(x)", "cursor.execute('select ${x}')", "'10.0.0.1'", None, "", "// example eval(x)", "verify_ssl=False"]
    df = spark.createDataFrame([(f"p{k}", t) for k, t in enumerate(texts)], "path string, content string")
    plain = df.where("content is not null").select("path", "content", *(F.col("content").rlike(p).alias(f"r{k}") for k, p in enumerate([x[1] for x in S.SECRETS] + [x[0] for x in S.RISKS])))
    want = {r["path"]: sum(bool(x) for x in r[2:]) for r in plain.collect() if any(r[2:]) and not r["content"].startswith("// example")}
    got = {r["path"]: r["count"] for r in S.scan_security(df).groupBy("path").count().collect()}
    assert got == want and len(want) >= 6
