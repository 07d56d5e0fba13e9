import random

from tessera.operators import plan_graph as G


def settled(spark, tmp_path, steps, edges):
    s = spark.createDataFrame(steps, "plan string, step int, weight bigint")
    return G.settle(s, spark.createDataFrame(edges, "plan string, step int, dep int"), f"file://{tmp_path}/w")


def test_random_graphs_against_recursion(spark, tmp_path):
    r = random.Random(1)
    steps, edges = [], []
    for p in range(25):
        n = r.randint(1, 9)
        steps += [(f"p{p}", k, r.randint(1, 4)) for k in range(n)]
        edges += [(f"p{p}", k, j) for k in range(n) for j in range(k) if r.random() < 0.35] * 2
    edges += [("p0", 0, 99), ("nowhere", 1, 2)]
    whole = settled(spark, tmp_path, steps, edges)
    got = {(x["plan"], x["step"]): x for x in whole.collect()}
    weight = {(p, s): w for p, s, w in steps}
    deps = {}
    for p, s, d in edges:
        if (p, d) in weight:
            deps.setdefault((p, s), set()).add(d)

    def walk(p, s):
        before = [walk(p, d) for d in deps.get((p, s), ())]
        level = 1 + max((b[0] for b in before), default=-1)
        finish, path = min(((-b[1], b[2]) for b in before), default=(0, []))
        return level, weight[p, s] - finish, path + [s]

    for k in weight:
        assert (got[k]["level"], got[k]["finish"], got[k]["path"]) == walk(*k)
    paths = {x["plan"]: (x["finish"], x["path"]) for x in G.critical_paths(whole).collect()}
    for p in {p for p, _ in weight}:
        f, path = min((-walk(p, s)[1], walk(p, s)[2]) for q, s in weight if q == p)
        assert paths[p] == (-f, path)


def test_known_graphs_and_cycles(spark, tmp_path):
    steps = [("line", k, 1) for k in (1, 2, 3, 4)] + [("diamond", k, 1) for k in (1, 2, 3, 4)] + [("free", k, 1) for k in (1, 2, 3)] + [("cycle", k, 1) for k in (1, 2, 3, 4)]
    edges = [("line", k + 1, k) for k in (1, 2, 3)] + [("diamond", 2, 1), ("diamond", 3, 1), ("diamond", 4, 2), ("diamond", 4, 3)] + [("cycle", 2, 3), ("cycle", 3, 2), ("cycle", 4, 3)]
    out = settled(spark, tmp_path, steps, edges).cache()
    groups = {(x["plan"], x["level"]): x["steps"] for x in G.parallel_groups(out).collect()}
    assert groups == {("diamond", 1): [2, 3], ("free", 0): [1, 2, 3]}
    order = {}
    for x in G.execution_order(out).orderBy("plan", "position").collect():
        order.setdefault(x["plan"], []).append(x["step"])
    assert order == {"line": [1, 2, 3, 4], "diamond": [1, 2, 3, 4], "free": [1, 2, 3], "cycle": [1]}
    assert {x["step"] for x in out.where("level is null").collect()} == {2, 3, 4}
    paths = {x["plan"]: x["path"] for x in G.critical_paths(out).collect()}
    assert paths["line"] == [1, 2, 3, 4] and paths["diamond"] == [1, 2, 4]


def test_ready_and_empty(spark, tmp_path):
    steps = spark.createDataFrame([("p", 1, True), ("p", 2, False), ("p", 3, False), ("q", 1, False)], "plan string, step int, done boolean")
    edges = spark.createDataFrame([("p", 2, 1), ("p", 3, 2)], "plan string, step int, dep int")
    assert sorted(map(tuple, G.ready(steps, edges).collect())) == [("p", 2), ("q", 1)]
    assert settled(spark, tmp_path, [], []).count() == 0


def test_small_plans_in_place_are_as_by_waves(spark, tmp_path):
    from pyspark.sql import functions as F

    r = random.Random(3)
    steps = [(f"p{p}", k, r.randint(1, 4)) for p in range(40) for k in range(p % 9 + 1)]
    pairs = [(f"p{p}", k, j) for p in range(40) for k in range(p % 9 + 1) for j in range(p % 9 + 1) if j != k and (j < k or p % 8 == 0) and r.random() < 0.3]
    deps = {}
    for p, k, j in pairs:
        deps.setdefault((p, k), []).append(j)
    packed = {}
    for p, k, w in steps:
        packed.setdefault(p, []).append((k, w, deps.get((p, k), []) + [99]))
    plans = spark.createDataFrame(list(packed.items()), "plan string, steps array<struct<step:int,weight:bigint,deps:array<int>>>")
    got, want = G.settle_small(plans), settled(spark, tmp_path, steps, pairs)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.where(F.col("level").isNull()).count() and got.where("level > 2").count()


def test_orders_of_few_lines_need_no_waves_and_larger_ones_are_as_their_sql(spark, tmp_path, monkeypatch):
    """Lines repeat their numbers, an order has many, some have none."""
    import datetime

    import duckdb

    from tessera.plans import graphs as P

    r = random.Random(4)
    day = lambda: datetime.datetime(1995, 1, 1) + datetime.timedelta(days=r.randrange(30))
    rows = [(k, r.randint(1, 7), float(r.randint(1, 50)), day(), r.choice("FO")) for k in range(60) for _ in range(r.randint(1, 7))]
    rows += [(100, k, float(r.randint(1, 50)), day(), "O") for k in range(1, 13)] + [(None, k, 5.0, day(), "F") for k in (1, 2)]
    schema = "l_orderkey bigint, l_linenumber int, l_quantity double, l_shipdate timestamp, l_linestatus string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/some/lineitem.parquet")
    spark.createDataFrame(rows[:-14], schema).coalesce(1).write.parquet(f"{tmp_path}/few/lineitem.parquet")
    monkeypatch.setattr(P, "SMALL", 10)

    def compare(d):
        c = duckdb.connect()
        c.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{d}/lineitem.parquet/*.parquet'")
        for name in ("order_plan_schedule", "order_plan_critical_path", "order_plan_groups"):
            got = P.QUERIES[name](spark, str(d))
            want = c.sql(f"SELECT {', '.join(got.columns)} FROM ({P.ORACLES[name]})").fetchall()
            assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and want

    compare(tmp_path / "some")
    monkeypatch.setattr(G, "settle", None)
    compare(tmp_path / "few")
