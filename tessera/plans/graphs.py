"""Plans from the given tables: an order is a plan, its lines are steps that take a day for every ten pieces; a step waits for those of
its order that are through before it ships."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import plan_graph as G
from tessera.plans.indexing import folder

#: Orders of up to SMALL lines are settled each by itself; a part holds the orders of about ROWS lines.
SMALL, ROWS = 24, 1_000_000


def _steps(spark: SparkSession, d: str) -> DataFrame:
    return _steps_of(spark.read.parquet(f"{d}/lineitem.parquet"))


def _steps_of(rows: DataFrame) -> DataFrame:
    """One step for each line number of an order; of repeated line numbers the one that ships first, then the one with more pieces."""
    g = rows.groupBy(F.col("l_orderkey").alias("plan"), F.col("l_linenumber").alias("step")).agg(F.min(F.struct(F.col("l_shipdate").alias("ships"), (-F.col("l_quantity")).alias("q"), F.col("l_linestatus").alias("status"))).alias("r"))
    return g.select("plan", "step", "r.ships", F.ceil(-F.col("r.q") / 10).cast("long").alias("weight"), (F.col("r.status") == "F").alias("done"))


def _edges(steps: DataFrame) -> DataFrame:
    """Within an order, so an equi-join whose groups are an order's lines."""
    through = steps.select("plan", F.col("step").alias("dep"), (F.col("ships").cast("date") + F.col("weight").cast("int")).alias("through"))
    return steps.join(through, "plan").where(F.col("through") <= F.col("ships").cast("date")).where("dep <> step").select("plan", "step", "dep")


def _packed(steps: DataFrame) -> DataFrame:
    """(plan, steps) of small orders, with the dependencies that _edges gives them."""
    g = steps.select("plan", F.struct("step", "weight", F.col("ships").cast("date").alias("ships"), (F.col("ships").cast("date") + F.col("weight").cast("int")).alias("through")).alias("s")).groupBy("plan").agg(F.collect_list("s").alias("own"))
    deps = lambda a: F.transform(F.filter("own", lambda b: (b["through"] <= a["ships"]) & (b["step"] != a["step"])), lambda b: b["step"])
    return g.select("plan", F.transform("own", lambda a: F.struct(a["step"].alias("step"), a["weight"].alias("weight"), deps(a).alias("deps"))).alias("steps"))


def _settled(spark: SparkSession, d: str, then) -> DataFrame:
    """then(the settled steps): small orders are dealt once, and all that follows stays in their parts; any others go wave by wave."""
    rows, at = spark.read.parquet(f"{d}/lineitem.parquet"), folder(spark, "plans")
    many = rows.groupBy(F.col("l_orderkey").alias("plan")).agg(F.count("*").alias("n")).where((F.col("n") > SMALL) | F.col("plan").isNull())
    many.select("plan").write.parquet(f"{at}/large")
    large = spark.read.schema(many.select("plan").schema).parquet(f"{at}/large")
    some = not large.isEmpty()
    small = rows.join(large, F.col("l_orderkey").eqNullSafe(F.col("plan")), "left_anti") if some else rows
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // ROWS + 1)
    out = then(G.settle_small(_packed(_steps_of(small.select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", "l_linestatus").repartition(parts, "l_orderkey")))))
    if not some:
        return out
    steps = _steps_of(rows.join(large, F.col("l_orderkey").eqNullSafe(F.col("plan")), "left_semi"))
    return out.unionByName(then(G.settle(steps, _edges(steps), f"{at}/waves")))


def order_plan_edges(spark, d):
    return _edges(_steps(spark, d))


def order_plan_schedule(spark, d):
    """Level, start and finish in days of each step, and its place in the plan's order of execution."""
    return _settled(spark, d, G.execution_order).select("plan", "step", "level", (F.col("finish") - F.col("weight")).alias("start"), "finish", "position")


def order_plan_critical_path(spark, d):
    return _settled(spark, d, G.critical_paths).select("plan", "finish", F.array_join("path", ",").alias("path"))


def order_plan_groups(spark, d):
    return _settled(spark, d, G.parallel_groups).select("plan", "level", F.array_join("steps", ",").alias("steps"))


def order_plan_ready(spark, d):
    steps = _steps(spark, d)
    return G.ready(steps, _edges(steps))


QUERIES = {f.__name__: f for f in (order_plan_edges, order_plan_schedule, order_plan_critical_path, order_plan_groups, order_plan_ready)}
_S = """s AS (SELECT l_orderkey AS plan, l_linenumber AS step, (r).ships AS ships, CAST(ceil(-(r).q / 10) AS BIGINT) AS weight, (r).status = 'F' AS done FROM (SELECT l_orderkey, l_linenumber, min({'ships': l_shipdate, 'q': -l_quantity, 'status': l_linestatus}) AS r FROM lineitem GROUP BY ALL)),
e AS (SELECT a.plan, a.step, b.step AS dep FROM s a JOIN s b ON a.plan = b.plan AND a.step <> b.step AND CAST(b.ships AS DATE) + CAST(b.weight AS INTEGER) <= CAST(a.ships AS DATE))"""
_P = f"""WITH RECURSIVE {_S}, p AS (SELECT plan, step, 0 AS level, weight AS finish, weight, [step] AS path FROM s WHERE NOT EXISTS (FROM e WHERE e.plan = s.plan AND e.step = s.step)
UNION ALL SELECT s.plan, s.step, level + 1, finish + s.weight, s.weight, list_append(path, s.step) FROM p JOIN e ON e.plan = p.plan AND e.dep = p.step JOIN s ON s.plan = e.plan AND s.step = e.step),
t AS (SELECT plan, step, max(level) AS level, max(finish) AS finish, any_value(weight) AS weight FROM p GROUP BY plan, step)"""
ORACLES = {
    "order_plan_edges": f"WITH {_S} SELECT * FROM e",
    "order_plan_schedule": f"{_P} SELECT plan, step, level, finish - weight AS start, finish, CAST(row_number() OVER (PARTITION BY plan ORDER BY level, step) AS INTEGER) AS position FROM t",
    "order_plan_critical_path": f"{_P} SELECT plan, finish, array_to_string(path, ',') AS path FROM p QUALIFY row_number() OVER (PARTITION BY plan ORDER BY finish DESC, path) = 1",
    "order_plan_groups": f"{_P} SELECT plan, level, string_agg(step, ',' ORDER BY step) AS steps FROM t GROUP BY plan, level HAVING count(*) > 1",
    "order_plan_ready": f"WITH {_S} SELECT plan, step FROM s WHERE NOT done AND NOT EXISTS (FROM e JOIN s b ON b.plan = e.plan AND b.step = e.dep AND NOT b.done WHERE e.plan = s.plan AND e.step = s.step)",
}
