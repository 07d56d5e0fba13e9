"""Dependency graphs of plans as tables: levels, finish times, critical paths and parallel groups, wave by wave.

A wave settles the steps whose dependencies are all settled, tells the steps that wait for them, and is written: rounds follow the longest
path, each round costs the edges of what is still open, and a plan of any size is dealt over tasks by its steps. Steps on or behind a
cycle are never settled and come out with nulls. Plans of few steps, each of them one row, go through their waves in place: no edge is written or shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def settle(steps: DataFrame, edges: DataFrame, folder: str) -> DataFrame:
    """(plan, step, weight, level, finish, path) of steps(plan, step, weight > 0) under edges(plan, step, dep).

    level: 0 without dependencies, else one above the highest of them. finish: the weight on the heaviest chain of dependencies up to the step, itself
    included; path: that chain, of equal ones the one with the smaller steps. Repeated edges count once; edges to steps that aren't there don't count.
    Waves are written under `folder`, which all executors share.
    """
    spark, n = steps.sparkSession, 0

    def keep(df: DataFrame) -> DataFrame:
        nonlocal n
        n += 1
        df.write.parquet(f"{folder}/{n}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{n}")

    real = steps.select("plan", F.col("step").alias("dep"))
    edges = keep(edges.select("plan", "step", "dep").distinct().join(real, ["plan", "dep"], "left_semi"))
    needs = edges.groupBy("plan", "step").agg(F.count("*").alias("needs"))
    none = F.lit(None).cast(f"struct<minus:bigint,path:array<{dict(steps.dtypes)['step']}>>")
    waiting = keep(steps.select("plan", "step", "weight").join(needs, ["plan", "step"], "left").withColumn("needs", F.coalesce("needs", F.lit(0))).withColumn("best", none))
    settled, level = None, 0
    while True:
        now = waiting.where("needs = 0").select(
            "plan", "step", "weight", F.lit(level).alias("level"), (F.col("weight") - F.coalesce("best.minus", F.lit(0))).cast("long").alias("finish"), F.concat(F.coalesce("best.path", F.array().cast(f"array<{dict(steps.dtypes)['step']}>")), F.array("step")).alias("path")
        )
        now = keep(now)
        if now.isEmpty():
            break
        settled = now if settled is None else settled.unionByName(now)
        said = edges.join(now.select("plan", F.col("step").alias("dep"), F.struct((-F.col("finish")).alias("minus"), "path").alias("b")), ["plan", "dep"])
        said = said.groupBy("plan", "step").agg(F.count("*").alias("told"), F.min("b").alias("b"))
        rest = waiting.where("needs > 0").join(said, ["plan", "step"], "left")
        waiting = keep(rest.select("plan", "step", "weight", (F.col("needs") - F.coalesce("told", F.lit(0))).alias("needs"), F.least("best", "b").alias("best")))
        level += 1
    lost = waiting.select("plan", "step", "weight", F.lit(None).cast("int").alias("level"), F.lit(None).cast("long").alias("finish"), F.lit(None).cast(f"array<{dict(steps.dtypes)['step']}>").alias("path"))
    return lost if settled is None else settled.unionByName(lost)


def settle_small(plans: DataFrame) -> DataFrame:
    """The same of plans(plan, steps), steps an array of (step, weight, deps array): a plan's work is up to the cube of its steps, so for small ones."""
    step, weight = (f.dataType.simpleString() for f in plans.schema["steps"].dataType.elementType.fields[:2])
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    out = f"step:{step},weight:{weight},level:int,finish:bigint,path:array<{step}>"

    def wave(acc, level):
        def told(s):
            best = F.array_min(F.transform(F.filter(acc["done"], lambda t: F.array_contains(s["deps"], t["step"])), lambda t: F.struct((-t["finish"]).alias("minus"), t["path"].alias("path"))))
            return let(
                best,
                lambda b: F.struct(
                    s["step"].alias("step"), s["weight"].alias("weight"), level.alias("level"), (s["weight"] - F.coalesce(b["minus"], F.lit(0))).cast("long").alias("finish"),
                    F.concat(F.coalesce(b["path"], F.array().cast(f"array<{step}>")), F.array(s["step"])).alias("path"),
                ),
            )

        waits = lambda s: F.exists(s["deps"], lambda d: F.exists(acc["open"], lambda o: F.coalesce(o["step"] == d, F.lit(False))))
        flagged = F.transform(acc["open"], lambda s: F.struct(s["step"].alias("step"), s["weight"].alias("weight"), s["deps"].alias("deps"), waits(s).alias("waits")))
        return let(flagged, lambda o: F.struct(F.filter(o, lambda s: s["waits"]).alias("open"), F.concat(acc["done"], F.transform(F.filter(o, lambda s: ~s["waits"]), told)).alias("done")))

    start = F.transform("steps", lambda s: F.struct(s["step"].alias("step"), s["weight"].alias("weight"), s["deps"].alias("deps"), F.lit(True).alias("waits")))
    start = F.struct(start.cast(f"array<struct<step:{step},weight:{weight},deps:array<{step}>,waits:boolean>>").alias("open"), F.array().cast(f"array<struct<{out}>>").alias("done"))
    lost = lambda s: F.struct(s["step"], s["weight"], F.lit(None).cast("int"), F.lit(None).cast("bigint"), F.lit(None).cast(f"array<{step}>")).cast(f"struct<{out}>")
    end = F.aggregate(F.sequence(F.lit(0), F.size("steps") - 1), start, wave, lambda acc: F.concat(acc["done"], F.transform(acc["open"], lost)))
    return plans.where(F.size("steps") > 0).select("plan", F.explode(end).alias("s")).select("plan", "s.*")


def execution_order(settled: DataFrame) -> DataFrame:
    """Settled steps with `position`, by level, then step."""
    w = Window.partitionBy("plan").orderBy("level", "step")
    return settled.where("level is not null").withColumn("position", F.row_number().over(w))


def critical_paths(settled: DataFrame) -> DataFrame:
    """(plan, finish, path): the heaviest chain of each plan, of equal ones the one with the smaller steps."""
    best = settled.where("level is not null").groupBy("plan").agg(F.min(F.struct((-F.col("finish")).alias("minus"), "path")).alias("b"))
    return best.select("plan", (-F.col("b.minus")).alias("finish"), F.col("b.path").alias("path"))


def parallel_groups(settled: DataFrame) -> DataFrame:
    """(plan, level, steps): levels with two steps or more."""
    g = settled.where("level is not null").groupBy("plan", "level").agg(F.array_sort(F.collect_list("step")).alias("steps"))
    return g.where(F.size("steps") > 1)


def ready(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """(plan, step) of the open steps of steps(plan, step, done boolean) whose dependencies are all done."""
    blocking = edges.join(steps.where("not done").select("plan", F.col("step").alias("dep")), ["plan", "dep"]).select("plan", "step").distinct()
    return steps.where("not done").select("plan", "step").join(blocking, ["plan", "step"], "left_anti")
