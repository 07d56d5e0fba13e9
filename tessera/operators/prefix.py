"""Running sums and extremes, successors and chains over groups of any size: ranges of the order are met apart, then get the results of
the ranges before."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 64


def ranges(df: DataFrame, order: str, parts: int = RANGES) -> Column:
    """The range, 0 .. parts - 1, of a row by a numeric or time column; equal values share one, nulls are in the first.

    Bounds are quantiles of the whole table, a few numbers; they set how even the ranges are, never the result.
    """
    x = F.col(order).cast("double")
    bounds = sorted(set(df.select(x.alias("x")).approxQuantile("x", [k / parts for k in range(1, parts)], 0.5 / parts)))
    if not bounds:
        return F.lit(0)
    return F.coalesce(reduce(lambda a, b: a + b, ((x > b).cast("int") for b in bounds)), F.lit(0))


def running(df: DataFrame, fold: Callable[[str], Column], merge: Callable[[Column, Column], Column], value: str, by: list[str], order: str, ties: list[str] | None = None, out: str = "running", parts: int = RANGES, down: bool = False) -> DataFrame:
    """df with `out`: `fold` (a sum, a least or greatest value) of `value` over the rows of a group up to this one, in the order
    of `order` (nulls first), then `ties`; with `down` the rows are met from the last to the first.

    A group is cut into ranges of the order, so one with a third of all rows is `parts` tasks; the results of a group's
    ranges, at most `parts` rows, give each range what comes before it; `merge` joins the two. As in SQL, nulls are passed over.
    """
    turn = (lambda c: F.col(c).desc()) if down else F.col
    cut = df.withColumn("_range", ranges(df, order, parts))
    w = Window.partitionBy(*by, "_range").orderBy(turn(order), *map(turn, ties or [])).rowsBetween(Window.unboundedPreceding, 0)
    within = cut.withColumn("_within", fold(value).over(w))
    before = Window.partitionBy(*by).orderBy(turn("_range")).rowsBetween(Window.unboundedPreceding, -1)
    told = cut.groupBy(*by, "_range").agg(fold(value).alias("_told"))
    told = told.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("_range").alias("_at"), fold("_told").over(before).alias("_before"))
    same = F.col("_range") == F.col("_at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return within.join(told, same).withColumn(out, F.coalesce(merge(F.col("_within"), F.col("_before")), F.col("_within"), F.col("_before"))).select(*df.columns, out)


def running_sum(df: DataFrame, value: str, by: list[str], order: str, ties: list[str] | None = None, out: str = "running", parts: int = RANGES) -> DataFrame:
    """df with `out`: the sum of `value` over the rows of a group up to this one, null where there were only nulls."""
    return running(df, F.sum, lambda a, b: a + b, value, by, order, ties, out, parts)


def running_max(df: DataFrame, value: str, by: list[str], order: str, ties: list[str] | None = None, out: str = "running", parts: int = RANGES) -> DataFrame:
    """df with `out`: the greatest `value` of the rows of a group up to this one, null where there were only nulls."""
    return running(df, F.max, F.greatest, value, by, order, ties, out, parts)


def successors(points: DataFrame, by: list[str], at: str, gap: int, parts: int = RANGES) -> DataFrame:
    """(by, at, next): for each of points(by, at bigint) the first `at` of its group later than its own by more than `gap`; points without one,
    or without a time, are left out.

    An as-of join by order: points and their ends (at + gap) lie in one order, and met from the last to the first the least point
    so far is what follows an end. Groups are cut into ranges of that order.
    """
    p = points.where(F.col(at).isNotNull())
    ends = p.select(*by, F.try_add(at, F.lit(gap)).alias("_x"), F.lit(True).alias("_end")).where("_x is not null")
    both = p.select(*by, F.col(at).alias("_x"), F.lit(False).alias("_end")).unionByName(ends).withColumn("_point", F.when(~F.col("_end"), F.col("_x")))
    met = running(both, F.min, F.least, "_point", by, "_x", ["_end"], "next", parts, down=True)  # an end is met before the point of its own time, which isn't later
    return met.where("_end and next is not null").select(*by, (F.col("_x") - gap).alias(at), "next")


def written(df: DataFrame, path: str, by: list[str] | None = None) -> DataFrame:
    """df, written and read again: a lost executor costs a reread, and the shuffles before the table go with its writing. `by`: a folder for
    each value of these columns."""
    spark, name = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        df.write.option("compression", "zstd").partitionBy(*by or []).parquet(path)
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    return spark.read.schema(df.schema).parquet(path)


def chain(points: DataFrame, by: list[str], at: str, gap: int, folder: str, parts: int = RANGES, repeats: bool = True) -> DataFrame:
    """(by, at, n): the first of points(by, at bigint) of each group, n = 1, then always the first that is later by more than `gap`.

    Successor links are doubled: a level joins the links of the level before with themselves, so that they leap twice as far, and keeps those
    that start at a first point or where a leap ends: no other is met. Levels are the logarithm of the longest chain, and shrink as points
    share their successors. Then the levels are gone through again from the longest leaps to single links, and each doubles the points that
    are reached. Links are dealt by group and time, so no key is hot. Tables are written under `folder`, which all executors share.
    `repeats` says that points may stand more than once.
    """
    rounds = 0

    def keep(df: DataFrame) -> DataFrame:
        nonlocal rounds
        rounds += 1
        return written(df, f"{folder}/chain-{rounds}")

    def renamed(df: DataFrame, start: str) -> DataFrame:
        return df.select(*(F.col(c).alias(f"_to_{c}") for c in by), F.col(start).alias("_start"), *([F.col("next").alias("_next")] if start == at and "next" in df.columns else []))

    def met(on: str) -> Column:
        same = F.col(on) == F.col("_start")
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"_to_{c}"))
        return same

    points = points.where(F.col(at).isNotNull()).select(*by, at)
    if repeats:
        points = keep(points.distinct())
    first = keep(points.groupBy(*by).agg(F.min(at).alias(at)))
    links, levels = keep(successors(points, by, at, gap, parts)), []
    while True:
        starts = renamed(first, at).unionByName(renamed(links, "next")).distinct()
        links = keep(links.join(starts, met(at), "left_semi"))
        if links.isEmpty():
            break
        levels.append(links)
        links = keep(links.join(renamed(links, at), met("next")).select(*by, at, F.col("_next").alias("next")))
    reached = first.withColumn("n", F.lit(0).cast("long"))
    for links in reversed(levels):
        leapt = reached.join(renamed(links, at), met(at)).select(*by, F.col("_next").alias(at), (F.col("n") * 2 + 1).alias("n"))
        reached = keep(reached.select(*by, at, (F.col("n") * 2).alias("n")).unionByName(leapt))
    return reached.withColumn("n", F.col("n") + 1)
