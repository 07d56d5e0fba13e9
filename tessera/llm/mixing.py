"""Operator 6: mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Sizes are words. Targets are the water-filling of all words over the sources by weight, each at most `most` times its
source. The total is cut into BLOCKS equal blocks; a block goes to the source with the highest quotient
target / (2 * blocks held + 1), then within the source to the shard with the highest quotient size / (2 * held + 1).
A shard holds up to `most` times its words; what of its blocks it cannot hold goes to the source's other shards that can.
A shard takes its quota as whole passes over its documents plus the first blocks in a seeded document order.

Scale: the only wide shuffle carries (doc_id, size, source, shard) and deals each source over SHARDS shards, so a
source with a third of all rows is a thousand window groups. Quotients are made from tables of sources and of
(source, shard) pairs, never of documents; windows over all sources hold a row, or three quotients, for each source.

Defined results: null or empty texts have size 0 and 0 taken; a null source is a source of its own, last in order;
equal quotients fall to the earlier source and the lower shard; repeated rows count once each, ordered by doc_id; rows without
doc_id are dealt by their texts; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import packed, spread, Stash, table, words

BLOCKS, SHARDS, MOST, SEED = 1 << 16, 1024, 3, 20


def weight(rank):
    """1, 2, 3, repeating, by the source's place."""
    return (F.pmod(rank - 1, F.lit(3)) + 1).cast("double")


def targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """sources(source, source_size) with rank, weight and target. One row per source.

    Water level: with sources in the order of most * size / weight, the first k stop at their bound and the others share
    what is left by weight; k is the first for which nobody else would pass their bound.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    fill = Window.orderBy(F.col("bound") / F.col("weight"), "rank")
    s = sources.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", weight(F.col("rank"))).withColumn("bound", (most * F.col("source_size")).cast("double"))
    s = s.withColumn("full", F.coalesce(F.sum("bound").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("open", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("all", F.sum("source_size").over(everything).cast("double"))
    s = s.withColumn("level", (F.col("all") - F.col("full")) / F.col("open")).withColumn("fits", F.col("level") * F.col("weight") <= F.col("bound"))
    s = s.withColumn("final", F.min(F.when(F.col("fits"), F.struct(F.col("bound") / F.col("weight"), F.col("rank"), F.col("level")))).over(everything)["level"])
    return s.withColumn("target", F.coalesce(F.least(F.col("final") * F.col("weight"), F.col("bound")), F.col("bound"))).select("source", "source_size", "rank", "weight", "target")


def apportion(parties: DataFrame, n, share: str, order: list[str], group: list[str] | None = None, most: str | None = None) -> DataFrame:
    """parties with `seats`: n seats (a Column, per group) by the highest quotients share / (2 * seats held + 1).

    With P parties and exact parts q, the seats of a party lie between q (1 - P / 2n) - 1 and q (1 + P / 2n) + 1: rounding
    all parts up or down by that much fills the seats. Only the quotients between are put up, about three a party. With
    `most`, a column of counts, others may pass the upper bound, and up to P more are put up. Ties fall by `order`.
    """
    group = group or []
    w = Window.partitionBy(*group)
    p = parties.withColumn("_n", n).withColumn("_all", F.sum(share).over(w)).withColumn("_parties", F.count("*").over(w))
    exact, slack = F.col("_n") * F.col(share) / F.col("_all"), F.col("_parties") / (2 * F.col("_n"))
    some = (F.col("_all") > 0) & (F.col("_n") > 0) & (F.col(share) > 0)
    sure = F.when(some, F.greatest(F.lit(0), F.ceil(exact * (1 - slack) - 0.5) - 1)).otherwise(0)
    up = F.when(some, F.ceil(exact * (1 + slack) + 0.5) + 1 if most is None else F.ceil(exact) + F.col("_parties")).otherwise(0)
    cap = F.least(F.col("_n"), F.col(most)) if most else F.col("_n")
    p = p.withColumn("_up", F.least(up, cap).cast("long")).withColumn("_sure", F.least(sure, F.col("_up")).cast("long")).withColumn("_left", F.col("_n") - F.sum("_sure").over(w))
    keys = group + order
    seats = (
        p.where("_up > _sure")
        .select(*keys, "_left", F.col(share).alias("_share"), F.explode(F.sequence("_sure", F.col("_up") - 1)).alias("_j"))
        .withColumn("_place", F.row_number().over(Window.partitionBy(*group).orderBy((F.col("_share") / (2 * F.col("_j") + 1)).desc(), *order, "_j")))
        .where("_place <= _left")
        .groupBy(*keys)
        .agg(F.count("*").alias("_won"))
    )
    won = seats.select(*(F.col(k).alias(f"_{k}") for k in keys), "_won")
    return p.join(won, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left").select(*parties.columns, (F.col("_sure") + F.coalesce("_won", F.lit(0))).alias("seats"))


def refill(dealt: DataFrame, most: int) -> DataFrame:
    """dealt(source, shard, shard_size, quota, seats, block) with `shard_taken`: the quota's words, as far as the shards hold them."""
    by_shard, all_shards = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("source")
    held = F.least(F.col("seats") * F.col("block"), most * F.col("shard_size"))
    d = dealt.withColumn("_held", held).withColumn("_room", most * F.col("shard_size") - held)
    d = d.withColumn("_short", F.col("quota") * F.col("block") - F.sum("_held").over(all_shards)).withColumn("_before", F.coalesce(F.sum("_room").over(by_shard), F.lit(0)))
    more = F.greatest(F.lit(0), F.least(F.col("_room"), F.col("_short") - F.col("_before")))
    return d.withColumn("shard_taken", F.col("_held") + more).drop("_held", "_room", "_short", "_before")


def laid_out(docs: DataFrame, key: str, text: str, source: str, seed: int, blocks: int, shards: int, most: int, more: tuple[str, ...] = ()) -> DataFrame:
    """Every row of docs with its key, the columns `more`, its size, where it ends in its shard (`upto`), its shard's and source's
    words taken and the words of the shards before."""
    code = lambda n: F.xxhash64(F.lit(n), F.col(key), F.when(F.col(key).isNull(), F.col(text)))
    sized = docs.select(
        F.col(key).alias("key"),
        *more,
        F.size(words(F.col(text))).cast("long").alias("size"),
        F.col(source).alias("source"),
        F.pmod(code(seed), F.lit(shards)).cast("int").alias("shard"),
        code(seed + 1).alias("line"),
    )
    shard = sized.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"))
    plan = targets(shard.groupBy("source").agg(F.sum("shard_size").alias("source_size")), most)
    plan = plan.withColumn("all", F.sum("source_size").over(Window.partitionBy()))
    block = F.greatest(F.lit(1).cast("long"), F.floor(F.col("all") / blocks))
    plan = apportion(plan.withColumn("block", block), F.floor(F.col("all") / F.col("block")), "target", ["rank"])
    own = shard.join(plan.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    own = own.withColumnRenamed("seats", "quota").withColumn("most", F.ceil(most * F.col("shard_size") / F.col("block")))
    dealt = apportion(own, F.col("quota"), "shard_size", ["shard"], ["rank"], "most")
    dealt = refill(dealt, most)
    # a source at its bound is taken whole, `most` times
    taken = F.when(F.col("target") >= most * F.col("source_size"), most * F.col("shard_size")).otherwise(F.col("shard_taken"))
    dealt = dealt.withColumn("shard_taken", taken).withColumn("source_taken", F.sum("shard_taken").over(Window.partitionBy("source")))
    dealt = dealt.withColumn("before", F.coalesce(F.sum("shard_size").over(Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    quotas = dealt.select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), "source_size", "target", "shard_size", "shard_taken", "source_taken", "before")
    line = Window.partitionBy("source", "shard").orderBy("line", "key", "size", *more)
    laid = sized.withColumn("upto", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return laid.join(quotas, F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard")))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED, blocks: int = BLOCKS, shards: int = SHARDS, most: int = MOST) -> DataFrame:
    """(key, size, source, source_size, target, taken) of every row of docs."""
    out = laid_out(docs, key, text, source, seed, blocks, shards, most)
    passes = F.when(F.col("shard_size") > 0, F.floor(F.col("shard_taken") / F.col("shard_size"))).otherwise(0)
    rest = F.col("shard_taken") - passes * F.col("shard_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col("upto") - F.col("size"))))
    return out.select(F.col("key").alias(key), "size", "source", "source_size", "target", (passes * F.col("size") + part).cast("long").alias("taken"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))).select("doc_id", "size", "source_size", "target", "taken")


def whole_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED, blocks: int = BLOCKS, shards: int = SHARDS, most: int = MOST, more: tuple[str, ...] = ()) -> DataFrame:
    """(key, more.., size, source, target, times) of every row of docs: how often it is taken whole.

    A source's words in all shards, one after the other, are one line in seeded order. Its documents are taken in whole
    passes, and once more while their middle lies before what is left of the quota: it is met to half a document.
    """
    out = laid_out(docs, key, text, source, seed, blocks, shards, most, more)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("source_taken") / F.col("source_size"))).otherwise(0)
    rest = F.col("source_taken") - passes * F.col("source_size")
    once_more = F.col("before") + F.col("upto") - F.col("size") / 2 < rest
    return out.select("key", *more, "size", "source", "target", F.when(F.col("size") > 0, passes + once_more.cast("int")).otherwise(0).cast("long").alias("times"))


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it whole (whole_documents); a source's words meet its quota to half a document.

    The copies keep the document's columns. Documents of size 0 are in no block and go. Rows are numbered as they are written, so
    rows that share a doc_id, or have none, are each taken as often as they are by themselves.
    """
    rows = Stash(spark).keep(docs.select(packed(docs).alias("row")), "n")
    times = whole_documents(rows, "row.doc_id", "row.text", "row.source", more=("n",)).where("times > 0").select(F.col("n").alias("m"), "times")
    return rows.join(times, F.col("n") == F.col("m")).select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("row.*")


QUERIES = {"op6_mix_sources": op6_mix_sources}
ORACLES: dict[str, str] = {}
