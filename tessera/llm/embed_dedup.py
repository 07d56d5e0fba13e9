"""Operator 10: near-duplicate vectors by Euclidean p-stable hashing.

Vectors are scaled to length 1, so cosine >= t is distance <= sqrt(2 - 2t). TABLES tables of PROJECTIONS quantised
Gaussian projections of width WIDTH each put them into buckets; all pairs of a bucket get an exact cosine in double
precision. At cosine 0.95 (distance 0.316) a pair shares a table with probability 0.16 and misses all 32 with 0.3 %.

Equal vectors are one class from the start and count through their number. Buckets are cut into blocks of BLOCK members:
a bucket of any size is many small tasks, each pair of blocks one group, and no pair leaves its task. What leaves is one
row for each linked vector and block: its number of links and the smallest vector of its component there. A pair that
shares several tables counts in the first.

Defined results: null, empty or zero vectors and those with null or non-finite components are linked with nothing and
kept; vectors of different lengths are never linked; repeated vec_ids count as vectors each, and so do rows without one, which come last; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Stash, components, keyed, mix, roots, sorted_groups, table, unkeyed

TABLES, PROJECTIONS, WIDTH, BLOCK, LEAST, SEED = 32, 8, 1.25, 512, 0.95, 10


def valid(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(rows: np.ndarray) -> np.ndarray:
    x = rows / np.abs(rows).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


_PLANES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def buckets(x: np.ndarray) -> np.ndarray:
    """(vectors, TABLES) bucket hashes of unit vectors."""
    d = x.shape[1]
    if d not in _PLANES:
        r = np.random.Generator(np.random.PCG64([SEED, d]))
        _PLANES[d] = r.standard_normal((d, TABLES * PROJECTIONS)), r.uniform(0, WIDTH, TABLES * PROJECTIONS)
    a, b = _PLANES[d]
    q = np.floor((x @ a + b) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(x), TABLES, PROJECTIONS)
    h = np.full((len(x), TABLES), d, dtype=np.uint64)
    for j in range(PROJECTIONS):
        h = mix(h * np.uint64(31) + q[:, :, j])
    return h


def _rows(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) for each vector length of a batch's list column."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    n = np.diff(column.offsets.to_numpy())
    ends = np.cumsum(n)
    return [((at := np.flatnonzero(n == d)), flat[(ends[at] - d)[:, None] + np.arange(d)]) for d in np.unique(n)]


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = np.zeros((b.num_rows, TABLES), dtype=np.uint64)
        for at, x in _rows(b.column(1)):
            out[at] = buckets(unit(x.astype(np.float64)))
        flat = pa.ListArray.from_arrays(np.arange(b.num_rows + 1, dtype=np.int32) * TABLES, out.view(np.int64).ravel())
        yield pa.RecordBatch.from_arrays([b.column(0), flat], names=["rep", "hs"])


def _block(t: int, same: bool, ids: np.ndarray, copies: np.ndarray, side: np.ndarray, x: np.ndarray, least: float):
    """(ids, links, roots) of the members of one block that have links first found in table t."""
    x = unit(x.astype(np.float64))
    cos = x @ x.T
    near = np.triu(cos >= least - 1e-9, 1)
    if not same:
        near &= side[:, None] != side[None, :]
    a, b = np.nonzero(near)
    exact = np.einsum("ij,ij->i", x[a], x[b]) >= least
    a, b = a[exact], b[exact]
    if not len(a):
        return None
    h = buckets(x)
    first = np.ones(len(a), dtype=bool)
    for at in range(0, len(a), 65536):
        s = slice(at, at + 65536)
        first[s] = (h[a[s], : t + 1] == h[b[s], : t + 1]).argmax(axis=1) == t
    a, b = a[first], b[first]
    if not len(a):
        return None
    links = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
    on = links > 0
    return ids[on], links[on].astype(np.int64), roots(len(ids), a, b, ids)[on]


def _blocks(least: float):
    """Over rows (t, key, same, side, rep, copies, v) sorted by key: the members' links, group after group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for left, cuts in sorted_groups(batches, 1):
            t, same, side = left.column(0).to_numpy(), left.column(2).to_numpy(zero_copy_only=False), left.column(3).to_numpy()
            ids, copies, v = left.column(4).to_numpy(), left.column(5).to_numpy(), left.column(6)
            flat, ends = v.flatten().to_numpy(zero_copy_only=False), v.offsets.to_numpy()
            ends = ends - ends[0]
            made = []
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if j - i > 1:
                    x = flat[ends[i] : ends[j]].reshape(j - i, -1)
                    made.append(_block(int(t[i]), bool(same[i]), ids[i:j], copies[i:j].astype(np.float64), side[i:j], x, least))
            if made := [m for m in made if m]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([m[k] for m in made])) for k in range(3)], names=["node", "links", "root"])

    return run


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = LEAST) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector."""
    stash = Stash(vectors.sparkSession)
    v = F.transform(vector, lambda x: x + F.lit(0.0).cast("float") if _single(vectors, vector) else x + F.lit(0.0))  # -0.0 becomes 0.0
    every = vectors.select(keyed(key).alias("vec_id"), F.when(valid(F.col(vector)), v).alias("v"))
    every = every.withColumn("same", F.when(F.col("v").isNotNull(), F.sha2(F.array_join(F.transform("v", lambda x: x.cast("string")), ","), 256)))
    classes = stash.keep(every.where("v is not null").groupBy("same").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v")))
    hashed = classes.select("rep", "v").mapInArrow(_hash, "rep bigint, hs array<bigint>")
    entries = stash.keep(hashed.select("rep", F.posexplode("hs").alias("t", "h")))
    crowd = entries.groupBy("t", "h").agg(F.count("*").alias("members")).where("members > 1")
    parts = F.ceil(F.col("members") / BLOCK).cast("int")
    placed = entries.join(crowd, ["t", "h"]).withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    blocks = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low, high = F.least("part", "other"), F.greatest("part", "other")
    blocks = blocks.select("t", F.xxhash64("t", "h", low, high).alias("key"), (low == high).alias("same_part"), "part", "rep")
    rows = blocks.join(classes.select("rep", "copies", "v"), "rep").select("t", "key", "same_part", "part", "rep", "copies", "v")
    found = stash.keep(rows.repartition("key").sortWithinPartitions("key", "t", "rep").mapInArrow(_blocks(least), "node bigint, links bigint, root bigint"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    comp = components(stash, found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    told = classes.select("same", "rep", "copies").join(links.withColumnRenamed("node", "rep"), "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    told = told.select("same", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = every.select("vec_id", "same").join(told, "same", "left")
    own = F.coalesce("component", "vec_id")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), (F.col("vec_id") == own).alias("kept"))
    return out.select(unkeyed("vec_id").alias("vec_id"), "n_links", unkeyed("component_id").alias("component_id"), "kept")


def _single(df: DataFrame, vector: str) -> bool:
    return df.schema[vector].dataType.simpleString() == "array<float>"


def op10_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op10_embed_dedup": op10_embed_dedup}
#: All pairs, for small tables.
ORACLES = {
    "op10_embed_dedup": f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {LEAST}),
r AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON r.vec_id = l.a)
SELECT r.vec_id, coalesce(any_value(n.n), 0) AS n_links, min(c) AS component_id, r.vec_id = min(c) AS kept FROM r LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) n ON n.a = r.vec_id GROUP BY r.vec_id"""
}
