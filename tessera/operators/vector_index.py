"""Inverted-file index of vectors: approximate top-K by cosine without a full scan.

Cells are the nearest of `cells` centroids, fitted on a bounded sample; all vectors are indexed, as Parquet partitions by cell.
A search takes each query's nearest cells (`probes`), reads these partitions only and scores their vectors exactly, so an
answer may miss neighbours in other cells but never has a wrong score. `calibrate` sets probes to the least number that reaches a recall
on a sample of queries, measured against all vectors.

Scale: what is broadcast is the table of centroids (`cells` x dimensions, at most MOST_CELLS of them). Vectors move once, to their
cell; a large cell's vectors are dealt over up to PARTS parts, and so are the queries that ask for it, so a cell with a third of all rows (copies of one vector) is
no single task. Vectors that are null, zero or hold null or non-finite components are in no cell and are found by nobody.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.prefix import written

SAMPLE, MOST_CELLS, PARTS, QUERIES = 8192, 1024, 8, 128
#: Rows of a part of a cell, up to PARTS parts; scores that a task holds at once.
PART, BLOCK = 4096, 1 << 21


def usable(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v) of the rows that can be compared, v of unit length."""
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    good = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (norm > 0) & (norm < float("inf"))
    return df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).where(good).select(F.col(key).cast("long").alias("id"), F.transform(v, lambda x: x / norm).alias("v"))


def fit(vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """Unit centroids by k-means on the `sample` vectors that come first by a hash of their ids; sqrt(rows) cells by default."""
    n = vectors.count()
    code = F.xxhash64(F.lit(seed), "id")
    own = lambda df: df.orderBy(code, "id").limit(sample).collect()
    # each task tells the driver so many rows; of a large table only the lowest hashes can be among the first
    points = own(vectors.where(code < -(1 << 63) + (1 << 64) // n * 2 * sample)) if n > 4 * sample else own(vectors)
    if len(points) < min(n, sample):
        points = own(vectors)
    if not points:
        return np.zeros((0, 0))
    x = np.array([p["v"] for p in points])
    n = min(len(x), cells or min(MOST_CELLS, max(1, math.isqrt(n))))
    at = x[np.random.default_rng(seed).choice(len(x), n, replace=False)]
    for _ in range(rounds):
        near = (x @ at.T).argmax(axis=1)
        at = np.stack([m / (np.linalg.norm(m) or 1) if (near == k).any() and (m := x[near == k].mean(axis=0)).any() else at[k] for k in range(n)])
    return at


def _nearest(vectors: DataFrame, centroids: np.ndarray, most: int) -> DataFrame:
    """(id, v, cells) with the `most` nearest cells of each vector, nearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.array(b.column("v").to_pylist(), dtype=float)
                order = np.argsort(-(x @ centroids.T), axis=1, kind="stable")[:, :most].astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(list(order), type=pa.list_(pa.int32()))], names=["id", "v", "cells"])

    return vectors.select("id", "v").mapInArrow(run, "id bigint, v array<double>, cells array<int>")


def _true_neighbours(rows: DataFrame, asked: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """(query, id, cell, score, rank) of the k best of all rows(id, v, cell) for a bounded set of queries, which goes to all tasks
    once: their vectors are not repeated for cells and parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids, cell = (b.column(c).to_numpy(zero_copy_only=False) for c in ("id", "cell"))
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            score = np.where(ids[:, None] == asked[None, :], -np.inf, x @ q.T)
            best = [np.lexsort((ids, -score[:, j]))[:k] for j in range(len(asked))]
            at, j = np.concatenate(best), np.repeat(np.arange(len(asked)), [len(o) for o in best])
            at, j = (v[np.isfinite(score[at, j])] for v in (at, j))
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (asked[j], ids[at], cell[at], score[at, j])], names=["query", "id", "cell", "score"])

    best = rows.select("id", "v", "cell").mapInArrow(run, "query bigint, id bigint, cell int, score double")
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class VectorIndex:
    """Centroids, the folder of the cells' partitions, and the number of cells that a search probes."""

    def __init__(self, spark: SparkSession, path: str, centroids: np.ndarray, probes: int):
        self.spark, self.path, self.centroids, self.probes = spark, path, centroids, probes

    @classmethod
    def build(cls, vectors: DataFrame, path: str, cells: int | None = None, recall: float | None = 0.95, k: int = 10) -> VectorIndex:
        """Writes vectors(id, v) by cell under path/cells and what a reader needs beside them; probes are calibrated to `recall`."""
        spark = vectors.sparkSession
        at = fit(vectors, cells)
        out = cls(spark, path, at, max(1, len(at)))
        near = written(_nearest(vectors, at, 1).select("id", "v", F.get("cells", F.lit(0)).alias("cell")), f"{path}/near")
        parts = near.groupBy("cell").agg(F.least(F.lit(PARTS), F.ceil(F.count("*") / PART)).cast("int").alias("parts"))  # a row a cell
        dealt = near.join(F.broadcast(parts), "cell").select("id", "v", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), "cell")
        dealt.repartition("cell", "part").write.partitionBy("cell").parquet(f"{path}/cells")
        if recall and len(at):
            out.calibrate(recall, k)
        spark.createDataFrame([(json.dumps(at.tolist()), out.probes)], "centroids string, probes int").coalesce(1).write.parquet(f"{path}/meta")
        return out

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> VectorIndex:
        m = spark.read.parquet(f"{path}/meta").first()
        at = np.array(json.loads(m["centroids"]), dtype=float)
        return cls(spark, path, at if at.size else np.zeros((0, 0)), m["probes"])

    def read(self) -> DataFrame:
        return self.spark.read.schema("id bigint, v array<double>, part int, cell int").parquet(f"{self.path}/cells")

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None, same: bool = True) -> DataFrame:
        """(query, id, score, rank) of the k best of the probed cells for each of queries(id, v); `same`: also a row of the query's id."""
        if not len(self.centroids):
            return self.spark.createDataFrame([], "query bigint, id bigint, score double, rank int")
        asked = _nearest(queries, self.centroids, probes or self.probes).select(F.col("id").alias("query"), F.col("v").alias("q"), F.explode("cells").alias("c"))
        parts = self.read().groupBy(F.col("cell").alias("c")).agg(F.max("part").alias("most"))  # a row a cell
        asked = asked.join(F.broadcast(parts), "c").withColumn("p", F.explode(F.sequence(F.lit(0), F.col("most"))))
        return self._best(asked, self.read(), k, same)

    def _best(self, asked: DataFrame, rows: DataFrame, k: int, same: bool) -> DataFrame:
        def run(own: pa.Table, asks: pa.Table) -> pa.Table:
            out = []
            if own.num_rows and asks.num_rows:
                x, q = (np.array(t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(t.num_rows, -1) for t, c in ((own, "v"), (asks, "q")))
                ids, by = own.column("id").to_numpy(), asks.column("query").to_numpy()
                step = max(1, BLOCK // len(ids))
                for lo in range(0, len(by), step):
                    some, score = q[lo : lo + step], np.zeros((len(q[lo : lo + step]), len(ids)))
                    for d in range(x.shape[1]):  # in the order of the dimensions, so equal vectors have equal scores
                        score += some[:, d, None] * x[None, :, d]
                    for n, i in zip(score, by[lo : lo + step], strict=True):
                        mine = np.arange(len(ids)) if same else np.flatnonzero(ids != i)
                        if len(mine) > k:
                            mine = mine[n[mine] >= np.partition(n[mine], len(mine) - k)[len(mine) - k]]
                        best = mine[np.lexsort((ids[mine], -n[mine]))[:k]]
                        out.append((np.full(len(best), i), ids[best], n[best]))
            made = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
            return pa.table(dict(zip(("query", "id", "score"), made, strict=True)))

        own = rows.select("id", "v", "cell", "part").groupBy("cell", "part")
        scored = own.cogroup(asked.select("query", "q", "c", "p").groupBy("c", "p")).applyInArrow(run, "query bigint, id bigint, score double")
        w = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
        return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    def calibrate(self, recall: float, k: int = 10, queries: int = QUERIES) -> float:
        """Sets probes to the least number whose mean recall at k is `recall` or more over a sample of indexed vectors; the
        recall measured. One exact search with all cells tells the cell of each true neighbour."""
        rows = self.read()
        sample = {r["id"]: r["v"] for r in rows.select("id", "v").orderBy(F.xxhash64(F.lit(2), "id"), "id").limit(queries).collect()}
        if not sample:
            return 1.0
        asked, q = np.array(list(sample)), np.array(list(sample.values()))
        found = _true_neighbours(rows, asked, q, k).select("query", "cell").collect()  # queries x k rows
        nearest = np.argsort(-(q @ self.centroids.T), axis=1, kind="stable")
        place = {i: np.argsort(o) for i, o in zip(asked.tolist(), nearest, strict=True)}  # the place of each cell for a query
        need = sorted(int(place[r["query"]][r["cell"]]) + 1 for r in found)
        if not need:
            return 1.0
        self.probes = int(need[min(len(need) - 1, math.ceil(recall * len(need)) - 1)])
        return sum(n <= self.probes for n in need) / len(need)
