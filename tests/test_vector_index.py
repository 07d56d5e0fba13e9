import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import vector_index as V
from tessera.plans import indexing

SF = "/root/testdata/sf0.001"


def clustered(spark, n=3000, dim=16, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(40, dim))
    x = centres[r.integers(0, 40, n)] + 0.25 * r.normal(size=(n, dim))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(n + i, x[0].tolist()) for i in range(1000)]  # copies of one vector
    rows += [(9000, None), (9001, [0.0] * dim), (9002, [float("nan")] * dim), (9003, [None] * dim), (None, x[1].tolist())]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), dict(x for x in rows if x[0] is not None and x[0] < 9000)


def exact(vectors, queries, k):
    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids])
    x = x / np.linalg.norm(x, axis=1)[:, None]
    out = {}
    for q in queries:
        s = x @ x[ids.searchsorted(q)]
        order = np.lexsort((ids, -np.round(s, 12)))
        out[q] = [(int(ids[o]), float(s[o])) for o in order[:k]]
    return out


def test_recall_scores_and_pruning(spark, tmp_path):
    df, vectors = clustered(spark)
    rows = V.usable(df)
    assert rows.count() == len(vectors)
    index = V.VectorIndex.build(rows, f"{tmp_path}/i", recall=0.95)
    again = V.VectorIndex.open(spark, f"{tmp_path}/i")
    assert again.read().count() == len(vectors) and again.probes == index.probes < len(index.centroids) / 4
    asked = rows.where("id % 20 = 0")
    got = {}
    for r in again.search(asked, 10).collect():
        got.setdefault(r["query"], []).append(r)
    queries = [i for i in vectors if i % 20 == 0]
    want = exact(vectors, queries, 10)
    assert set(got) == set(queries)
    # ties among the copies: a hit is a row as near as the tenth
    hits = [sum(r["score"] >= want[q][-1][1] - 1e-9 for r in got[q]) / 10 for q in queries]
    assert np.mean(hits) >= 0.9
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in vectors.items()}
    assert all(abs(r["score"] - unit[q] @ unit[r["id"]]) < 1e-9 for q in queries for r in got[q])
    few = again.search(rows.where("id = 40"), 10, probes=2)
    cells = {r["c"] for r in V._nearest(rows.where("id = 40"), again.centroids, 2).select(F.explode("cells").alias("c")).collect()}
    part = again.read().where(F.col("cell").isin(list(cells)))
    assert few.count() == 10 and len(part.inputFiles()) and part.count() < len(vectors) / 2


def test_all_cells_give_the_exact_answer(spark, tmp_path):
    df, vectors = clustered(spark, 400, 8, 3)
    rows = V.usable(df)
    index = V.VectorIndex.build(rows, f"{tmp_path}/e", cells=12, recall=None)
    got = {}
    for r in index.search(rows.where("id < 20"), 5).orderBy("rank").collect():
        got.setdefault(r["query"], []).append(round(r["score"], 9))
    assert got == {q: [round(s, 9) for _, s in w] for q, w in exact(vectors, range(20), 5).items()}


def test_empty(spark, tmp_path):
    rows = V.usable(spark.createDataFrame([], "vec_id bigint, embedding array<float>"))
    index = V.VectorIndex.build(rows, f"{tmp_path}/n")
    assert V.VectorIndex.open(spark, f"{tmp_path}/n").search(rows).count() == 0 == index.search(rows).count()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_recall_on_the_table(spark):
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    got = {}
    for r in indexing.vector_index_topk(spark, SF).collect():
        got.setdefault(r["query"], set()).add(r["id"])
    want = exact(vectors, [i for i in vectors if i % 20 == 0], 10)
    assert np.mean([len(got[q] & {i for i, _ in w}) / 10 for q, w in want.items()]) >= 0.9
