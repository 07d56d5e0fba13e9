import math
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import hard_negatives as H

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, v string, h int, salt string"


def brute(rows):
    """The contract's rows of (vec_id, embedding, label), one anchor at a time."""
    own = []
    for i, e, label in rows:
        if i is None or e is None or label is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        own.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in e]))
    out = []
    for a in (r for r in own if r[0] % 50 == 0):
        score = [(-sum(x * y for x, y in zip(a[2], r[2], strict=False)), r[0], r[1]) for r in own if r is not a]
        score.sort()
        positives = [(s, i) for s, i, label in score if label == a[1]][:5]
        for s, i in positives:
            hard = [(n, j) for n, j, label in score if label != a[1] and 50 * -s <= 100 * -n <= 95 * -s][:3]
            out += [(a[0], i, k, j, -s, -n) for k, (n, j) in enumerate(hard, 1)]
    return sorted(out)


def told(df):
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, "z") for r in rows], SCHEMA)


def f32(x):
    import numpy as np

    return float(np.float32(x))


def make(seed, n=700, dim=6, spread=0.3):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(8)]
    rows = []
    for i in range(n):
        c = r.randrange(8)
        rows.append((i, [f32(x + r.gauss(0, spread)) for x in centres[c]], r.choice([c, c, r.randrange(10)])))
    return rows


@pytest.mark.parametrize("segment", [16, 2048])
def test_against_brute_force(spark, segment):
    rows = make(1)
    hot = [f32(0.5)] * 6
    rows += [(1000 + i, hot, 3) for i in range(300)] + [(1400 + i, hot, 4) for i in range(20)]
    rows += [(2000, None, 1), (2050, [None] * 6, 1), (2100, [float("nan")] * 6, 2), (2150, [float("inf")] + [0.0] * 5, 2), (2200, hot, None), (None, hot, 3)]
    rows += [(2250, [0.0] * 6, 5), (2251, [f32(0.9), f32(0.1)], 5), (2300, [], 6), (2350, [f32(-1.5)] * 6, 77), rows[50], rows[50], rows[7], (2400, [f32(40.0)] + [0.0] * 5, 0)]
    random.Random(2).shuffle(rows)
    got = told(H.mine_embeddings(frame(spark, rows), pivots=8, segment=segment))
    want = brute(rows)
    assert len(want) > 150 and got == want


def test_intervals_leave_segments_out(spark, monkeypatch):
    """In clustered vectors an anchor is certified without most segments, with the same result."""
    rows = make(4, n=2500, dim=3, spread=0.05)
    asked = []
    scan = H.Index._scan
    monkeypatch.setattr(H.Index, "_scan", lambda self, a, k, same: (asked.append((a.count(), self.segments.count(), self.anchors.count())), scan(self, a, k, same))[1])
    assert told(H.mine_embeddings(frame(spark, rows), pivots=8, segment=32)) == brute(rows)
    positives = asked[: next(i for i, x in enumerate(asked) if i and x[0] == x[2])]  # up to the second search's own segments
    assert sum(x[0] for x in positives) < 0.5 * asked[0][1] * asked[0][2]


def test_scores_beyond_doubles_are_exact(spark):
    big = float(1 << 22)
    rows = [(50, [big, 1.0], 1), (1, [big, 2.0], 1), (2, [big - 0.5, 3.0], 1), (3, [0.9 * big, 1.0], 2), (4, [0.8 * big, 5.0], 2)]
    rows = [(i, [f32(x) for x in e], y) for i, e, y in rows]
    assert told(H.mine_embeddings(frame(spark, rows))) == brute(rows) != []


def test_empty_tables(spark):
    assert told(H.mine_embeddings(frame(spark, []))) == []
    assert told(H.mine_embeddings(frame(spark, [(None, None, None), (50, [0.1], 1)]))) == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_query_against_sql(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = c.sql(H.ORACLES["op13_hard_negatives"]).df()
    got = H.op13_hard_negatives(spark, SF).toPandas()[want.columns]
    keys = list(want.columns)
    assert got.sort_values(keys).values.tolist() == want.sort_values(keys).values.tolist() and len(want)
    assert str(got["rank"].dtype) == "int32"
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert told(spark.createDataFrame(got).withColumn("rank", F.col("rank").cast("int"))) == brute(rows)
