"""Operator 13: hard negatives by one-dimensional distance keys.

Vectors are integers. A vector x gets one more component sqrt(M2 - |x|^2), with M2 the largest squared length, and a query q
gets 0: then |q' - x'|^2 = |q|^2 + M2 - 2 q.x, so the largest inner product is the smallest distance. Every vector is stored
under the key (pivot, distance): its nearest of PIVOTS points and the distance to it, in key order, cut into segments of
SEGMENT vectors with their lowest and highest distance. By the triangle inequality a vector within distance C of q', but not
within A, has a key t with |d(q', pivot) - t| <= C and d(q', pivot) + t >= A. Positives are the best of the anchor's label;
the bands of scores that negatives may have are annuli A .. C around the anchor.

A search scans the anchor's own segment, then key intervals that grow: to three quarters of the way, then to the whole of what the
k-th best found so far leaves open (without k finds, twice as far each time). An anchor is certified when nothing beyond what
was scanned can come before its k-th best; only the others go on. Scans are matrix products of a segment and the anchors that
ask for it. They are exact: in floating point while every inner product is below 2^53, else in 64-bit integers.

Scale: equal vectors of one label are one class that keeps as many of its lowest ids as a list of results can hold, so a
vector in a third of all rows is one row of the index; the lists are those of all rows. Nothing is collected but a sample
for the pivots (SAMPLE vectors by a hash of their place), one row of statistics, and the number of open anchors in each round. Anchors
travel to segments (not segments to anchors) and a task holds one segment and CHUNK anchors. Where distances hardly differ, as between
random vectors in many dimensions, the intervals prune little, and the scan is anchors x all vectors in blocks.

Defined results: vectors that are null or hold null or non-finite components, rows without label or id take no part; shorter
vectors are as if filled up with zeros; repeated ids are rows of their own, none of them its own positive; equal scores fall to
the smaller id; a label with no other row has no positives; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import Stash, table

PIVOTS, SAMPLE, SEGMENT, CHUNK, BINS, SALTS = 32, 4096, 2048, 256, 64, 64
_FOUND = "cid bigint, j int, score bigint, id bigint, cc bigint"


def usable(df: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, label, v array<bigint>) of the rows that take part: floor(scale * component)."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    own = df.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()).where(~bad)
    return own.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.transform(vector, lambda x: F.floor(scale * x.cast("double"))).alias("v"))


def _classes(rows: DataFrame, keep: int) -> DataFrame:
    """(h, label, v, ids) of each different vector of a label: its `keep` lowest ids, found in parts of a class first."""
    w = Window.partitionBy("h", "label", "v", "salt").orderBy("id")
    some = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep)
    w = Window.partitionBy("h", "label", "v").orderBy("id")
    some = some.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep)
    return some.groupBy("h", "label", "v").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def _fit(points: np.ndarray, n: int, rounds: int = 8, seed: int = 13) -> np.ndarray:
    """n pivots of the sampled points by k-means."""
    if len(points) <= n:
        return points
    at = points[np.random.default_rng(seed).choice(len(points), n, replace=False)]
    for _ in range(rounds):
        near = _distances(points, at).argmin(axis=1)
        at = np.stack([points[near == k].mean(axis=0) if (near == k).any() else at[k] for k in range(n)])
    return at


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2 * (x @ y.T)
    return np.sqrt(np.maximum(d, 0))


class Index:
    """Segments in key order and the anchors' classes, both written."""

    def __init__(self, stash: Stash, rows: DataFrame, anchor: Column, keep: int, pivots: int = PIVOTS, sample: int = SAMPLE, segment: int = SEGMENT):
        self.stash, spark = stash, rows.sparkSession
        self.rows = rows.withColumn("h", F.xxhash64("label", "v")).withColumn("salt", F.pmod(F.xxhash64(F.lit(13), "id"), F.lit(SALTS)))
        asked = self.rows.where(anchor).select("h", "label", "v").distinct().select("h", "label", "v", F.lit(True).alias("asks"))
        same = ["h", "label", "v"]
        self.classes = stash.keep(_classes(self.rows, keep).join(asked, same, "left").withColumn("asks", F.coalesce("asks", F.lit(False))), "cid")
        square = F.aggregate(F.transform("v", lambda x: x.cast("double") * x), F.lit(0.0), lambda a, x: a + x)
        told = self.classes.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.max(square).alias("m2"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))).alias("top")).first()
        self.n, self.dim, self.m2, self.exact = told["n"], told["dim"] or 0, float(told["m2"] or 0), float(told["m2"] or 0) < 2.0**53
        self.reach = 2 * self.m2**0.5 + 1
        self.slack = 1e-6 * self.reach
        if not self.n:
            return
        width = next((w for w in (2, 4, 8) if (told["top"] or 0) < 1 << 8 * w - 1), 8)
        points = self.classes.select("v").orderBy(F.xxhash64(F.lit(7), "cid")).limit(sample).collect()
        self.code = f"<i{width}"
        at = _fit(self._augmented(self._stacked([p["v"] for p in points])), pivots)
        self.pivots = len(at)
        self.segments = stash.keep(self._segments(at, segment), "seg")
        anchors = self.segments.select("seg", F.explode("asking").alias("a")).select("seg", "a.*")
        self.anchors = stash.keep(anchors.withColumnRenamed("seg", "home"))

    def _stacked(self, vectors: list) -> np.ndarray:
        out = np.zeros((len(vectors), self.dim))
        for k, v in enumerate(vectors):
            out[k, : len(v)] = v
        return out

    def _augmented(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(self.m2 - (x * x).sum(axis=1), 0))[:, None]])

    def _segments(self, at: np.ndarray, most: int) -> DataFrame:
        """Classes by (pivot, distance), most of them a row: arrays as bytes, and the classes among them that ask."""
        dim, code, m2 = self.dim, self.code, self.m2

        def pad(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
            if (sizes == dim).all():
                return flat.reshape(-1, dim)
            out = np.zeros((len(sizes), dim), dtype=np.int64)
            out[np.arange(dim)[None] < sizes[:, None]] = flat
            return out

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                v = b.column("v")
                x = pad(v.flatten().to_numpy(zero_copy_only=False), np.diff(v.offsets.to_numpy()))
                f = x.astype(np.float64)
                f = np.hstack([f, np.sqrt(np.maximum(m2 - (f * f).sum(axis=1), 0))[:, None]])
                d = _distances(f, at)
                f[:, -1] = 0  # as a query
                near, whole, narrow = d.argmin(axis=1), _distances(f, at), x.astype(code)
                yield pa.RecordBatch.from_arrays(
                    [b.column("cid"), b.column("label"), pa.array([r.tobytes() for r in narrow], type=pa.binary()), b.column("ids"), b.column("asks"), pa.array(near, type=pa.int32()), pa.array(d[np.arange(len(near)), near]), pa.array((f * f).sum(axis=1)), pa.array(list(whole), type=pa.list_(pa.float64()))],
                    names=["cid", "label", "v", "ids", "asks", "pivot", "d", "norm2", "dq"],
                )

        kind = "cid bigint, label bigint, v binary, ids array<bigint>, asks boolean, pivot int, d double, norm2 double, dq array<double>"
        by_key = self.classes.select("cid", "label", "v", "ids", "asks").mapInArrow(keyed, kind)
        by_key = by_key.withColumn("dq", F.when(F.col("asks"), F.col("dq")))
        n = int(by_key.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        by_key = by_key.repartitionByRange(n, "pivot", "d", "cid").sortWithinPartitions("pivot", "d", "cid")

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[dict] = []

            def segment() -> pa.RecordBatch:
                one = lambda k, kind: np.array([r[k] for r in held], dtype=kind).tobytes()
                asking = [{k: r[k] for k in ("cid", "label", "v", "norm2", "dq")} for r in held if r["asks"]]
                ids = [i for r in held for i in r["ids"]]
                values = [held[0]["pivot"], held[0]["d"], held[-1]["d"], one("cid", "<i8"), one("label", "<i8"), np.array([len(r["ids"]) for r in held], dtype="<i4").tobytes(), np.array(ids, dtype="<i8").tobytes(), b"".join(r["v"] for r in held), asking]
                return pa.RecordBatch.from_pylist([dict(zip(segment_type.names, values, strict=True))], schema=segment_type)

            for b in batches:
                for r in b.to_pylist():
                    if held and (len(held) == most or held[0]["pivot"] != r["pivot"]):
                        yield segment()
                        held.clear()
                    held.append(r)
            if held:
                yield segment()

        asking = pa.struct([("cid", pa.int64()), ("label", pa.int64()), ("v", pa.binary()), ("norm2", pa.float64()), ("dq", pa.list_(pa.float64()))])
        segment_type = pa.schema([("pivot", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("cids", pa.binary()), ("labels", pa.binary()), ("many", pa.binary()), ("ids", pa.binary()), ("vs", pa.binary()), ("asking", pa.list_(asking))])
        return by_key.mapInArrow(cut, "pivot int, low double, high double, cids binary, labels binary, many binary, ids binary, vs binary, asking array<struct<cid:bigint,label:bigint,v:binary,norm2:double,dq:array<double>>>")

    def search(self, anchors: DataFrame, k: int, same: bool) -> DataFrame:
        """(cid, j, score, id, cc) of the k best rows for each anchor and target j.

        anchors: (cid, label, v, norm2, dq, home, low, high); low and high are arrays of the lowest and highest score of each
        target, null where open. `same`: rows of the anchor's label, or of all others. cc is the class of the row found.
        """
        stash = self.stash
        width = F.lit(self.reach / BINS)
        inner = F.array_min(F.transform("high", lambda s: F.sqrt(F.greatest(F.lit(0.0), F.col("norm2") + self.m2 - 2 * s)))) - self.slack
        fixed = stash.keep(anchors.withColumn("inner", F.when(F.exists("high", lambda s: s.isNull()), 0.0).otherwise(F.greatest(F.lit(0.0), inner))))
        state = fixed.select("cid", F.lit(None).cast("double").alias("done"), F.col("low").alias("need"))
        pairs, best, turn = fixed.select("cid", F.col("home").alias("seg")), None, 0
        meta = self.segments.select("seg", "pivot", F.col("low").alias("t0"), F.col("high").alias("t1"))
        meta = stash.keep(meta)
        while True:
            asked = fixed.join(state.select("cid", "need"), "cid").select("cid", "label", "v", "high", "need")
            found = self._scan(asked.join(pairs, "cid"), k, same)
            best = stash.keep(self._best(found if best is None else found.unionByName(best), k))
            kth = best.groupBy("cid", "j").agg(F.count("*").alias("n"), F.min("score").alias("s")).where(F.col("n") == k)
            kth = kth.groupBy("cid").agg(F.map_from_entries(F.collect_list(F.struct("j", "s"))).alias("kth"))
            s = fixed.join(state.select("cid", "done"), "cid").join(kth, "cid", "left")
            need = F.transform("low", lambda low, j: F.greatest(low, F.try_element_at("kth", j.cast("int"))))
            s = s.withColumn("need", need)
            outer = F.sqrt(F.greatest(F.lit(0.0), F.col("norm2") + self.m2 - 2 * F.array_min("need"))) + self.slack
            s = s.withColumn("outer", F.when(F.exists("need", lambda x: x.isNull()), F.lit(self.reach)).otherwise(F.least(outer, F.lit(self.reach))))
            s = s.where(F.col("done").isNull() | (F.col("done") < F.col("outer")))
            start = F.greatest("inner", F.coalesce("done", F.lit(0.0)))
            known = ~F.exists("need", lambda x: x.isNull())
            far = F.when(known & F.lit(turn >= 1), F.col("outer")).when(known, start + (F.col("outer") - start) * 0.75).otherwise(F.least(F.col("outer"), F.greatest(2 * start, F.lit(self.reach / 4))))
            s = stash.keep(s.withColumn("far", far))
            if s.isEmpty():
                return best
            p = s.select("cid", "home", "inner", "done", "far", F.posexplode("dq").alias("pivot", "q")).withColumn("a_salt", F.pmod(F.xxhash64("cid"), F.lit(8)))
            first = F.greatest(F.lit(0.0), F.col("q") - F.col("far"), F.col("inner") - F.col("q"))
            last = F.least(F.lit(self.reach), F.col("q") + F.col("far"))
            p = p.withColumn("first", first).withColumn("last", last).withColumn("bin", F.explode(F.sequence(F.floor(F.col("first") / width), F.greatest(F.floor(F.col("first") / width), F.floor(F.col("last") / width)))))
            m = meta.withColumn("m_bin", F.explode(F.sequence(F.floor(F.col("t0") / width), F.floor(F.col("t1") / width)))).withColumn("m_salt", F.explode(F.sequence(F.lit(0), F.lit(7))))
            m = m.withColumnRenamed("pivot", "m_pivot")
            on = (F.col("pivot") == F.col("m_pivot")) & (F.col("bin") == F.col("m_bin")) & (F.col("a_salt") == F.col("m_salt"))
            hit = (F.col("t0") <= F.col("last")) & (F.col("t1") >= F.col("first"))
            once = F.col("bin") == F.greatest(F.floor(F.col("t0") / width), F.floor(F.col("first") / width))
            before = (F.col("t0") <= F.col("q") + F.col("done")) & (F.col("t1") >= F.greatest(F.col("q") - F.col("done"), F.col("inner") - F.col("q")))
            pairs = p.join(m, on).where(hit & once & (F.col("seg") != F.col("home")) & (F.col("done").isNull() | ~before)).select("cid", "seg")
            state = s.select("cid", F.col("far").alias("done"), "need")
            turn += 1

    def _best(self, found: DataFrame, k: int) -> DataFrame:
        w = Window.partitionBy("cid", "j").orderBy(F.col("score").desc(), "id", "cc")
        return found.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")

    def _scan(self, asked: DataFrame, k: int, same: bool) -> DataFrame:
        """asked(cid, label, v, high, need, seg): each anchor's best rows of the segment."""
        dim, code, exact = self.dim, self.code, self.exact
        payload = ["cids", "labels", "many", "ids", "vs"]
        wanted = self.segments.join(asked.select("seg").distinct(), "seg", "left_semi")
        left = wanted.select("seg", F.lit(0).alias("kind"), *payload, *(F.lit(None).cast(t).alias(c) for c, t in (("cid", "bigint"), ("label", "bigint"), ("v", "binary"), ("high", "array<bigint>"), ("need", "array<bigint>"))))
        right = asked.select("seg", F.lit(1).alias("kind"), *(F.lit(None).cast("binary").alias(c) for c in payload), "cid", "label", "v", "high", "need")
        n = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        both = left.unionByName(right).repartition(n, "seg").sortWithinPartitions("seg", "kind")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kind = np.float64 if exact else np.int64
            seg, waiting = None, []
            for b in batches:
                for r in b.to_pylist():
                    if r["kind"] == 0:
                        if waiting:
                            yield _compare(seg, waiting, k, same, kind, code, dim)
                            waiting = []
                        seg = _opened(r, kind, code, dim)
                    else:
                        waiting.append(r)
                        if len(waiting) == CHUNK:
                            yield _compare(seg, waiting, k, same, kind, code, dim)
                            waiting = []
            if waiting:
                yield _compare(seg, waiting, k, same, kind, code, dim)

        return both.mapInArrow(run, _FOUND)


def _opened(r: dict, kind, code: str, dim: int) -> dict:
    many = np.frombuffer(r["many"], dtype="<i4")
    ids = np.frombuffer(r["ids"], dtype="<i8")
    begin = np.cumsum(many) - many
    return {"cids": np.frombuffer(r["cids"], dtype="<i8"), "labels": np.frombuffer(r["labels"], dtype="<i8"), "many": many, "ids": ids, "begin": begin, "least": ids[begin], "x": np.frombuffer(r["vs"], dtype=code).reshape(-1, dim).astype(kind) if dim else np.zeros((len(many), 0), kind)}


def _compare(seg: dict, anchors: list[dict], k: int, same: bool, kind, code: str, dim: int) -> pa.RecordBatch:
    """The k best rows of a segment for each anchor and target, none below what the target needs."""
    q = np.stack([np.frombuffer(a["v"], dtype=code) for a in anchors]).astype(kind)
    score = (q @ seg["x"].T).astype(np.int64)
    of_label = np.array([a["label"] for a in anchors])[:, None] == seg["labels"][None]
    fits = of_label if same else ~of_label
    least = np.array([min(-(1 << 62) if x is None else x for x in a["need"]) for a in anchors])
    most = np.array([max((1 << 62) if x is None else x for x in a["high"]) for a in anchors])
    fits &= (score >= least[:, None]) & (score <= most[:, None])
    out: tuple[list, ...] = ([], [], [], [], [])
    for i in np.flatnonzero(fits.any(axis=1)):
        some = np.flatnonzero(fits[i])
        own = score[i, some]
        for j, (need, high) in enumerate(zip(anchors[i]["need"], anchors[i]["high"], strict=True)):
            held = np.ones(len(own), bool) if need is None else own >= need
            if high is not None:
                held &= own <= high
            s, c = own[held], some[held]
            if len(s) > k:
                edge = np.partition(s, len(s) - k)[len(s) - k]
                s, c = s[s >= edge], c[s >= edge]
            order = np.lexsort((seg["least"][c], -s))[:k]
            rows = []
            for p in order:
                begin = seg["begin"][c[p]]
                rows += [(-int(s[p]), x, int(seg["cids"][c[p]])) for x in seg["ids"][begin : begin + min(k, seg["many"][c[p]])].tolist()]
            for minus, row, cc in sorted(rows)[:k]:
                for column, value in zip(out, (anchors[i]["cid"], j, -minus, row, cc), strict=True):
                    column.append(value)
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(out, kinds, strict=True)], names=["cid", "j", "score", "id", "cc"])


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, **settings) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows(id, label, v array<bigint>).

    anchor: a condition on id. Each anchor's positives are its best other rows of its label; for each, the best rows of other labels with
    low * positive_score <= 100 * score <= high * positive_score.
    """
    spark = rows.sparkSession
    stash = Stash(spark, batch=4 << 20)
    k = positives + 1  # an anchor may find itself
    index = Index(stash, rows, anchor, max(k, negatives), **settings)
    none = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not index.n:
        return spark.createDataFrame([], none)
    open_ = F.array(F.lit(None).cast("bigint"))
    near = index.search(index.anchors.select("*", open_.alias("low"), open_.alias("high")), k, True)
    in_order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", "cc")))
    pos = stash.keep(near.groupBy("cid").agg(in_order.alias("pos")))
    lowest = lambda s: F.ceil(s.cast("decimal(20,0)") * low / 100).cast("long")
    highest = lambda s: F.floor(s.cast("decimal(20,0)") * high / 100).cast("long")
    scores = F.filter(F.array_distinct(F.transform("pos", lambda p: -p["s"])), lambda s: lowest(s) <= highest(s))
    bands = pos.select("cid", scores.alias("ps")).where(F.size("ps") > 0)
    asks = index.anchors.join(bands, "cid").select(*index.anchors.columns, F.transform("ps", lowest).alias("low"), F.transform("ps", highest).alias("high"))
    far = index.search(asks, negatives, False)
    by_band = far.groupBy("cid", "j").agg(in_order.alias("neg")).groupBy("cid").agg(F.map_from_entries(F.collect_list(F.struct("j", "neg"))).alias("negs"))
    told = pos.join(bands, "cid").join(by_band, "cid")
    same = ["h", "label", "v"]
    told = told.join(index.classes.where("asks").select("cid", *same), "cid")
    told = told.select(*(F.col(c).alias(f"t_{c}") for c in same), "cid", "pos", "ps", "negs", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("t_salt"))
    on = F.col("salt") == F.col("t_salt")
    for c in same:
        on = on & (F.col(c) == F.col(f"t_{c}"))
    own = index.rows.where(anchor).join(told, on)
    me = F.array_position(F.transform("pos", lambda p: (p["id"] == F.col("id")) & (p["cc"] == F.col("cid"))), F.lit(True))
    others = F.when(me == 0, F.col("pos")).otherwise(F.filter("pos", lambda p, i: i != me - 1))
    own = own.select(F.col("id").alias("anchor_id"), "ps", "negs", F.explode(F.slice(others, 1, positives)).alias("p"))
    own = own.withColumn("positive_score", -F.col("p.s"))
    band = (F.array_position("ps", F.col("positive_score")) - 1).cast("int")
    own = own.select("anchor_id", F.col("p.id").alias("positive_id"), "positive_score", F.posexplode(F.try_element_at("negs", band)).alias("at", "n"))
    return own.select("anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("n.id").alias("negative_id"), "positive_score", (-F.col("n.s")).alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_embeddings(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def mine_embeddings(df: DataFrame, **settings) -> DataFrame:
    """The contract's labels, anchors and bands on (vec_id, embedding, label)."""
    rows = usable(df).withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(rows, F.col("id") % 50 == 0, **settings)


QUERIES = {"op13_hard_negatives": op13_hard_negatives}
#: All anchors by all rows, so for small tables.
ORACLES = {
    "op13_hard_negatives": """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, e.vec_id, a.label = e.label AS same, CAST(list_inner_product(a.v, e.v) AS BIGINT) AS score FROM e a JOIN e ON a.vec_id % 50 = 0 AND a.vec_id <> e.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3"""
}
