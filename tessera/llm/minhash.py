"""Operator 2: near-duplicates by bottom-k sketches of one hash function.

A document's set is its distinct five-word shingles. Equal sets become one class at once, so copies never meet. Each
class keeps the K smallest shingle hashes. Inverted lists of retained values give candidate pairs; the sketch of the
union estimates their similarity and drops hopeless ones; the rest is verified on full sets.

Which values are indexed: linked sets share at least NEED of K retained values (a link at 0.85 falls short of that with a
probability under 1e-9; for sets of up to K shingles it is certain), so sharing must show among the K - NEED + 1 rarest
values of either side. Values of passages that thousands of documents share are therefore left out without loss wherever
a document has enough of its own.

Long lists (over SHORT members) mostly hold documents that share a passage, or many near copies of one text, few of them
linked. Their members are indexed anew, by the rarest 15 % of their full sets, which a link at 0.85 must show in on both
sides (prefix filter, exact). Numbers of sets are asked for by chunks of members that share a list, so near copies ask for
their common values once. The new lists are cut into blocks, and all pairs of two blocks are counted at once by a matrix
product over the shingles that two or more of them have; what leaves a task is one row for each linked member, with the
smallest member of its component there. Nothing is capped, and no pairs are written.

Scale: hashes and sketches are made where the texts are; the widest shuffles carry K values a class. Texts travel once,
for classes with candidates. Counts are combined before shuffles, and joins on hot values can be split by AQE.

Defined results: null, empty and blank texts have the empty set, are linked with nothing and kept; fewer than five words
make one shingle; every row is a document of its own, rows that repeat a doc_id too: each gets the smallest doc_id that its
text reaches; rows without doc_id come after all others, and where a component has nothing else its number is null and its
rows are kept; an empty table gives an empty result. Most steps run while the query is built.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import by_bytes, components, keyed, mix, raw, roots, sorted_groups, spread, Stash, table, unkeyed, word_hashes
from tessera.llm.quality import let

WORDS, K, NEED, SHORT, PERCENT = 5, 32, 12, 32, 85
#: Members and shingles of a block of a long list.
MEMBERS, WEIGHT = 256, 131_072
_PLACE = mix(np.arange(1, 9, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def shingle_sets(texts: list[bytes], k: int = WORDS) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its k-word shingles; fewer words make one shingle."""
    w, n = word_hashes(texts)
    rolled = np.zeros(max(0, len(w) - k + 1), dtype=np.uint64)
    for j in range(k):
        rolled += w[j : j + len(rolled)] * _PLACE[j]
    rolled = mix(rolled)
    out, at = [], 0
    for m in n.tolist():
        if m >= k:
            out.append(np.unique(rolled[at : at + m - k + 1]))
        elif m:
            short = (w[at : at + m] * _PLACE[:m]).sum(dtype=np.uint64, keepdims=True)
            out.append(mix(short + np.array([m], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        else:
            out.append(np.empty(0, dtype=np.uint64))
        at += m
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part in by_bytes(b, [1]):
            sets = shingle_sets(raw(part.column(1)))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(2),
                    part.column(3),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([s[:K].view(np.int64) for s in sets], pa.list_(pa.int64())),
                ],
                names=["doc_id", "t1", "t2", "n", "same", "sketch"],
            )


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in by_bytes(batch, [2, 3])):
            a, c = shingle_sets(raw(b.column(2))), shingle_sets(raw(b.column(3)))
            both = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(a, c, strict=True)]
            ok = [100 * i >= percent * (len(x) + len(y) - i) for i, x, y in zip(both, a, c, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (part for batch in batches for part in by_bytes(batch, [2])):
        sets = shingle_sets(raw(b.column(2)))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(map(len, sets), pa.int32()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["chunk", "cid", "n", "shingles"])


def _chunk_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (chunk, shingles) sorted by chunk: the different values of each chunk and in how many of its sets they are."""
    for rows, cuts in sorted_groups(batches, 0):
        chunk, sets = rows.column(0).to_numpy(), rows.column(1)
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            values, count = np.unique(np.frombuffer(b"".join(sets.slice(i, j - i).to_pylist()), dtype=np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), chunk[i])), pa.array(values), pa.array(count, pa.int64())], names=["chunk", "value", "sets"])


def _rarest(percent: int):
    """Of a chunk's sets (cid, n, shingles) and its values that two or more sets have (value, df): the values of each set
    that must show a link, rarest first; values that no other set has take up places."""

    def run(sets: pa.Table, told: pa.Table) -> pa.Table:
        flat = told.column("values").combine_chunks().flatten() if told.num_rows else None
        value, df = (flat.field(k).to_numpy() for k in (0, 1)) if flat is not None else (np.empty(0, dtype=np.int64),) * 2
        o = np.argsort(value)
        value, df = value[o], df[o]
        cids, ns, out = [], [], []
        for cid, n, own in zip(sets.column("cid").to_pylist(), sets.column("n").to_pylist(), sets.column("shingles").to_pylist(), strict=True):
            own = np.intersect1d(np.frombuffer(own, dtype=np.int64), value)
            room = n + (-percent * n // 100) + 1 - (n - len(own))
            if room > 0:
                chosen = own[np.lexsort((own, df[np.searchsorted(value, own)]))[:room]]
                out.append(chosen)
                cids += [cid] * len(chosen)
                ns += [n] * len(chosen)
        return pa.table({"cid": pa.array(cids, pa.int64()), "n": pa.array(ns, pa.int32()), "value": pa.array(np.concatenate(out) if out else [], pa.int64())})

    return run


def common_counts(sets: list[np.ndarray], sparse: int = 8, width: int = 8192) -> np.ndarray:
    """(sets, sets) numbers of common values. Values that many sets have are counted by matrix products over `width` of
    them at a time, values that up to `sparse` sets have pair by pair."""
    m = len(sets)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    flat = np.concatenate(sets)
    o = np.argsort(flat, kind="stable")
    row, flat = row[o], flat[o]
    cut = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1]))) if len(flat) else np.empty(0, dtype=np.int64)
    n = np.diff(np.append(cut, len(flat)))
    out = np.zeros(m * m, dtype=np.int64)
    for k in range(2, sparse + 1):
        at = row[cut[n == k][:, None] + np.arange(k)]
        i, j = np.triu_indices(k, 1)
        out += np.bincount((at[:, i] * m + at[:, j]).ravel(), minlength=m * m)
    out = out.reshape(m, m)
    out = out + out.T
    dense = np.flatnonzero(n > sparse)
    for at in range(0, len(dense), width):
        which = dense[at : at + width]
        x = np.zeros((m, len(which)), dtype=np.float32)
        size = n[which]
        x[row[np.repeat(cut[which] - np.cumsum(size) + size, size) + np.arange(size.sum())], np.repeat(np.arange(len(which)), size)] = 1
        out += (x @ x.T).astype(np.int64)
    return out


def _count_blocks(percent: int):
    """Over rows (key, same, side, rep, shingles) sorted by key: links of members to the smallest of their component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cuts in sorted_groups(batches, 0):
            same, side, ids = rows.column(1).to_numpy(zero_copy_only=False), rows.column(2).to_numpy(), rows.column(3).to_numpy()
            nodes, tops = [], []
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if j - i < 2 or not (same[i] or side[i:j].min() != side[i:j].max()):
                    continue
                sets = [np.frombuffer(x, dtype=np.uint64) for x in rows.column(4).slice(i, j - i).to_pylist()]
                n = np.array([len(s) for s in sets])
                both = common_counts(sets)
                near = np.triu(100 * both >= percent * (n[:, None] + n[None, :] - both), 1)
                if not same[i]:
                    near &= side[i:j, None] != side[None, i:j]
                a, b = np.nonzero(near)
                if len(a):
                    own = ids[i:j]
                    top = roots(len(own), a, b, own)
                    on = top != own
                    nodes.append(own[on])
                    tops.append(top[on])
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tops)), pa.array(np.concatenate(nodes))], names=["a", "b"])

    return run


def _hopeful(a: str, b: str, percent: int) -> Column:
    """Whether two classes (structs of n and sketch, its values ascending by unsigned hash) may be linked.

    Sizes alone bound the similarity; then the K smallest values of the union are a sample of it, and the part of them
    that both have is the estimate. Sketches that hold whole sets decide exactly.
    """
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    sizes = 100 * F.least(na, nb) >= percent * F.greatest(na, nb)
    # signed order would cut the union elsewhere than the sketches: flip the sign bit for the sort
    union = F.slice(F.sort_array(F.transform(F.array_union(f"{a}.sketch", f"{b}.sketch"), lambda x: x.bitwiseXOR(F.lit(-(1 << 63))))), 1, K)
    whole = (na <= K) & (nb <= K)
    shared = F.array_intersect(f"{a}.sketch", f"{b}.sketch")

    def judge(u: Column) -> Column:
        top = F.get(u, F.size(u) - 1)
        common = F.size(F.filter(shared, lambda x: x.bitwiseXOR(F.lit(-(1 << 63))) <= top))
        return F.when(whole, 100 * F.size(shared) >= percent * (na + nb - F.size(shared))).otherwise(K * common >= NEED * F.size(u))

    return sizes & let(union, judge)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document. Links: 100 * intersection >= percent * union."""
    spark = docs.sparkSession
    stash = Stash(spark)
    # a doc_id may have several texts: t1 and t2, hashes of the text, tell which
    source = docs.select(keyed(key).alias("doc_id"), F.col(text).alias("text"))
    source = source.select("doc_id", "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))
    sketches = stash.keep(source.mapInArrow(_sketch, "doc_id bigint, t1 bigint, t2 bigint, n bigint, same binary, sketch array<bigint>"))
    classes = sketches.where("n > 0").groupBy("same").agg(F.min(F.struct("doc_id", "t1", "t2")).alias("first"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = stash.keep(classes, "cid")

    # inverted lists of the rarest values that must show a link
    values = classes.select("cid", "n", F.explode("sketch").alias("value"))
    shared = values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    held = values.join(shared, "value").groupBy("cid").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "value"))).alias("vs"))
    # values of df 1 are the rarest of all and take up places of the prefix
    need = F.least(F.lit(NEED), F.ceil(F.col("n") * percent / 100)).cast("int")
    room = F.least(F.col("n"), F.lit(K)).cast("int") - need + 1
    alone = F.least(F.col("n"), F.lit(K)).cast("int") - F.size("vs")
    lists = stash.keep(held.where(room > alone).select("cid", F.explode(F.slice("vs", 1, room - alone)).alias("v")).select("cid", "v.value"))
    sizes = lists.groupBy("value").agg(F.countDistinct("cid").alias("members")).where("members > 1")
    members = lists.join(sizes, "value").distinct()
    with_sketch = stash.keep(members.join(classes.select("cid", F.struct("n", "sketch").alias("c")), "cid"))
    stash.drop(lists)
    wanted = classes.join(with_sketch.select("cid").distinct(), "cid", "left_semi").select("cid", "first.*")
    texts = stash.keep(source.join(wanted, ["doc_id", "t1", "t2"]).select("cid", "text").dropDuplicates(["cid"]))

    def side(df: DataFrame, x: str) -> DataFrame:
        return df.select("value", F.col("cid").alias(x), F.col("c").alias(f"c{x}"))

    def verified(pairs: DataFrame) -> DataFrame:
        """Of pairs(a, b, ca, cb) those linked: estimated, made distinct, then compared on full sets."""
        hopeful = pairs.where(_hopeful("ca", "cb", percent)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        t = texts.select(F.col("cid").alias("a"), F.col("text").alias("ta"))
        u = texts.select(F.col("cid").alias("b"), F.col("text").alias("tb"))
        return stash.keep(hopeful.join(t, "a").join(u, "b").select("a", "b", "ta", "tb").mapInArrow(_verify(percent), "a bigint, b bigint"))

    short = with_sketch.where(F.col("members") <= SHORT)
    links = verified(side(short, "a").join(side(short, "b"), "value").where("a < b"))

    # members of long lists, in chunks of alike ones: a chunk asks once for each of its values
    long = with_sketch.where(F.col("members") > SHORT).groupBy("cid").agg(F.min("value").alias("lead"), F.first("c.n").alias("n"))
    pieces = long.groupBy("lead").agg(F.ceil(F.sum("n") / WEIGHT).cast("int").alias("pieces"))
    long = long.join(pieces, "lead").select("cid", F.xxhash64("lead", F.pmod(F.xxhash64("cid"), F.col("pieces"))).alias("chunk"))
    full = texts.join(long, "cid").select("chunk", "cid", "text").mapInArrow(_full, "chunk bigint, cid bigint, n int, shingles binary")
    full = stash.keep(full)
    asked = full.select("chunk", "shingles").repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_chunk_values, "chunk bigint, value bigint, sets bigint")
    asked = stash.keep(asked)
    many = asked.groupBy("value").agg(F.sum("sets").alias("df")).where("df > 1")
    told = asked.join(many, "value").groupBy("chunk").agg(F.collect_list(F.struct("value", "df")).alias("values"))
    exact = stash.keep(full.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_rarest(percent), "cid bigint, n int, value bigint"))
    sized = exact.groupBy("value").agg(F.count("*").alias("members"), F.sum("n").alias("weight")).where("members > 1")
    parts = F.greatest(F.ceil(F.col("members") / MEMBERS), F.ceil(F.col("weight") / WEIGHT)).cast("int")
    placed = exact.join(sized, "value").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low, high = F.least("part", "other"), F.greatest("part", "other")
    blocks = placed.select(F.xxhash64("value", low, high).alias("key"), (low == high).alias("same_part"), "part", "cid").join(full.select("cid", "shingles"), "cid")
    blocks = blocks.select("key", "same_part", "part", "cid", "shingles").repartition("key").sortWithinPartitions("key", "cid")
    links = links.unionByName(blocks.mapInArrow(_count_blocks(percent), "a bigint, b bigint"))

    comp = components(stash, links)
    numbered = comp.join(classes.select(F.col("cid").alias("node"), F.col("first.doc_id").alias("doc_id")), "node")
    least = numbered.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    told = comp.join(least, "component").select(F.col("node").alias("cid"), "component_id")
    told = classes.select("cid", "same", F.col("first.doc_id").alias("doc_id")).join(told, "cid", "left").select("same", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = sketches.select("doc_id", F.col("n").alias("n_shingles"), "same").join(told, "same", "left")
    own = F.coalesce("component_id", "doc_id")
    out = out.select("doc_id", "n_shingles", own.alias("component_id"), (F.col("doc_id") == own).alias("kept"))
    return out.select(unkeyed("doc_id").alias("doc_id"), "n_shingles", unkeyed("component_id").alias("component_id"), "kept")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one with the smallest doc_id."""
    out = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("_keep")).distinct()
    return docs.join(out, F.col("doc_id").eqNullSafe(F.col("_keep")), "left_semi")


QUERIES = {"op2_minhash": op2_minhash}
#: All pairs that share a shingle, for small tables.
ORACLES = {
    "op2_minhash": r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON r.doc_id = l.a)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c) AS component_id, r.doc_id = min(c) AS kept FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id"""
}
