"""Operator 3: removal of repeated byte strings by a hash-compared suffix sort.

Every byte that lies in a LENGTH-byte string which also starts earlier (smaller doc_id, or the same text) goes. A suffix
array over all bytes of a large corpus is out of reach; sorted are only the places where repeats can be. Each window of
LENGTH bytes has an anchor inside it that depends on its bytes alone (see `suffix.anchors`), so equal windows meet at
equal anchors, and windows share an anchor with their neighbours: about one in 33 bytes is one.

 1. Anchors (hash of the gram, hash of the context) are made where the texts are. Equal ones of one batch are combined
    there; only the first goes on, the others are repeats already.
 2. Buckets of contexts: rows of equal contexts after the first are repeats as a whole. A first context is of interest if
    its gram has others; a bucket that sees two of a gram knows it at once, of the rest one row for each gram goes on to
    buckets of grams. Most grams occur once and end here.
 3. The contexts of interest are cut out of their texts, and sorted: right and reversed left sides by mergesort, with
    comparisons by prefix hashes and binary search, verified byte by byte. The orders tell which windows are equal.
 4. Each text meets its repeated ranges and is cut.

Texts travel twice, everything else is a few bytes for each anchor. Copies and passages shared by many documents are
combined in step 1, once for ANCHORS anchors of a task, so a context in a third of all rows is one entry in each of them. A
gram with more than HOT different contexts isn't one group: its windows are spread by their own 128-bit hashes, and the
first of each is found by an aggregation with map-side combine; that bounds what a task sorts. Equal contexts are told by 128
bits: the gram's hash by one base, the context's by two.

Defined results: null texts are empty; texts under LENGTH bytes lose nothing; strings are judged on the input; every row
gives a row: rows that share a doc_id (or have none, the last of all) are documents one after the other in the order of the
64-bit hashes of their texts, those with the same text one document; an empty table gives an empty result. All steps but the
last run while the query is built.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import by_bytes, byte_codes, keyed, mix, Powers, prefix_hash, raw, spread, Stash, table, union_all, unkeyed
from tessera.llm.suffix import GRAM, LENGTH, anchors, repeated_windows

#: Bytes of a batch that is taken at once (a longer text by itself), anchors that are packed together, bytes of text for each
#: bucket, contexts that are sorted at once (more if one gram has more), contexts of a hot gram, tasks of a stage at the most.
BATCH, ANCHORS, BUCKET, SORTED, HOT, TASKS = 1 << 19, 1 << 17, 8 << 20, 8192, 32_768, 50_000


def _pack(columns: list[np.ndarray]) -> bytes:
    """Integer columns as bytes: planes of equal significance side by side, compressed. Hashes stay as they are."""
    head = struct.pack("<I", len(columns[0]))
    planes = b"".join(np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns)
    return head + zstandard.ZstdCompressor(level=1).compress(planes)


def _unpack(data: bytes, k: int) -> list[np.ndarray]:
    n = struct.unpack_from("<I", data)[0]
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[4:], max_output_size=8 * k * n), dtype=np.uint8).reshape(k, 8, n)
    return [np.ascontiguousarray(flat[i].T).view("<u8").ravel() for i in range(k)]


def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    end = np.cumsum(size)
    return np.frombuffer(b"".join(parts), dtype=np.uint8), end - size, end


def _anchor_batches(buckets: int):
    """(bucket, data): packed columns of the anchors that go on, then of the ranges that are repeats already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for b in (part for batch in batches for part in by_bytes(batch, [1], BATCH)):
            a = anchors(*_joined(raw(b.column(1))))
            if len(a["h"]):
                held.append([a["h"], a["c"], b.column(0).to_numpy()[a["text"]], a["at"], a["at"] - a["lo"], a["hi"] - a["lo"]])
            if sum(len(x[0]) for x in held) >= ANCHORS:
                yield _dealt([np.concatenate(x) for x in zip(*held, strict=True)], buckets)
                held = []
        if held:
            yield _dealt([np.concatenate(x) for x in zip(*held, strict=True)], buckets)

    return run


def _dealt(columns: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """Anchors (h, c, doc, at, back, span) as one packed row for each bucket; of equal contexts the first goes on."""
    bucket = (columns[1] % np.uint64(buckets)).astype(np.int64)
    h, c, d, at, back, span = columns
    o = np.lexsort((at, d, c, h, bucket))
    h, c, d, at, back, span, bucket = h[o], c[o], d[o], at[o], back[o], span[o], bucket[o]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])))
    cuts = np.concatenate((np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))), [len(o)]))
    delta = lambda x: np.diff(x, prepend=0)
    which, data = [], []
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        go, gone = i + np.flatnonzero(new[i:j]), i + np.flatnonzero(~new[i:j])
        go = go[np.lexsort((at[go], d[go]))]  # documents ascend, so their differences are small
        gone = gone[np.lexsort((at[gone], d[gone]))]
        hashes = h[go].tobytes() + c[go].tobytes()
        going = _pack([delta(d[go]), at[go], back[go], span[go]])
        repeats = _pack([delta(d[gone]), (at - back)[gone], span[gone]])
        which.append(int(bucket[i]))
        data.append(struct.pack("<II", len(go), len(going)) + hashes + going + repeats)
    return pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(data, pa.binary())], names=["bucket", "data"])


_RANGES = "doc_id bigint, at int, lo int, hi int, h bigint"
_NAMES = ["doc_id", "at", "lo", "hi", "h"]
_CLASSES = _RANGES + ", bucket int, data binary"


def _ranges(doc, at, lo, hi, h) -> pa.Table:
    return pa.Table.from_arrays([pa.array(doc, pa.int64()), pa.array(at, pa.int32()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(h, pa.int64())], names=_NAMES)


def _repeats(doc, lo, hi) -> pa.Table:
    return _ranges(doc, np.full(len(doc), None), lo, hi, np.zeros(len(doc), dtype=np.int64))


def _classes(buckets: int):
    """Of a bucket of contexts: repeats (at is null), places of interest (with at and gram hash), and packed rows
    (bucket, data) of grams seen once here, with the grams that are known to have several contexts."""

    def run(group: pa.Table) -> pa.Table:
        hs, cs, cols, gone = [], [], [], []
        for x in group.column("data").to_pylist():
            n, m = struct.unpack_from("<II", x)
            hs.append(np.frombuffer(x, "<u8", n, 8))
            cs.append(np.frombuffer(x, "<u8", n, 8 + 8 * n))
            c = _unpack(x[8 + 16 * n : 8 + 16 * n + m], 4)
            cols.append([np.cumsum(c[0].view(np.int64)), *(v.view(np.int64) for v in c[1:])])
            g = _unpack(x[8 + 16 * n + m :], 3)
            gone.append([np.cumsum(g[0].view(np.int64)), *(v.view(np.int64) for v in g[1:])])
        h, c = np.concatenate(hs), np.concatenate(cs)
        doc, at, back, span = (np.concatenate([x[k] for x in cols]) for k in range(4))
        o = np.lexsort((at, doc, c, h))
        h, c, doc, at, lo, hi = h[o], c[o], doc[o], at[o], (at - back)[o], (at - back + span)[o]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])))[: len(h)]
        d2, l2, s2 = (np.concatenate([x[k] for x in gone]) for k in range(3))
        repeats = _repeats(np.concatenate((doc[~new], d2)), np.concatenate((lo[~new], l2)), np.concatenate((hi[~new], l2 + s2)))
        h, doc, at, lo, hi = h[new], doc[new], at[new], lo[new], hi[new]
        grams, which, times = np.unique(h, return_inverse=True, return_counts=True)
        many = times[which] > 1
        asks = _ranges(doc[many], at[many], lo[many], hi[many], h[many].view(np.int64))
        # one row for each gram goes to the buckets of grams: its place, or only that it is of interest
        once = ~many
        to = lambda x: (mix(x ^ np.uint64(77)) % np.uint64(buckets)).astype(np.int64)
        known, dest, dest_known = grams[times > 1], to(h[once]), to(grams[times > 1])
        out = []
        rows = [h[once], doc[once], at[once], at[once] - lo[once], hi[once] - lo[once]]
        for b in np.unique(np.concatenate((dest, dest_known))):
            i, k = np.flatnonzero(dest == b), known[dest_known == b]
            one = _pack([np.diff(rows[0][i], prepend=np.uint64(0)), *(r[i] for r in rows[1:])])  # grams ascend
            out.append((int(b), struct.pack("<I", len(one)) + one + k.tobytes()))
        told = pa.concat_tables([repeats, asks])
        told = told.append_column("bucket", pa.nulls(told.num_rows, pa.int32())).append_column("data", pa.nulls(told.num_rows, pa.binary()))
        empty = {n: pa.nulls(len(out), t) for n, t in zip(_NAMES, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)}
        sent = pa.table(empty | {"bucket": pa.array([b for b, _ in out], pa.int32()), "data": pa.array([x for _, x in out], pa.binary())})
        return pa.concat_tables([told, sent])

    return run


def _grams(group: pa.Table) -> pa.Table:
    """Of a bucket of grams: places whose gram has another context elsewhere."""
    rows, known = [], []
    for x in group.column("data").to_pylist():
        n = struct.unpack_from("<I", x)[0]
        c = _unpack(x[4 : 4 + n], 5)
        rows.append([np.cumsum(c[0]), *(v.view(np.int64) for v in c[1:])])
        known.append(np.frombuffer(x, "<u8", offset=4 + n))
    h, doc, at, back, span = (np.concatenate([r[k] for r in rows]) for k in range(5))
    _, which, times = np.unique(h, return_inverse=True, return_counts=True)
    ask = (times[which] > 1) | np.isin(h, np.concatenate(known))
    lo = (at - back)[ask]
    return _ranges(doc[ask], at[ask], lo, lo + span[ask], h[ask].view(np.int64))


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, asks) to rows (doc_id, at, lo, hi, h, context)."""
    for b in batches:
        for part in (p for p in by_bytes(b, [1], BATCH) if p.num_rows):
            asks = part.column(2)
            count = np.diff(asks.offsets.to_numpy())
            flat = asks.flatten()
            at, lo, hi, h = (flat.field(k).to_numpy() for k in range(4))
            which = np.repeat(np.arange(part.num_rows), count)
            texts = raw(part.column(1))
            context = [texts[w][s : e + LENGTH] for w, s, e in zip(which.tolist(), lo.tolist(), hi.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(part.column(0).to_numpy()[which]), pa.array(at), pa.array(lo), pa.array(hi), pa.array(h), pa.array(context, pa.binary())], names=[*_NAMES, "context"])


def _resolve(group: pa.Table) -> pa.Table:
    """Of a bucket of contexts: the ranges of windows that occur in an earlier context. SORTED contexts at a time, whole grams."""
    doc, at, lo, hi, h = (group.column(k).to_numpy() for k in _NAMES)
    o = np.lexsort((at, doc, h))
    doc, at, lo, hi, h = doc[o], at[o].astype(np.int64), lo[o].astype(np.int64), hi[o].astype(np.int64), h[o]
    context = group.column("context").combine_chunks() if isinstance(group.column("context"), pa.ChunkedArray) else group.column("context")
    ends = np.append(np.flatnonzero(h[1:] != h[:-1]) + 1, len(h))
    out, i = [_repeats(doc[:0], lo[:0], hi[:0])], 0
    while i < len(h):
        j = int(ends[max(np.searchsorted(ends, i + SORTED, side="right") - 1, np.searchsorted(ends, i, side="right"))])
        row, first, last = repeated_windows(context.take(pa.array(o[i:j])).to_pylist(), at[i:j], lo[i:j], hi[i:j], h[i:j])
        out.append(_repeats(doc[i:j][row], first, last))
        i = j
    return pa.concat_tables(out)


_BASES = [(byte_codes(21), Powers(0x9FB21C651E98DF25)), (byte_codes(22), Powers(0xC2B2AE3D27D4EB4F))]


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts to their windows (w1, w2, doc_id, start), known by two hashes."""
    for b in (part for batch in batches for part in by_bytes(batch, [5], BATCH // 16)):
        lo, hi, doc = (b.column(k).to_numpy().astype(np.int64) for k in (2, 3, 0))
        data, begin, _ = _joined(raw(b.column(5)))
        n = hi - lo + 1
        row = np.repeat(np.arange(len(n)), n)
        off = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        at = begin[row] + off
        w = []
        for codes, pw in _BASES:
            h = prefix_hash(data, codes, pw)
            w.append(mix((h[at + LENGTH] - h[at]) * pw.get(len(data) + 1)[1][at]).view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(w[0]), pa.array(w[1]), pa.array(doc[row]), pa.array((lo[row] + off).astype(np.int32))], names=["w1", "w2", "doc_id", "start"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, ranges of window starts) to rows (doc_id, n_bytes, spans, kept)."""
    for b in (part for batch in batches for part in by_bytes(batch, [1], BATCH)):
        texts, ranges = raw(b.column(1)), b.column(2)
        spans, kept = [], []
        for i, text in enumerate(texts):
            if not ranges[i].is_valid:
                spans.append([])
                kept.append(text)
                continue
            x = ranges[i].values
            lo, hi = x.field(0).to_numpy(), x.field(1).to_numpy() + LENGTH
            edge = np.zeros(len(text) + 1, dtype=np.int32)
            np.add.at(edge, lo, 1)
            np.add.at(edge, hi, -1)
            gone = np.concatenate(([False], np.cumsum(edge[:-1]) > 0, [False]))
            turn = np.flatnonzero(gone[1:] != gone[:-1])
            spans.append([{"start": s, "end": e} for s, e in zip(turn[0::2].tolist(), turn[1::2].tolist(), strict=True)])
            kept.append(np.frombuffer(text, dtype=np.uint8)[~gone[1:-1]].tobytes())
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, texts), pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans, kept): removed runs (start, end in bytes) and the bytes that stay, of every row."""
    stash = Stash(docs.sparkSession)
    source = docs.select(keyed(key).alias("doc_id"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("text"))
    if not source.groupBy("doc_id").count().where("count > 1").limit(1).count():
        return _without_repeats(stash, source).withColumn("doc_id", unkeyed("doc_id"))
    # rows that share a key: each different text gets a number in the order of keys and hashes of texts
    source = source.select("doc_id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), "text")
    places = stash.keep(source.select("doc_id", "t1", "t2").distinct().orderBy("doc_id", "t1", "t2"), "place")
    rows = source.join(places, ["doc_id", "t1", "t2"])
    first = stash.keep(rows.select(F.col("place").alias("doc_id"), "text").dropDuplicates(["doc_id"]))
    out = _without_repeats(stash, first).withColumnRenamed("doc_id", "place")
    return rows.select("doc_id", "place").join(out, "place").select(unkeyed("doc_id").alias("doc_id"), "n_bytes", "spans", "kept")


def _without_repeats(stash: Stash, source: DataFrame) -> DataFrame:
    """The same for (doc_id, text), both without nulls and no doc_id twice."""
    total = source.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(8, -(-total // BUCKET))
    tasks = min(buckets, TASKS)
    packed = source.mapInArrow(_anchor_batches(buckets), "bucket int, data binary").repartition(tasks, "bucket")
    told = stash.keep(packed.groupBy("bucket").applyInArrow(_classes(buckets), _CLASSES))
    more = told.where("data is not null").select("bucket", "data").repartition(tasks, "bucket").groupBy("bucket").applyInArrow(_grams, _RANGES)
    asked = stash.keep(told.where("at is not null").select(*_NAMES).unionByName(more))
    hot = stash.keep(asked.groupBy("h").count().where(F.col("count") > HOT).select("h"))
    any_hot = hot.limit(1).count() > 0
    asks = asked.groupBy("doc_id").agg(F.collect_list(F.struct("at", "lo", "hi", "h")).alias("asks"))
    contexts = source.join(asks, "doc_id").select("doc_id", "text", "asks").mapInArrow(_contexts, _RANGES + ", context binary")
    contexts = stash.keep(contexts) if any_hot else contexts
    cold = contexts.join(hot, "h", "left_anti").select(*_NAMES, "context") if any_hot else contexts
    cold = cold.withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(buckets)).cast("int")).repartition(tasks, "bucket")
    found = [told.where("at is null and data is null"), stash.keep(cold.groupBy("bucket").applyInArrow(_resolve, _RANGES))]
    if any_hot:
        w = contexts.join(hot, "h", "left_semi").select(*_NAMES, "context").mapInArrow(_windows, "w1 bigint, w2 bigint, doc_id bigint, start int")
        first = w.groupBy("w1", "w2").agg(F.min(F.struct("doc_id", "start")).alias("first"))
        again = w.join(first, ["w1", "w2"]).where(F.struct("doc_id", "start") != F.col("first"))
        found.append(stash.keep(again.select("doc_id", F.col("start").alias("lo"), F.col("start").alias("hi"))))
    ranges = union_all([f.select("doc_id", "lo", "hi") for f in found])
    ranges = ranges.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    return source.join(ranges, "doc_id", "left").select("doc_id", "text", "ranges").mapInArrow(_cut, "doc_id bigint, n_bytes bigint, spans array<struct<start:int,end:int>>, kept binary")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op3_suffix_dedup": op3_suffix_dedup}
ORACLES: dict[str, str] = {}
