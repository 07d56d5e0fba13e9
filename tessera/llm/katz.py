"""Operator 7: a Katz backoff model of words with Good-Turing discounts, in partitioned tables; order 3, or 2.

    P(w | u v) = d(c) c(u v w) / c(u v)    if u v w was seen     (d(c) < 1 up to CUT, 1 beyond)
               = a(u v) P(w | v)           else                  (a so that the sum over all w is exactly 1)
    P(w | v)   = likewise from c(v w), c(v), a(v) and P(w)
    P(w)       = d(c) c(w) / N, and what the discounts leave for the one class of unknown words

A text is scored word by word, then its end; the first words' histories begin with starts of a text. Histories that were
never seen back off at once. If no count of a history is discounted, it keeps 1 / (c(h) + 1) for unseen words. Each order
has its own discounts.

Words have numbers, most frequent first, so that a word's count follows from its number by the table of the counts alone.
They are known by 64-bit hashes of their bytes. The VOCABULARY most frequent ones are broadcast once (12 bytes each as sent,
about 18 in a worker); a batch of texts asks parts of the table of words for the numbers of its others, each once. Texts are
read once, and kept as numbers.

Tables: words with counts; bigrams and trigrams in buckets, one packed row each, sorted. A bucket holds all grams of its
histories; histories with more than a quarter of a bucket's fair share (pairs of words: an eighth) are spread over all
buckets by the last word, and their backoff weights are summed over buckets. Grams with more than an eighth of a bucket's
share are scored where the texts are. Trigrams are counted where their last two words' bigram is, which gives P(w | v) for
the backoff weights, and go from there to their histories. Each batch of texts asks the buckets of trigrams for its
(trigram, text) pairs in packed form; what was not seen there goes on, with its weight, to the buckets of bigrams. All
statistics cover all training texts; nothing is cut off.

Shuffles of trigrams go in ROUNDS, each for a part of the buckets, and their files go before the next one: the more buckets
there are, the fewer grams a piece has, the less it can be packed and the more sums by text come back, one for nearly each gram.
Everything but the last scoring step runs while the query is being built.

Defined results: null and empty texts are one end token; rows with one doc_id, or without one, count as one document of all
their tokens;
without training texts everything is unknown and both scores are those of an unknown word with certainty; an empty
table gives an empty result.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import by_bytes, keyed, mix, raw, spread, Stash, table, union_all, unkeyed, word_hashes

CUT, VOCABULARY, SHARE, BATCH, BLOCK = 5, 2_000_000, 1_500_000, 1 << 21, 1 << 17
#: Tokens of a kept row; words of a part of their table; rounds, where there are more than FEW buckets; words whose pairs fit 64 bits.
ROW, PART, ROUNDS, FEW, NARROW = 700_000, 500_000, 4, 8, (1 << 32) - 2
END = np.uint64(0xE4D0000000000001)
_U32, _LOW = np.uint64(32), np.uint64((1 << 32) - 1)
_NONE = np.empty(0, dtype=np.uint64)


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of 8 bytes as compressed byte planes."""
    planes = b"".join(np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns)
    return struct.pack("<I", len(columns[0])) + zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(data: bytes, k: int) -> list[np.ndarray]:
    n = struct.unpack_from("<I", data)[0]
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[4:], max_output_size=max(1, 8 * k * n)), dtype=np.uint8).reshape(k, 8, n)
    return [np.ascontiguousarray(flat[i].T).view("<u8").ravel() for i in range(k)]


def pack_one(x: np.ndarray) -> bytes:
    """A column as byte planes of 4 or 8 bytes, as its values ask for."""
    k = 4 if not len(x) or int(x.max()) < 1 << 32 else 8
    planes = np.ascontiguousarray(x.astype(f"<u{k}").view(np.uint8).reshape(-1, k).T).tobytes()
    return struct.pack("<BI", k, len(x)) + zstandard.ZstdCompressor(level=1).compress(planes)


def unpack_one(data: bytes) -> np.ndarray:
    k, n = struct.unpack_from("<BI", data)
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[5:], max_output_size=max(1, k * n)), dtype=np.uint8).reshape(k, n)
    return np.ascontiguousarray(flat.T).view(f"<u{k}").ravel().astype(np.uint64)


def _delta(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


def discounts(n: list[int]) -> np.ndarray:
    """d(0..CUT) from counts of counts n[1..CUT + 1] (n[0] unused); (c - 1/2) / c where Good-Turing gives none in (0, 1)."""
    d = np.ones(CUT + 1)
    tail = (CUT + 1) * n[CUT + 1] / n[1] if n[1] else 0
    for c in range(1, CUT + 1):
        x = ((c + 1) * n[c + 1] / (c * n[c]) - tail) / (1 - tail) if n[c] and tail != 1 else 0
        d[c] = x if 0 < x < 1 else (c - 0.5) / c
    return d


class Unigram:
    """P(w) by count; p0 is for the class of unknown words."""

    def __init__(self, total: int, words: int, n: list[int]):
        self.total, self.words, self.d = total, words, discounts(n)
        left = sum((1 - self.d[c]) * c * n[c] for c in range(1, CUT + 1)) / total if total else 1.0
        self.scale, self.p0 = (1.0, left) if left > 0 else (total / (total + 1), 1 / (total + 1))

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.scale * self.d[np.minimum(c, CUT + 1) % (CUT + 1)] * c / max(1, self.total), self.p0)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (self.total + self.words + 1))


def _d(d: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.where(c > CUT, 1.0, d[np.minimum(c, CUT)])


class Words:
    """Numbers of known words by their hashes; any other word has the number `none`."""

    def __init__(self, h: np.ndarray, number: np.ndarray, none: int):
        by = np.argsort(h)
        self.h, self.number, self.none = np.append(h[by], np.uint64(0xFFFFFFFFFFFFFFFF)), np.append(number[by], 0).astype(np.uint32), np.uint64(none)
        self._places()

    def _places(self) -> None:
        """Hashes are even: their first bits tell the place within a step or two."""
        n = len(self.h) - 1
        bits = max(1, n.bit_length())
        self.shift = np.uint64(64 - bits)
        self.place = np.empty(1 << bits, dtype=np.int32)
        step = min(BLOCK, 1 << bits)
        cuts = np.append(np.searchsorted(self.h[:-1], np.arange(0, 1 << bits, step, dtype=np.uint64) << self.shift), n)
        for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
            some = np.bincount((self.h[i:j] >> self.shift).astype(np.int64) - k * step, minlength=step)
            self.place[k * step : (k + 1) * step] = i + np.cumsum(some) - some

    def __getstate__(self):
        """Packed: every machine writes a broadcast to its disk, and every worker reads it; in blocks, to read it in place."""
        n = len(self.h) - 1
        return n, self.none, [pack([_delta(self.h[i : min(i + BLOCK, n)]), self.number[i : min(i + BLOCK, n)]]) for i in range(0, n, BLOCK)]

    def __setstate__(self, state) -> None:
        n, self.none, blocks = state
        self.h, self.number = np.empty(n + 1, dtype=np.uint64), np.zeros(n + 1, dtype=np.uint32)
        self.h[n] = 0xFFFFFFFFFFFFFFFF
        for i, data in zip(range(0, n, BLOCK), blocks, strict=True):
            h, number = unpack(data, 2)
            j = i + len(h)
            np.cumsum(h, out=self.h[i:j])
            self.number[i:j] = number
        self._places()

    def look(self, h: np.ndarray) -> np.ndarray:
        at = self.place[h >> self.shift]
        low = np.flatnonzero(self.h[at] < h)
        while len(low):
            at[low] += 1
            low = low[self.h[at[low]] < h[low]]
        return np.where((self.h[at] == h) & (at < len(self.h) - 1), self.number[at], self.none).astype(np.uint64)


def _key(k1: np.ndarray, k2: np.ndarray, dense: bool) -> np.ndarray:
    return (k1 << _U32) | k2 if dense else mix(mix(k1 * np.uint64(3)) + k2)


def _bucket(k1, k2, c1, buckets: int, hot: float) -> np.ndarray:
    spread = np.where(c1 > hot, k2 + np.uint64(1), np.uint64(0))
    return (mix(mix(k1 + np.uint64(9)) + spread) % np.uint64(buckets)).astype(np.int64)


def _grams(k: np.ndarray, n: np.ndarray, start: int, order: int) -> tuple:
    """(words of each token's gram, first to last; text) of texts of n tokens with the numbers k."""
    text = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(k)) + (order - 1) * (text + 1)
    seq = np.full(len(k) + (order - 1) * len(n), start, dtype=np.uint64)
    seq[at] = k
    return [seq[at - j] for j in range(order - 1, 0, -1)] + [k], text


def _find(keys: np.ndarray, ask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the asked in sorted keys, and whether they are there."""
    if not len(keys):
        return np.zeros(len(ask), dtype=np.int64), np.zeros(len(ask), dtype=bool)
    at = np.minimum(np.searchsorted(keys, ask), len(keys) - 1)
    return at, keys[at] == ask


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin in sorted columns."""
    if not len(columns[0]):
        return np.empty(0, dtype=np.int64)
    new = np.zeros(len(columns[0]), dtype=bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _bits(x: np.ndarray) -> int:
    return int(x.max()).bit_length() if len(x) else 0


def _unique(k1: np.ndarray, k2: np.ndarray, text: np.ndarray | None = None):
    """(k1, k2, text, n) of the different rows, sorted; as single numbers where they fit."""
    t = np.zeros(len(k1), dtype=np.int64) if text is None else text
    b, c = _bits(k2), _bits(t)
    if _bits(k1) + b + c <= 64:
        b, c = np.uint64(b), np.uint64(c)
        x = np.sort((k1 << (b + c)) | (k2 << c) | t.astype(np.uint64))
        cut = _runs(x)
        n = np.diff(np.append(cut, len(x)))
        x = x[cut]
        one = np.uint64(1)
        return x >> (b + c), (x >> c) & ((one << b) - one), (x & ((one << c) - one)).astype(np.int64), n
    o = np.lexsort((t, k2, k1))
    cut = _runs(k1[o], k2[o], t[o])
    n = np.diff(np.append(cut, len(o)))
    o = o[cut]
    return k1[o], k2[o], t[o], n


def _different(x: np.ndarray, w: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a place, number) of each of the different rows, sorted."""
    if not len(x):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    of = np.unique(x, return_inverse=True)[1].astype(np.uint64)
    b, c = _bits(w), _bits(text)
    if _bits(of) + b + c <= 64:
        y = (of << np.uint64(b + c)) | (w << np.uint64(c)) | text.astype(np.uint64)
        o = np.argsort(y)
        cut = _runs(y[o])
    else:
        o = np.lexsort((text, w, of))
        cut = _runs(of[o], w[o], text[o])
    return o[cut], np.diff(np.append(cut, len(o)))


def _split(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places of its rows in their order)."""
    o = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
    cuts = _runs(bucket[o])
    for i, j in zip(cuts, np.append(cuts[1:], len(o)), strict=True):
        yield int(bucket[o[i]]), o[i:j]


def _pieces(bucket: np.ndarray, buckets: int, columns: list[np.ndarray]) -> dict[int, bytes]:
    """Packed columns by bucket; the first, which comes sorted, as differences."""
    return {k: pack([_delta(columns[0][x]), *(v[x] for v in columns[1:])]) for k, x in _split(bucket, buckets)}


def _joined(rows: list, k: int) -> list[np.ndarray]:
    """The columns of packed rows one after the other."""
    parts = [unpack(x, k) for x in rows if x]
    if not parts:
        return [_NONE] * k
    if len(parts) == 1:
        return [np.cumsum(parts[0][0]), *parts[0][1:]]
    return [np.concatenate([np.cumsum(p[0]) for p in parts]), *(np.concatenate([p[i] for p in parts]) for i in range(1, k))]


def _sparse(text: np.ndarray, value: np.ndarray) -> bytes:
    """Sums by text, for the texts that have some."""
    text = text.astype(np.int64)
    k = np.flatnonzero(np.bincount(text))
    return pack([_delta(k.astype(np.uint64)), np.bincount(text, value)[k].astype(np.float64).view(np.uint64)])


def _merge(key: np.ndarray, *sums: np.ndarray):
    """(order of the first of each key, sums by key)."""
    o = np.argsort(key)
    cut = _runs(key[o])
    return o[cut], [np.add.reduceat(s[o], cut) if len(cut) else s[:0] for s in sums]


class Model:
    """What tasks need to know. Words have numbers below `size`, those of the i-th count from first[i] on; then come the unknown
    word and the start of a text. Not `dense` means that a pair of numbers doesn't fit 64 bits."""

    def __init__(self, uni: Unigram, starts: int, buckets: int, first: np.ndarray, of: np.ndarray):
        self.uni, self.buckets, self.size = uni, buckets, uni.words
        self.start, self.dense = self.size + 1, self.size <= NARROW
        self.first, self.of = np.append(first, [self.size, self.start]).astype(np.uint64), np.append(of, [0, starts]).astype(np.int64)
        self.hot = max(1.0, uni.total / (4 * buckets))
        self.d = self.d3 = None  # discounts of bigrams and trigrams
        self.left: dict = {}  # of hot histories: (mass of seen words, their P(w), has discounted counts)
        self.pairs = (_NONE, np.empty(0), np.empty(0, dtype=np.int64))  # keys of hot bigrams, their log10 P and counts
        self.left3 = (_NONE, *(np.empty(0) for _ in range(4)))  # of hot bigrams as histories: keys, mass, lower, low, total
        self.triples = (_NONE, np.empty(0))  # keys of hot trigrams and their log10 P

    def count(self, k: np.ndarray) -> np.ndarray:
        """Counts of words by their numbers."""
        return self.of[np.searchsorted(self.first, k, side="right") - 1]

    def top(self, keys: np.ndarray) -> np.ndarray:
        """Which pairs are hot."""
        return _find(self.pairs[0], keys)[1]

    def suffix(self, x, v, w, c1) -> np.ndarray:
        """Buckets of trigrams by their bigrams v w; those of hot ones are spread by their history."""
        spread = (mix(mix(x) + w) % np.uint64(self.buckets)).astype(np.int64)
        return np.where(self.top(_key(v, w, self.dense)), spread, _bucket(v, w, c1, self.buckets, self.hot))

    def context(self, x, w) -> np.ndarray:
        """Buckets of trigrams by their histories; those of hot ones are spread by the last word."""
        return _bucket(x, w, self.top(x), self.buckets, 0)

    def histories(self, k1, c, c1, c2):
        """(k1, mass, lower, low) by history: sums of discounted counts, of P(w), and of discounted bigrams."""
        cut = _runs(k1)  # rows of a bucket are sorted
        if not len(cut):
            return k1, *(np.empty(0) for _ in range(3))
        add = lambda x: np.add.reduceat(x, cut)
        return k1[cut], add(_d(self.d, c) * c), add(self.uni.p(c2)), add((c <= CUT).astype(float))

    def log_seen(self, c, c1, low):
        return np.log10(_d(self.d, c) * c / (c1 + (low == 0)))

    def log_unseen(self, c1, c2, mass, lower, low):
        alpha = np.where(c1 > 0, (1 - mass / np.maximum(1, c1 + (low == 0))) / np.maximum(1 - lower, 1e-300), 1.0)
        return np.log10(alpha) + np.log10(self.uni.p(c2))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (part for batch in batches for part in by_bytes(batch, [1], BATCH)):
        h, _ = word_hashes(raw(b.column(1)))
        k, c = np.unique(h, return_counts=True)
        k, c = np.append(k, END), np.append(c, b.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c, pa.int64())], names=["h", "c"])


_TEXTS = "texts binary, tokens binary, own binary"


def _number(said, size: int):
    """Texts (doc_id, text, train) to rows of about ROW tokens: packed (doc_id, number of tokens, train) of the texts, and the
    tokens' numbers; words that aren't broadcast have numbers from size + 2 on, by their place among the row's own hashes."""

    def row(parts: list[tuple]) -> pa.RecordBatch:
        doc, n, train, k, h = (np.concatenate(x) for x in zip(*parts, strict=True))
        own, at = np.unique(h, return_inverse=True)
        if len(h):
            k[k == said.value.none] = at.astype(np.uint64) + np.uint64(size + 2)
        data = pack([doc.view(np.uint64), n, train]), pack_one(k), pack([_delta(own)])
        return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in data], names=["texts", "tokens", "own"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, many = [], 0
        for b in (part for batch in batches for part in by_bytes(batch, [1], BATCH)):
            h, n = word_hashes(raw(b.column(1)))
            ends = np.cumsum(n + 1) - 1
            seq = np.full(len(h) + len(n), END, dtype=np.uint64)
            inner = np.ones(len(seq), dtype=bool)
            inner[ends] = False
            seq[inner] = h
            k = said.value.look(seq)
            own = seq[k == said.value.none] if said.value.none != size else _NONE
            parts.append((b.column(0).to_numpy(), n + 1, b.column(2).to_numpy(zero_copy_only=False).astype(np.int64), k, own))
            many += len(k)
            if many >= ROW:
                yield row(parts)
                parts, many = [], 0
        if parts:
            yield row(parts)

    return run


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def _own(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, 1)[0])


def _ask_numbers(parts: int):
    """Rows (batch, own) to their hashes by parts of the table of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for batch, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h = _own(own)
                data = _pieces(_part(h, parts), parts, [h])
                yield pa.RecordBatch.from_arrays([pa.array(list(data), pa.int32()), pa.array([batch] * len(data), pa.int64()), pa.array(list(data.values()), pa.binary())], names=["part", "batch", "data"])

    return run


def _tell_numbers(size: int):
    """A part's questions and its words to the numbers asked for; that of unknown words is `size`."""

    def run(key: tuple, asked: pa.Table, known: pa.Table) -> pa.Table:
        h, number = known.column("h").to_numpy().view(np.uint64), known.column("number").to_numpy()
        o = np.argsort(h)
        h, number, out = h[o], np.append(number[o], size), []
        for x in asked.column("data").to_pylist():
            at, here = _find(h, _own(x))
            out.append(pack_one(number[np.where(here, at, len(h))]))
        return pa.Table.from_arrays([pa.array([key[0].as_py()] * len(out), pa.int32()), asked.column("batch"), pa.array(out, pa.binary())], names=["part", "batch", "data"])

    return run


def _put_numbers(size: int, parts: int):
    """A row of texts and the numbers of its own words to the row with all numbers."""

    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        k, h = unpack_one(rows.column("tokens")[0].as_py()), _own(rows.column("own")[0].as_py())
        part, number = _part(h, parts), np.zeros(len(h), dtype=np.uint64)
        for p, x in zip(told.column("part").to_pylist(), told.column("data").to_pylist(), strict=True):
            number[part == p] = unpack_one(x)
        own = k >= size + 2
        k[own] = number[k[own] - np.uint64(size + 2)]
        return pa.Table.from_arrays([rows.column("batch"), rows.column("texts"), pa.array([pack_one(k)], pa.binary())], names=["batch", "texts", "tokens"])

    return run


def _rows(batches: Iterator[pa.RecordBatch], learn: bool) -> Iterator[tuple]:
    """(batch, doc_id, number of tokens, tokens) of kept rows (batch, texts, tokens); of the training texts if `learn`."""
    for b in batches:
        for batch, texts, tokens in zip(*(c.to_pylist() for c in b.columns), strict=True):
            (doc, n, train), k = unpack(texts, 3), unpack_one(tokens)
            n = n.view(np.int64)
            if learn:
                on = train > 0
                k, doc, n = k[np.repeat(on, n)], doc[on], n[on]
            yield batch, doc, n, k


def _ask_counts(said):
    """Texts to (bucket, data): the batch's bigrams with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = said.value
        for _, _, n, k in _rows(batches, True):
            k1, k2, _, n = _unique(*_grams(k, n, m.start, 2)[0])
            yield from _dealt(m, _bucket(k1, k2, m.count(k1), m.buckets, m.hot), [k1, k2, n])

    return run


def _dealt(m: Model, bucket: np.ndarray, columns: list[np.ndarray], head: dict[int, bytes] | None = None):
    """One row for each bucket: packed columns; head goes before."""
    data = _pieces(bucket, m.buckets, columns)
    if head is not None:
        for k in head.keys() | data.keys():
            first = head.get(k, b"")
            data[k] = struct.pack("<I", len(first)) + first + data.get(k, pack([_NONE] * len(columns)))
    if data:
        yield pa.RecordBatch.from_arrays([pa.array(list(data), pa.int32()), pa.array(list(data.values()), pa.binary())], names=["bucket", "data"])


_BIGRAMS = "bucket int, data binary, " + ", ".join(f"n{c} bigint" for c in range(1, CUT + 2))


def _sum_counts(dense: bool):
    """A bucket's batches to its row of the table of bigrams: packed (k1, k2, c) and counts of counts."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        k1, k2, n = _joined(group.column("data").to_pylist(), 3)
        at, (n,) = _merge(_key(k1, k2, dense), n.view(np.int64))
        if not dense:
            o = np.lexsort((k2[at], k1[at]))
            at, n = at[o], n[o]
        row = pack([_delta(k1[at]), k2[at], n])
        of = np.bincount(np.minimum(n, CUT + 2), minlength=CUT + 3)
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([row], pa.binary()), *(pa.array([int(of[c])], pa.int64()) for c in range(1, CUT + 2))], names=["bucket", "data", *(f"n{c}" for c in range(1, CUT + 2))])

    return run


def _read_bucket(m: Model, data: bytes):
    k1, k2, n = unpack(data, 3)
    k1 = np.cumsum(k1)
    return k1, k2, n.view(np.int64), m.count(k1), m.count(k2)


def _hot(said):
    """Rows of the table of bigrams to what concerns all buckets: (kind, k1, k2, x, y, z)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = said.value
        for b in batches:
            for data in b.column(0).to_pylist():
                k1, k2, c, c1, c2 = _read_bucket(m, data)
                on = c1 > m.hot
                h, mass, lower, low = m.histories(k1[on], c[on], c1[on], c2[on])
                many = np.flatnonzero(c > m.hot / 2)
                cols = [
                    np.append(np.zeros(len(h), dtype=np.int64), np.ones(len(many), dtype=np.int64)),
                    np.append(h, k1[many]).view(np.int64),
                    np.append(np.zeros(len(h), dtype=np.uint64), k2[many]).view(np.int64),
                    np.append(mass, c[many]),
                    np.append(lower, c1[many]),
                    np.append(low, np.zeros(len(many))),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["kind", "k1", "k2", "x", "y", "z"])

    return run


class Bigrams:
    """A bucket's bigrams, with what P(w | v) needs of their histories."""

    def __init__(self, m: Model, rows: list):
        none = np.empty(0, dtype=np.int64)
        k1, k2, c, c1, c2 = _read_bucket(m, rows[0]) if rows else (_NONE, _NONE, none, none, none)
        cold = c1 <= m.hot
        h, mass, lower, low = m.histories(k1[cold], c[cold], c1[cold], c2[cold])
        if m.left:
            h = np.concatenate((h, np.array(list(m.left), dtype=np.uint64)))
            mass, lower, low = (np.concatenate((x, [v[i] for v in m.left.values()])) for i, x in enumerate((mass, lower, low)))
        o = np.argsort(h)
        self.m, self.h, self.of = m, h[o], np.stack([mass[o], lower[o], low[o]])
        key = _key(k1, k2, m.dense)
        o = np.argsort(key)
        self.key, self.c = key[o], c[o]

    def count(self, v, w) -> np.ndarray:
        """Twice c(v w) of seen bigrams, and 1 more where no count of v's is discounted."""
        key = _key(v, w, self.m.dense)
        c, hot = _find(self.m.pairs[0], key)
        c = self.m.pairs[2][c] if len(self.m.pairs[0]) else c
        at, here = _find(self.key, key)
        c[here & ~hot] = self.c[at[here & ~hot]]
        return 2 * c + (self.of[2, _find(self.h, v)[0]] == 0) if len(v) else c

    def log(self, v, w, c1, c2) -> np.ndarray:
        """log10 P(w | v)."""
        at, has = _find(self.h, v)
        of = np.zeros((3, len(v)))
        of[:, has] = self.of[:, at[has]]
        at, seen = _find(self.key, _key(v, w, self.m.dense))
        value = np.empty(len(v))
        value[seen] = self.m.log_seen(self.c[at[seen]], c1[seen], of[2, seen])
        value[~seen] = self.m.log_unseen(c1[~seen], c2[~seen], *of[:, ~seen])
        return value


class Trigrams:
    """A bucket's trigrams, with what P(w | u v) needs of their histories."""

    def __init__(self, m: Model, rows: list):
        x, w, c, *rest = _read_trigrams(m, rows)
        cold = np.flatnonzero(~m.top(x))
        parts = _contexts(m, x[cold], c[cold], *(a[cold] for a in rest))
        del cold, rest
        cols = [np.concatenate(a) for a in zip(parts, m.left3, strict=True)]
        o = np.argsort(cols[0])
        self.h, self.mass, self.lower, self.low, self.total = (a[o] for a in cols)
        del parts, cols
        key = _key(_find(self.h, x)[0].astype(np.uint64), w, m.dense)  # in the order of the histories
        o = np.argsort(key)
        self.m, self.key, self.c = m, key[o], c[o]

    def log(self, x, w) -> tuple[np.ndarray, np.ndarray]:
        """(log10 P(w | u v) where u v w was seen, else log10 of the weight of P(w | v); seen)."""
        at, has = _find(self.h, x)
        value, seen = np.zeros(len(x)), np.zeros(len(x), dtype=bool)
        on = np.flatnonzero(has)
        place, seen[on] = _find(self.key, _key(at[on].astype(np.uint64), w[on], self.m.dense))
        k, c = at[seen], self.c[place[seen[on]]]
        value[seen] = np.log10(_d(self.m.d3, c) * c / (self.total[k] + (self.low[k] == 0)))
        on = on[~seen[on]]
        k = at[on]
        value[on] = np.log10((1 - self.mass[k] / (self.total[k] + (self.low[k] == 0))) / np.maximum(1 - self.lower[k], 1e-300))
        return value, seen


def _read_trigrams(m: Model, rows: list):
    """(history, word, count, what `Bigrams.count` gives, c(v)), sorted by history."""
    x, w, c, c2, *v = _joined(rows, 4 if m.dense else 5)
    return x, w, c.view(np.int64), c2.view(np.int64), m.count(v[0] if v else x & _LOW)


def _contexts(m: Model, x, c, c2, c1):
    """(x, mass, lower, low, total) by history x, which comes sorted."""
    cut = _runs(x)
    if not len(cut):
        return _NONE, *(np.empty(0) for _ in range(4))
    p = _d(m.d, c2 >> 1) * (c2 >> 1) / (c1 + (c2 & 1))
    return x[cut], *(np.add.reduceat(a, cut) for a in (_d(m.d3, c) * c, p, (c <= CUT).astype(float), c.astype(float)))


def _ask_links(said, turn: int, rounds: int):
    """Texts to (bucket, data): the batch's trigrams (history, word, number), to the buckets of their bigrams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = said.value
        for _, _, n, k in _rows(batches, True):
            (u, v, w), _ = _grams(k, n, m.start, 3)
            x = _key(u, v, m.dense)
            bucket = m.suffix(x, v, w, m.count(v))
            on = np.flatnonzero(bucket % rounds == turn)
            at, n = _different(x[on], w[on], np.zeros(len(on), dtype=np.int64))
            at = on[at]
            yield from _dealt(m, bucket[at], [x[at], w[at], n, *([] if m.dense else [v[at]])])

    return run


def _link(said):
    """A bucket's batches of trigrams and its bigrams to (bucket of the histories, counted trigrams with their bigrams' counts)."""

    def run(asked: pa.Table, known: pa.Table) -> pa.Table:
        m: Model = said.value
        x, w, n, *rest = _joined(asked.column("data").to_pylist(), 3 if m.dense else 4)
        at, (n,) = _merge(_key(x, w, False), n.view(np.int64))
        o = np.argsort(x[at])
        at, n = at[o], n[o]
        x, w = x[at], w[at]
        v = x & _LOW if m.dense else rest[0][at]
        c2 = Bigrams(m, known.column("data").to_pylist()).count(v, w)
        data = _pieces(m.context(x, w), m.buckets, [x, w, n, c2, *([] if m.dense else [v])])
        return pa.Table.from_arrays([pa.array(list(data), pa.int32()), pa.array(list(data.values()), pa.binary())], names=["bucket", "data"])

    return run


def _gather(dense: bool):
    """A bucket's parts to its row of the table of trigrams, with counts of counts."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        x, *rest = _joined(group.column("data").to_pylist(), 4 if dense else 5)
        o = np.argsort(x)
        of = np.bincount(np.minimum(rest[1].view(np.int64), CUT + 2), minlength=CUT + 3)
        row = pack([_delta(x[o]), *(a[o] for a in rest)])
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([row], pa.binary()), *(pa.array([int(of[c])], pa.int64()) for c in range(1, CUT + 2))], names=["bucket", "data", *(f"n{c}" for c in range(1, CUT + 2))])

    return run


_HOT3 = "kind bigint, k1 bigint, k2 bigint, mass double, lower double, low double, total double"


def _hot_contexts(said):
    """Rows of the table of trigrams to parts of the hot histories (kind 0) and to the hot trigrams (kind 1, their count as mass)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = said.value
        for b in batches:
            for data in b.column(0).to_pylist():
                x, w, c, *rest = _read_trigrams(m, [data])
                on = m.top(x)
                xs, *sums = _contexts(m, x[on], c[on], *(a[on] for a in rest))
                many = on & (c > m.hot / 2)
                k = int(many.sum())
                cols = [
                    np.repeat([0, 1], [len(xs), k]),
                    np.concatenate((xs, x[many])).view(np.int64),
                    np.concatenate((np.zeros(len(xs), dtype=np.uint64), w[many])).view(np.int64),
                    np.concatenate((sums[0], c[many])),
                    *(np.concatenate((a, np.zeros(k))) for a in sums[1:]),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in cols], names=["kind", "k1", "k2", "mass", "lower", "low", "total"])

    return run


def _ask_scores(said, order: int, turn: int, rounds: int):
    """Texts to (bucket, data): their grams by text, and in the first round base results of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = said.value
        keys, logs = m.pairs[:2] if order == 2 else m.triples
        for batch, docs, n, tokens in _rows(batches, False):
            k, text = _grams(tokens, n, m.start, order)
            x = k[0] if order == 2 else _key(k[0], k[1], m.dense)
            v, w = k[-2:]
            size = len(docs)
            bucket = _bucket(x, w, m.count(x), m.buckets, m.hot) if order == 2 else m.context(x, w)
            at, here = _find(keys, _key(x, w, m.dense and order == 2))
            rest = np.flatnonzero(~here & (bucket % rounds == turn))
            if order == 2:
                columns = _unique(x[rest], w[rest], text[rest])
                bucket = _bucket(*columns[:2], m.count(columns[0]), m.buckets, m.hot)
            else:
                at_, n_ = _different(x[rest], w[rest], text[rest])
                at_ = rest[at_]
                bucket = bucket[at_]
                columns = [x[at_], w[at_], text[at_], n_, *([] if m.dense else [v[at_]])]
            name = struct.pack("<qI", batch, size)
            buckets = np.unique(bucket)
            heads = {int(b): name for b in buckets}
            if not turn:
                c = m.count(w)
                known, base = np.bincount(text, c > 0, minlength=size).astype(np.uint64), np.bincount(text, m.uni.base(c), minlength=size)
                score = np.bincount(text[here], logs[at[here]], minlength=size).astype(float)
                heads[int(buckets[0]) if len(buckets) else 0] = name + pack([docs, n, known, base.view(np.uint64), score.view(np.uint64)])
            yield from _dealt(m, bucket, columns, heads)

    return run


_PARTS = "batch bigint, size int, head binary, parts binary"
_SCORES = "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double"


def _opened(x: bytes, k: int):
    """(batch, its texts, head, columns) of a question."""
    first = struct.unpack_from("<I", x)[0]
    return *struct.unpack_from("<qI", x, 4), x[16 : 4 + first], _joined([x[4 + first :]], k)


def _parts(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["batch", "size", "head", "parts"])


def _answer(said):
    """A bucket's questions and its row of the table of bigrams to one row for each batch that asks: parts of scores by text."""

    def run(asked: pa.Table, known: pa.Table) -> pa.Table:
        m: Model = said.value
        of, out = Bigrams(m, known.column("data").to_pylist()), []
        for x in asked.column("data").to_pylist():
            batch, size, head, (v, w, text, n) = _opened(x, 4)
            out.append((batch, size, head, _sparse(text, of.log(v, w, m.count(v), m.count(w)) * n.view(np.int64))))
        return _parts(out)

    return run


def _bounded(rows: Iterator[bytes], most: int = 1 << 19) -> Iterator[list[bytes]]:
    """Packed rows in lists of about `most` bytes."""
    now: list[bytes] = []
    size = 0
    for x in rows:
        now.append(x)
        size += len(x)
        if size >= most:
            yield now
            now, size = [], 0
    if now:
        yield now


_ANSWERS = f"bucket int, data binary, {_PARTS}"


def _answer_long(said):
    """A bucket's questions and its row of the table of trigrams to parts of scores by text, a row for each batch that asks,
    and to what was not seen: (bucket of the bigrams, data), which no batch is named for."""

    def run(asked: pa.Table, known: pa.Table) -> pa.Table:
        m: Model = said.value
        of = Trigrams(m, known.column("data").to_pylist())
        out, on, names = [], [], []
        for rows in _bounded(x.as_py() for x in asked.column("data")):
            opened = [_opened(row, 4 if m.dense else 5) for row in rows]
            sizes = [len(o[3][0]) for o in opened]
            x, w, text, n, *rest = (np.concatenate(a) for a in zip(*(o[3] for o in opened), strict=True))
            value, seen = of.log(x, w)
            v = x & _LOW if m.dense else rest[0]
            left = np.flatnonzero(~seen)
            at, here = _find(m.pairs[0], _key(v[left], w[left], m.dense))
            value[left[here]] += m.pairs[1][at[here]]
            value *= n.view(np.int64)
            at = 0
            for (batch, size, head, _), k in zip(opened, sizes, strict=True):
                out.append((None, None, batch, size, head, _sparse(text[at : at + k], value[at : at + k])))
                at += k
            left = left[~here]
            no = np.repeat(np.arange(len(names), len(names) + len(rows)), sizes)
            on.append([v[left], w[left], no[left], text[left], n[left]])
            names += [o[:2] for o in opened]
        v, w, no, text, n = (np.concatenate(a) for a in zip(*on, strict=True)) if on else [_NONE] * 5
        o = np.argsort(v, kind="stable")
        ids, sizes = np.array([i for i, _ in names], dtype=np.int64), np.array([i for _, i in names], dtype=np.int64)
        for bucket, i in _split(_bucket(v[o], w[o], m.count(v[o]), m.buckets, m.hot), m.buckets):
            i = o[i]
            of_names, at = np.unique(no[i], return_inverse=True)
            first = pack([ids[of_names], sizes[of_names]])
            out.append((bucket, struct.pack("<I", len(first)) + first + pack([_delta(v[i]), w[i], at, text[i], n[i]]), None, None, None, None))
        types = (pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
        return pa.Table.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["bucket", "data", "batch", "size", "head", "parts"])

    return run


def _answer_rest(said):
    """What went on to a bucket of bigrams, and its row of their table, to parts of scores by text, a row for each batch."""

    def run(asked: pa.Table, known: pa.Table) -> pa.Table:
        m: Model = said.value
        of, got, out = Bigrams(m, known.column("data").to_pylist()), [], []
        for x in asked.column("data").to_pylist():
            first = 4 + struct.unpack_from("<I", x)[0]
            batch, size = unpack(x[4:first], 2)
            v, w, no, text, n = _joined([x[first:]], 5)
            no = no.astype(np.int64)
            got.append([batch[no], size[no], text, of.log(v, w, m.count(v), m.count(w)) * n.view(np.int64)])
        if got:
            batch, size, text, value = (np.concatenate(a) for a in zip(*got, strict=True))
            o = np.argsort(batch, kind="stable")
            cuts = _runs(batch[o])
            for i, j in zip(cuts, np.append(cuts[1:], len(o)), strict=True):
                k = o[i:j]
                out.append((int(batch[k[:1]].view(np.int64)[0]), int(size[k[0]]), b"", _sparse(text[k], value[k])))
        return _parts(out)

    return run


def _sum(group: pa.Table) -> tuple[int, np.ndarray]:
    """(texts of a batch, sums of its parts by text)."""
    size = group.column("size")[0].as_py()
    score = np.zeros(size)
    for x in group.column("parts").to_pylist():
        if x:
            k, s = _joined([x], 2)
            score[k.astype(np.int64)] += s.view(np.float64)
    return size, score


def _less(group: pa.Table) -> pa.Table:
    """All parts of a batch to one."""
    size, score = _sum(group)
    head = b"".join(x for x in group.column("head").to_pylist() if x)  # one bucket has it
    return _parts([(group.column("batch")[0].as_py(), size, head, _sparse(np.arange(size), score))])


def _total(group: pa.Table) -> pa.Table:
    """All parts of a batch to its texts' results."""
    _, score = _sum(group)
    docs, tokens, known, base, hot = unpack(next(x for x in group.column("head").to_pylist() if x), 5)
    return pa.Table.from_arrays([pa.array(x) for x in (docs.view(np.int64), tokens.view(np.int64), known.view(np.int64), base.view(np.float64), hot.view(np.float64) + score)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])


def _u64(rows: list, name: str) -> np.ndarray:
    return np.array([r[name] for r in rows], dtype=np.int64).view(np.uint64)


def _doubles(rows: list, name: str) -> np.ndarray:
    return np.array([r[name] for r in rows], dtype=float)


def _of_counts(grams: DataFrame) -> np.ndarray:
    return discounts([0, *(x or 0 for x in grams.agg(*(F.sum(f"n{c}") for c in range(1, CUT + 2))).first())])


def _numbered(stash: Stash, source: DataFrame, words: DataFrame, size: int, vocabulary: int) -> DataFrame:
    """(batch, texts, tokens): all texts, kept as the numbers of their words in the order of (c descending, h)."""
    spark = source.sparkSession
    files = size // (PART // 2) + 1
    ranked = stash.keep(words.repartitionByRange(files, F.desc("c"), "h").sortWithinPartitions(F.desc("c"), "h"), "at")
    stash.drop(words)
    rows = dict(ranked.groupBy(F.shiftright("at", 40).alias("file")).count().collect())  # a row for each 250,000 words
    before = [0]
    for k in range(max(rows, default=0)):
        before.append(before[-1] + rows.get(k, 0))
    first = F.array(*map(F.lit, before))[F.shiftright("at", 40).cast("int")].cast("bigint")
    numbers = ranked.select("h", (first + F.col("at").bitwiseAND((1 << 40) - 1)).alias("number"))
    most = min(vocabulary, NARROW)
    got = numbers.where(F.col("number") < most).toArrow()
    known = spark.sparkContext.broadcast(Words(got.column("h").to_numpy().view(np.uint64), got.column("number").to_numpy(), size if size <= most else (1 << 64) - 1))
    del got
    texts = stash.keep(source.mapInArrow(_number(known, size), _TEXTS), "batch")
    if size > most:
        parts = -(-(size - most) // PART)
        asked = texts.select("batch", "own").mapInArrow(_ask_numbers(parts), "part int, batch bigint, data binary").groupBy("part")
        rest = numbers.where(F.col("number") >= most).withColumn("part", (F.shiftrightunsigned("h", 33) % parts).cast("int")).groupBy("part")
        told = asked.cogroup(rest).applyInArrow(_tell_numbers(size), "part int, batch bigint, data binary").groupBy("batch")
        own, texts = texts, stash.keep(texts.groupBy("batch").cogroup(told).applyInArrow(_put_numbers(size, parts), "batch bigint, texts binary, tokens binary"))
        stash.drop(own)
    stash.drop(ranked)
    return texts


def train_and_score(docs: DataFrame, train, key: str = "doc_id", text: str = "text", vocabulary: int = VOCABULARY, share: int = SHARE, order: int = 3) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every document; `train` is a Column over docs."""
    if order not in (2, 3):
        raise ValueError("order is 2 or 3")
    spark = docs.sparkSession
    stash, said = Stash(spark, BATCH), spark.sparkContext.broadcast
    source = docs.select(keyed(key).alias("doc_id"), F.col(text).cast("binary").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    learn = source.where("train")
    words = stash.keep(learn.select("doc_id", "text").mapInArrow(_count_words, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c")))
    counts = words.groupBy("c").count().orderBy(F.desc("c")).toArrow()  # at most the square root of twice the tokens
    c, n = counts.column("c").to_numpy(), counts.column("count").to_numpy()
    size, total, n_of = int(n.sum()), int((c * n).sum()), dict(zip(c.tolist(), n.tolist(), strict=True))
    uni = Unigram(total, size, [0, *(n_of.get(k, 0) for k in range(1, CUT + 2))])
    kept = _numbered(stash, source, words, size, vocabulary)
    texts = kept.select("batch", "texts", "tokens")
    m = Model(uni, learn.count(), max(8, -(-total // share)), np.cumsum(n) - n, c)
    dense, rounds = m.dense, ROUNDS if m.buckets > FEW else 1
    turns = range(rounds)
    of_turn = lambda df, turn: df.where(F.col("bucket") % rounds == turn).select("bucket", "data").groupBy("bucket")
    asked = texts.mapInArrow(_ask_counts(said(m)), "bucket int, data binary")
    bigrams = stash.keep(asked.groupBy("bucket").applyInArrow(_sum_counts(dense), _BIGRAMS))
    m.d = _of_counts(bigrams)
    hot = bigrams.select("data").mapInArrow(_hot(said(m)), "kind bigint, k1 bigint, k2 bigint, x double, y double, z double")
    hot = hot.groupBy("kind", "k1", "k2").agg(F.sum("x").alias("x"), F.sum("y").alias("y"), F.sum("z").alias("z")).collect()  # at most a few for each bucket
    histories = [r for r in hot if r.kind == 0]
    m.left = {int(k): (r.x, r.y, r.z) for k, r in zip(_u64(histories, "k1"), histories, strict=True)}
    pairs = [r for r in hot if r.kind == 1 and r.k1 & 0xFFFFFFFFFFFFFFFF in m.left]
    if pairs:
        low = np.array([m.left[int(k)][2] for k in _u64(pairs, "k1")])
        keys = _key(_u64(pairs, "k1"), _u64(pairs, "k2"), dense)
        o = np.argsort(keys)
        c = _doubles(pairs, "x").astype(np.int64)
        m.pairs = keys[o], m.log_seen(c, _doubles(pairs, "y"), low)[o], c[o]
    to = said(m)
    if order == 3:
        links = []
        for turn in turns:
            asked = texts.mapInArrow(_ask_links(to, turn, rounds), "bucket int, data binary")
            links.append(stash.keep(asked.groupBy("bucket").cogroup(of_turn(bigrams, turn)).applyInArrow(_link(to), "bucket int, data binary")))
        grams = [stash.keep(of_turn(union_all(links), turn).applyInArrow(_gather(dense), _BIGRAMS)) for turn in turns]
        stash.drop(*links)
        trigrams = union_all(grams)
        m.d3 = _of_counts(trigrams)
        hot = trigrams.select("data").mapInArrow(_hot_contexts(said(m)), _HOT3).groupBy("kind", "k1", "k2")
        hot = hot.agg(*(F.sum(c).alias(c) for c in ("mass", "lower", "low", "total"))).orderBy("kind").collect()  # at most a few for each bucket
        histories, triples = ([r for r in hot if r.kind == k] for k in (0, 1))
        keys = _u64(histories, "k1")
        o = np.argsort(keys)
        m.left3 = keys[o], *(_doubles(histories, c)[o] for c in ("mass", "lower", "low", "total"))
        if triples:
            at, _ = _find(m.left3[0], _u64(triples, "k1"))
            c = _doubles(triples, "mass").astype(np.int64)
            keys = _key(_u64(triples, "k1"), _u64(triples, "k2"), False)
            o = np.argsort(keys)
            m.triples = keys[o], np.log10(_d(m.d3, c) * c / (m.left3[4][at] + (m.left3[3][at] == 0)))[o]
        to = said(m)
    less = lambda parts: stash.keep(parts.groupBy("batch").applyInArrow(_less, _PARTS))
    parts, rest = [], []
    for turn in turns:
        asked = texts.mapInArrow(_ask_scores(to, order, turn, rounds), "bucket int, data binary").groupBy("bucket")
        if order == 2:
            parts.append(less(asked.cogroup(of_turn(bigrams, turn)).applyInArrow(_answer(to), _PARTS)))
            continue
        answers = stash.keep(asked.cogroup(of_turn(grams[turn], turn)).applyInArrow(_answer_long(to), _ANSWERS))
        stash.drop(grams[turn])
        rest.append(stash.keep(answers.where("bucket is not null").select("bucket", "data")))
        parts.append(less(answers.where("bucket is null").select("batch", "size", "head", "parts")))
        stash.drop(answers)
    stash.drop(kept)
    if order == 3:
        known = bigrams.select("bucket", "data").groupBy("bucket")
        parts.append(union_all(rest).groupBy("bucket").cogroup(known).applyInArrow(_answer_rest(to), _PARTS))
    out = union_all(parts).groupBy("batch").applyInArrow(_total, _SCORES)
    sums = [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]
    return out.groupBy("doc_id").agg(*sums).withColumn("doc_id", unkeyed("doc_id")).withColumn("train_tokens", F.lit(total).cast("long"))


def held_out(key: str):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 7 == 2


def op7_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = train_and_score(docs, ~held_out("doc_id"))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op7_katz": op7_katz}
ORACLES: dict[str, str] = {}
