"""Operator 4: byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Each match of the pre-token pattern is encoded by itself. Its pieces form a linked list; every adjacent pair that the
vocabulary knows is put into the bucket of its merge rank. A two-level bitmap tells which buckets are occupied, and
find-first-set picks the lowest rank; within a bucket the leftmost place comes first. An entry whose pair has changed
since is stale and skipped. A merge costs O(log n) whatever the length of the pre-token, so one of a megabyte is no
trouble. Encodings of pre-tokens are kept in a bounded cache for each worker.

Both directions, and both in one, are `mapInArrow` steps without a shuffle: work follows the bytes of the input partitions, a lost task is
run again by itself. A worker takes BATCH bytes of text at once. The rank file (under 1 MB, its path a parameter) is read on the driver and broadcast.

Defined results: null or empty texts have no ids and decode to no bytes; repeated rows are encoded each; other columns
stay, but those with a result's name; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Callable, Iterator
from heapq import heappop as pop
from heapq import heappush as push

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import by_bytes, packed, spread, table

#: Encodings in each of a worker's two generations; a full one becomes the old one, from which those in use come back.
CACHE = 200_000
#: A leaf of the bitmap has 2^LEAF bits.
LEAF = 8
MASK = (1 << LEAF) - 1
BITS = [1 << k for k in range(1 << 13)]  # of blocks and ranks in a block: up to two million ranks


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Ranks of a file with one base64 token and its rank a line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token.

    The queue is written out in place, as it is most of the work: bucket[rank] holds places, leaf[block] the bits of the
    occupied ranks of a block, top the bits of the occupied blocks. `x & -x` is find-first-set.
    """
    get = ranks.get
    if (whole := get(piece)) is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))  # end[i]: where the part that begins at i ends; parts are linked through their ends
    before = list(range(-1, n))
    rank_at = [get(piece[i : i + 2]) for i in range(n - 1)]  # of the pair that begins at i
    rank_at.append(None)
    top, leaf, bucket = 0, {}, {}
    for i, r in enumerate(rank_at):
        if r is not None:
            if r in bucket:
                bucket[r].append(i)  # places ascend, which is a heap
            else:
                bucket[r] = [i]
                block = r >> LEAF
                leaf[block] = leaf.get(block, 0) | BITS[r & MASK]
                top |= BITS[block]
    while top:
        first = top & -top
        block = first.bit_length() - 1
        bits = leaf[block]
        bit = bits & -bits
        rank = (block << LEAF) + bit.bit_length() - 1
        own = bucket[rank]
        if len(own) > 1:
            i = pop(own)
        else:
            i = own[0]
            del bucket[rank]
            leaf[block] = bits = bits ^ bit
            if not bits:
                top ^= first
        if rank_at[i] != rank:
            continue  # stale
        j = end[i]
        end[i] = k = end[j]
        rank_at[i] = rank_at[j] = None
        if k < n:
            before[k] = i
            rank_at[i] = r = get(piece[i : end[k]])
            if r is not None:
                if r in bucket:
                    push(bucket[r], i)
                else:
                    bucket[r] = [i]
                    block = r >> LEAF
                    leaf[block] = leaf.get(block, 0) | BITS[r & MASK]
                    top |= BITS[block]
        h = before[i]
        if h >= 0:
            rank_at[h] = r = get(piece[h:k])
            if r is not None:
                if r in bucket:
                    push(bucket[r], h)
                else:
                    bucket[r] = [h]
                    block = r >> LEAF
                    leaf[block] = leaf.get(block, 0) | BITS[r & MASK]
                    top |= BITS[block]
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Codec:
    """Encoder and decoder of one vocabulary; packed ids are little-endian unsigned 32-bit integers."""

    def __init__(self, raw: bytes, pattern: str):
        self.ranks = read_ranks(raw)
        self.token = {v: k for k, v in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _miss(self, piece: str) -> bytes:
        packed = self.old.get(piece)
        if packed is None:
            ids = encode_piece(piece.encode(), self.ranks)
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) < 64:
            if len(self.cache) >= CACHE:
                self.old, self.cache = self.cache, {}
            self.cache[piece] = packed
        return packed

    def encode(self, text: str) -> bytes:
        get, miss = self.cache.get, self._miss
        return b"".join([get(p) or miss(p) for p in self.split(text)])

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, memoryview(packed).cast("I")))


_CODECS: dict[tuple[int, str], Codec] = {}


def _codec(raw: bytes, pattern: str) -> Codec:
    key = (hash(raw), pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(raw, pattern)
    return _CODECS[key]


def _mapped(df: DataFrame, source: str, keep: bool, vocab: str, pattern: str, made: list[T.StructField], ask: Callable[[Codec, object], tuple]) -> DataFrame:
    """df with the columns `made` of `source`, which stays if `keep`: what ask(codec, value) gives, null values as empty."""
    with open(vocab, "rb") as f:
        raw = df.sparkSession.sparkContext.broadcast(f.read())
    names = [x.name for x in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(raw.value, pattern)
        for b in (part for batch in batches for part in by_bytes(batch, [1])):
            own = [b.column(k) for k in range(1 + keep)]
            values = list(zip(*(ask(codec, x.as_py() if x.is_valid else None) for x in b.column(1)), strict=True))
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(v, t) for v, t in zip(values, types, strict=True))], names=[*("row", "v")[: 1 + keep], *names])

    types = [_ARROW[x.dataType] for x in made]
    others = [c for c in df.columns if c != source and c not in names]
    row = packed(df.select(*(F.col(f"`{c}`") for c in others))) if others else F.struct(F.lit(0).alias("_none"))
    rows = df.select(row.alias("row"), F.col(f"`{source}`").alias("v"))
    out = rows.mapInArrow(run, T.StructType([*rows.schema.fields[: 1 + keep], *made]))
    return out.select(*(F.col(f"row.`{c}`") for c in others), *[F.col("v").alias(source)][:keep], *names)


_ARROW = {T.BinaryType(): pa.binary(), T.LongType(): pa.int64(), T.StringType(): pa.string()}


def encode(docs: DataFrame, vocab: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with the column text replaced by packed ids (binary)."""
    return _mapped(docs, text, False, vocab, pattern, [T.StructField(ids, T.BinaryType())], lambda codec, x: (codec.encode(x or ""),))


def decode(encoded: DataFrame, vocab: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """encoded with the bytes of its packed ids (binary; a text that was valid stays valid UTF-8)."""
    return _mapped(encoded, ids, True, vocab, pattern, [T.StructField(decoded, T.BinaryType())], lambda codec, x: (codec.decode(x or b""),))


def round_trip(docs: DataFrame, vocab: str, pattern: str, text: str = "text") -> DataFrame:
    """docs with the column text replaced by ids (packed), n_tokens, ids_sha256 and decoded_sha256: encoded and, from the ids,
    decoded in one pass."""
    digest = lambda x: hashlib.sha256(x).hexdigest()

    def ask(codec: Codec, x) -> tuple:
        ids = codec.encode(x or "")
        return ids, len(ids) // 4, digest(ids), digest(codec.decode(ids))

    made = [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return _mapped(docs, text, False, vocab, pattern, made, ask)


def default_vocab() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = round_trip(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), *default_vocab())
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def stage_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (packed), n_tokens and the digests of ids and decoded bytes of every row."""
    return round_trip(docs.select("doc_id", "text"), *default_vocab())


QUERIES = {"op4_byte_bpe": op4_byte_bpe}
ORACLES: dict[str, str] = {}
