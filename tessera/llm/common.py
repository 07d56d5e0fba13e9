"""Shared helpers: table access, durable intermediate results, words, connected components."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed by the contract: what separates words.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores where its files give fewer tasks than that (one small file); any other table as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a local master gets one of its own (tests); a
    cluster without it is an error, as a local folder would scatter a table over the executors' disks."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="tessera-checkpoint-")
        spark.sparkContext.setCheckpointDir(at)
        at = spark.sparkContext.getCheckpointDir()
    return at


class Stash:
    """Written tables in the shared folder that cut lineage: a lost executor costs a reread, not a recomputation.

    drop() removes tables that nothing reads any more. `batch` bounds the bytes of an Arrow batch while a table is written, so
    that JVM and worker hold no more than a worker takes at once (Spark's own bound lets 10,000 rows of any size in).
    """

    def __init__(self, spark: SparkSession, batch: int | None = None):
        self.set = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}  # a write is the only reader of its shuffles
        if batch:
            self.set["spark.sql.execution.arrow.maxBytesPerBatch"] = str(batch)
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/stash-{uuid.uuid4().hex}", 0
        self.paths: dict[int, str] = {}

    def keep(self, df: DataFrame, number: str | None = None) -> DataFrame:
        """df, written and read again. `number` names a further column: a bigint for each row, different for all rows and the
        same for all readers, made of the row's file and place in it."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        before = {k: self.spark.conf.get(k, None) for k in self.set}
        for k, v in self.set.items():
            self.spark.conf.set(k, v)
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
        out = self.spark.read.schema(df.schema).parquet(path)
        if number:
            file = F.regexp_extract(F.col("_metadata.file_name"), r"^part-([0-9]+)-", 1).cast("bigint")
            out = out.select("*", (F.shiftleft(file, 40) + F.col("_metadata.row_index")).alias(number))
        self.paths[id(out)] = path
        out._stash_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df._stash_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Rows without a key count as one document with this key: the last of all (a key of this value means the same).
LAST = (1 << 63) - 1


def keyed(key: str) -> Column:
    return F.coalesce(F.col(key).cast("bigint"), F.lit(LAST))


def unkeyed(key: str) -> Column:
    return F.when(F.col(key) != LAST, F.col(key))


def packed(df: DataFrame, but: tuple[str, ...] = ()) -> Column:
    """All columns (but some) as one struct, so that no name can clash with an operator's own."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns if c not in but))


def words(text: Column) -> Column:
    """Array of the contract's words; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), "")


def components(stash: Stash, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node in edges(a, b) with a != b; component is the smallest node reachable.

    Alternating large-star and small-star steps, each an aggregation with map-side combine and one join, so a hub
    never has to sit in one task. Every round is written to the shared folder. Nodes without edges don't appear.
    """
    cur = stash.keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    total = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = total(cur)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        nxt = stash.keep(small)
        now = total(nxt)
        stash.drop(cur)
        cur = nxt
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = cur.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


# ---- bytes of many texts at once, for the operators that run on Arrow batches ----

#: Bytes of text that a worker takes at once, a longer text by itself.
BATCH = 1 << 19
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x *= _MIX[0]
    x ^= x >> np.uint64(33)
    x *= _MIX[1]
    x ^= x >> np.uint64(33)
    return x


def byte_codes(seed: int) -> np.ndarray:
    """A 64-bit code for each byte value, from a seed."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, by doubling."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    done, step = 1, np.uint64(base)
    while done < n:
        m = min(done, n - done)
        out[done : done + m] = out[:m] * step
        done, step = done + m, step * step
    return out[:n]


class Powers:
    """Powers of an odd base and of its inverse; those of a batch are kept, those of a longer text are made anew."""

    def __init__(self, base: int):
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > 4 * BATCH:
            return powers(self.base, n), powers(self.inverse, n)
        if len(self.up) < n:
            self.up, self.down = powers(self.base, n + n // 4), powers(self.inverse, n + n // 4)
        return self.up[:n], self.down[:n]


def prefix_hash(data: np.ndarray, codes: np.ndarray, pw: Powers) -> np.ndarray:
    """H with H[j] - H[i] = sum of code(byte) * base^position over i <= position < j, modulo 2^64."""
    up, _ = pw.get(len(data))
    h = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(codes[data] * up, out=h[1:])
    return h


_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_EIGHT = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, and the number of words of each text.

    The words are the contract's; A-Z are lower-cased first. A word is hashed in blocks of 8 bytes: each is mixed with its
    place before the blocks are summed, so no structure of a long word cancels out. Memory is a dozen times the batch's bytes.
    """
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    data = np.frombuffer(b"\n".join(texts) + b"\n" * 9, dtype=np.uint8)  # a block may be read at any byte
    if lower:
        data = _LOWER[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], _IS_SPACE[data]))))  # begins and ends in turn
    begin, size = edge[0::2], edge[1::2] - edge[0::2]
    block = np.ndarray((len(data) - 8,), dtype="<u8", buffer=data, strides=(1,))
    out = mix((block[begin] & _EIGHT[np.minimum(size, 8)]) + _STEP)
    long = np.flatnonzero(size > 8)
    if len(long):
        more = (size[long] - 1) >> 3  # blocks after the first
        first = np.cumsum(more) - more
        k = np.arange(int(more.sum())) - np.repeat(first, more) + 1
        left = np.repeat(size[long], more) - 8 * k
        rest = mix((block[np.repeat(begin[long], more) + 8 * k] & _EIGHT[np.minimum(left, 8)]) + _STEP * (k + 1).astype(np.uint64))
        out[long] += np.add.reduceat(rest, first)
    out = mix(out + size.astype(np.uint64) * _STEP)
    upto = np.searchsorted(begin, np.cumsum(sizes + 1), side="left")
    return out, np.diff(np.concatenate(([0], upto)))


def by_bytes(batch, columns: list[int], most: int = BATCH):
    """Slices of a record batch whose given string or binary columns hold about `most` bytes together, or one row."""
    n = np.zeros(batch.num_rows, dtype=np.int64)
    for c in columns:
        n += _lengths(batch.column(c))
    ends, at = np.cumsum(n), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def _lengths(column) -> np.ndarray:
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def raw(column) -> list[bytes]:
    """The values of a string or binary column as bytes; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def roots(n: int, a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id in each member's component, by spreading minima with pointer jumps."""
    order = np.argsort(ids, kind="stable")
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    up = np.arange(n)
    a, b = rank[a], rank[b]
    while True:
        low = np.minimum(up[a], up[b])
        new = up.copy()
        np.minimum.at(new, up[a], low)
        np.minimum.at(new, up[b], low)
        new = new[new]
        if np.array_equal(new, up):
            return ids[order[up[rank]]]
        up = new


def sorted_groups(batches, key: int):
    """(record batch, cuts) of whole groups of rows that come sorted by the column `key`; a group may span batches."""
    left = None
    for b in _ended(batches):
        if b is not None:
            left = b if left is None else pa.Table.from_batches([left, b]).combine_chunks().to_batches()[0]
        if left is None or not left.num_rows:
            continue
        k = left.column(key).to_numpy()
        cuts = np.concatenate(([0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]))
        if b is not None:
            cuts = cuts[:-1]  # the last group may go on
        if len(cuts) > 1:
            yield left.slice(0, int(cuts[-1])), cuts
            left = left.slice(int(cuts[-1]))


def _ended(batches):
    yield from batches
    yield None


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
