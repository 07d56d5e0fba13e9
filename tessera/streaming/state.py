"""Keyed state with expiry: finding deduplication, session timeouts, cache replays."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.prefix import RANGES, chain, running_max, written

WEEK_MS = 7 * 24 * 3600 * 1000


#: A key with more findings is met by ranges of time, in many tasks.
HOT = 200_000


def dedupe_with_ttl(findings: DataFrame, ttl_ms: int, folder: str, parts: int = RANGES, hot: int = HOT) -> DataFrame:
    """(key, at_ms, ord, is_new, occurrence) of findings(key, at_ms, ord): new if never seen, or last recorded more than ttl_ms ago.

    A duplicate doesn't refresh the record; a stale one is recorded again and counts on. Of findings of one time the one with the lowest `ord` is
    first, of equal rows one; a null key is a key; findings without a time are in no record and come with nulls.

    Keys of up to `hot` findings are dealt over tasks and walked in the order of time, in batches. The others are told by one broadcast of
    at most rows / hot keys; see _by_chains. Tables of the rounds are written under `folder`, which all executors share.
    """
    rows = findings.select("key", "at_ms", "ord")
    many = written(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select(F.col("key").alias("_hot"), F.lit(True).alias("_many")), f"{folder}/hot")
    if many.isEmpty():
        return _by_walks(rows, ttl_ms)
    told = rows.join(F.broadcast(many), F.col("key").eqNullSafe(F.col("_hot")), "left")
    few = told.where("_many is null").select(*rows.columns)
    return _by_walks(few, ttl_ms).unionByName(_by_chains(told.where("_many").select(*rows.columns), ttl_ms, folder, parts))


def _by_walks(findings: DataFrame, ttl_ms: int) -> DataFrame:
    """What dedupe_with_ttl tells, by a walk through each key's findings; a task holds one batch and one record."""
    types = dict(findings.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen, n, first = None, None, 0, True
        for b in batches:
            new, of = [], []
            for key, at in zip(b.column("key").to_pylist(), b.column("at_ms").to_pylist(), strict=True):
                if first or key != now:
                    now, seen, n, first = key, None, 0, False
                fresh = None if at is None else seen is None or at - seen > ttl_ms
                if fresh:
                    seen, n = at, n + 1
                new.append(fresh)
                of.append(None if at is None else n)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("key", "at_ms", "ord")), pa.array(new, type=pa.bool_()), pa.array(of, type=pa.int32())], names=["key", "at_ms", "ord", "is_new", "occurrence"])

    dealt = findings.repartition("key").sortWithinPartitions("key", "at_ms", "ord")
    return dealt.mapInArrow(run, f"key {types['key']}, at_ms {types['at_ms']}, ord {types['ord']}, is_new boolean, occurrence int")


def _by_chains(findings: DataFrame, ttl_ms: int, folder: str, parts: int) -> DataFrame:
    """The same where a key is too large for a task: records are a chain of successors over the distinct times of a key, found by doubling; the
    rest are joins by key and time and a running maximum by ranges."""
    rows = written(findings.groupBy("key", "at_ms", "ord").agg(F.count("*").alias("copies")), f"{folder}/findings")
    times = written(rows.where("at_ms is not null").groupBy("key", "at_ms").agg(F.min(F.struct("ord")).alias("first")), f"{folder}/times")
    records = chain(times, ["key"], "at_ms", ttl_ms, folder, parts, repeats=False).select(F.col("key").alias("_key"), F.col("at_ms").alias("_at"), "n")
    times = written(times.join(records, F.col("key").eqNullSafe(F.col("_key")) & (F.col("at_ms") == F.col("_at")), "left").select("key", "at_ms", "first", "n"), f"{folder}/records")
    told = running_max(times, "n", ["key"], "at_ms", out="occurrence", parts=parts)
    told = told.select(F.col("key").alias("_key"), F.col("at_ms").alias("_at"), F.when(F.col("n").isNotNull(), F.col("first")).alias("_first"), "occurrence")
    out = rows.join(told, F.col("key").eqNullSafe(F.col("_key")) & (F.col("at_ms") == F.col("_at")), "left").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    new = F.coalesce(F.struct("ord").eqNullSafe(F.col("_first")) & (F.col("_copy") == 1), F.lit(False))
    return out.select("key", "at_ms", "ord", F.when(F.col("at_ms").isNotNull(), new).alias("is_new"), F.col("occurrence").cast("int").alias("occurrence"))


def dedupe_stream(findings: DataFrame, ttl_ms: int = WEEK_MS) -> DataFrame:
    """The stream twin: new findings (key, at_ms, occurrence) of findings(key string, at_ms bigint) as they come."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, n = state.get if state.exists else (None, 0)
        rows = []
        for b in batches:
            for at in sorted(b["at_ms"]):
                if seen is None or at - seen > ttl_ms:
                    seen, n = int(at), n + 1
                    rows.append((key[0], seen, n))
        state.update((seen, n))
        yield pd.DataFrame(rows, columns=["key", "at_ms", "occurrence"])

    return findings.groupBy("key").applyInPandasWithState(run, "key string, at_ms bigint, occurrence int", "seen bigint, n int", "append", GroupStateTimeout.NoTimeout)


def session_states(events: DataFrame, now_ms: int, timeout_ms: int = 600_000, most: int = 100) -> DataFrame:
    """(session, events, last_ms, state, kept): sessions idle for longer than the timeout have failed; of the others the
    `most` last used stay."""
    g = events.groupBy("session").agg(F.count("*").alias("events"), F.max("at_ms").alias("last_ms"))
    g = g.withColumn("state", F.when(F.lit(now_ms) - F.col("last_ms") > timeout_ms, "timed_out").otherwise("active"))
    first = g.orderBy(F.col("last_ms").desc(), "session").limit(most).select(F.col("session").alias("_first"), F.lit(True).alias("_kept"))  # an unknown session may be one of them
    g = g.join(F.broadcast(first), F.col("session").eqNullSafe(F.col("_first")), "left")  # `most` rows
    return g.withColumn("kept", (F.col("state") == "active") & F.col("_kept").isNotNull()).drop("_first", "_kept")


def session_totals(states: DataFrame) -> DataFrame:
    """(total, active, terminal, kept, events) of what session_states tells: one row, zeros where there are no sessions."""
    count = lambda test, name: F.count_if(test).alias(name)
    return states.agg(F.count("*").alias("total"), count(F.col("state") == "active", "active"), count(F.col("state") != "active", "terminal"), count(F.col("kept"), "kept"), F.coalesce(F.sum("events"), F.lit(0)).alias("events"))


def last_used(accesses: DataFrame, capacity: int) -> DataFrame:
    """(layer, key, last) of what a least-recently-used cache of each layer holds after accesses(layer, key, seq)."""
    g = accesses.groupBy("layer", "key").agg(F.max("seq").alias("last"))
    return g.withColumn("_n", F.row_number().over(Window.partitionBy("layer").orderBy(F.col("last").desc()))).where(F.col("_n") <= capacity).drop("_n")


def replay_cache(accesses: DataFrame, capacity: int, ttl_ms: int) -> DataFrame:
    """(layer, seq, hit) of a first-in-first-out cache with expiry for each layer of accesses(layer, seq, at_ms, key).

    A layer's accesses follow one another, so they are one task's; it meets them in batches and holds `capacity` keys, so its memory doesn't
    grow with them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[str, int] = OrderedDict()
        now, first = None, True
        for b in batches:
            hits = []
            for layer, at, key in zip(*(b.column(c).to_pylist() for c in ("layer", "at_ms", "key")), strict=True):
                if first or layer != now:
                    held, now, first = OrderedDict(), layer, False
                hit = key in held and at is not None and held[key] is not None and at - held[key] <= ttl_ms
                if not hit:
                    held.pop(key, None)
                    if len(held) >= capacity:
                        held.popitem(last=False)
                    held[key] = at
                hits.append(hit)
            yield pa.RecordBatch.from_arrays([b.column("layer"), b.column("seq"), pa.array(hits, type=pa.bool_())], names=["layer", "seq", "hit"])

    own = accesses.select(F.col("layer").cast("string").alias("layer"), F.col("seq").cast("long").alias("seq"), F.col("at_ms").cast("long").alias("at_ms"), F.col("key").cast("string").alias("key"))
    return own.repartition("layer").sortWithinPartitions("layer", "seq").mapInArrow(run, "layer string, seq bigint, hit boolean")


def replay_layers(accesses: DataFrame, ttl_ms: int = 3_600_000) -> DataFrame:
    """(seq, hit): which of the layers memory (commit and file), commit, content hash answers accesses(seq, at_ms, commit,
    path, content_hash); a hit in a lower layer is put into the upper ones."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        layers: list[dict] = [{}, {}, {}]
        rows = []
        for seq, at, commit, path, content in pdf.sort_values("seq")[["seq", "at_ms", "commit", "path", "content_hash"]].itertuples(index=False):
            keys = ((commit, path, content), (commit, path), (path, content))
            level = next((i for i in range(3) if keys[i] in layers[i] and at - layers[i][keys[i]] <= ttl_ms), 3)
            for i in range(min(level, 3) if level < 3 else 3):
                layers[i][keys[i]] = at
            rows.append((int(seq), ["memory", "commit", "content", "miss"][level]))
        return pd.DataFrame(rows, columns=["seq", "hit"])

    return accesses.groupBy("path").applyInPandas(run, "seq bigint, hit string")
