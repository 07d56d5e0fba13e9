import os

import pytest
from pyspark.sql import functions as F

from tessera.sources.versioned import Conflict, IndexStore, line_chunks

CHANGES = "path string, type string, content string"


def frame(spark, rows):
    return spark.createDataFrame(rows, CHANGES)


def told(store, version=None):
    chunks = {}
    for r in store.read("chunks", version).collect():
        chunks.setdefault(r["path"], {})[r["place"]] = r["content"]
    files = {p: "\n".join(c[k] for k in sorted(c)) for p, c in chunks.items()}
    assert {r["path"] for r in store.read("state", version).collect()} == set(files)
    return files


@pytest.fixture
def store(spark, tmp_path):
    return IndexStore(spark, f"file://{tmp_path}/index", buckets=8)


def test_batches_equal_a_rebuild(spark, store):
    import random

    r = random.Random(1)
    files = {}
    for k in range(4):
        batch = {}
        for _ in range(25):
            p = f"src/{r.randrange(40)}.ts"
            batch[p] = None if r.random() < 0.3 else "\n".join(f"line {r.randrange(9)}" for _ in range(r.randrange(1, 60)))
        files = {p: c for p, c in {**files, **batch}.items() if c is not None}
        store.apply(frame(spark, [(p, "unlink" if c is None else "change", c) for p, c in batch.items()] + [(None, "change", "x")]))
        assert told(store) == files and store.version() == k + 1
    fresh = IndexStore(spark, store.path + "-rebuilt", buckets=4)
    fresh.apply(frame(spark, [(p, "add", c) for p, c in files.items()]))
    assert told(fresh) == files
    assert IndexStore(spark, store.path, buckets=99).buckets == 8


def test_only_touched_buckets_are_rewritten(spark, store):
    store.apply(frame(spark, [(f"p{k}", "add", f"text {k}") for k in range(60)]))
    before = store._read_manifest(1)["tables"]
    assert store.apply(frame(spark, [("p7", "change", "new"), ("p8", "change", "text 8"), ("nowhere", "unlink", None)])) == 2
    after = store._read_manifest(2)["tables"]
    assert all(sum(before[t][b] != after[t][b] for b in before[t]) == 1 for t in before)
    assert store.apply(frame(spark, [("p7", "change", "new"), ("p9", "add", "text 9")])) == 2  # nothing new
    assert told(store, 1)["p7"] == "text 7" and told(store)["p7"] == "new" and told(store)["p8"] == "text 8"


def test_a_failed_batch_leaves_no_trace(spark, store, monkeypatch):
    store.apply(frame(spark, [("a", "add", "one"), ("b", "add", "two")]))
    files = told(store)

    def broken(new):
        return line_chunks(new).withColumn("content", F.when(F.col("path") == "b", F.raise_error(F.lit("no chunks"))).otherwise(F.col("content")))

    monkeypatch.setattr(store, "chunker", broken)
    with pytest.raises(Exception, match="no chunks"):
        store.apply(frame(spark, [("a", "change", "three"), ("b", "change", "four")]))
    assert store.version() == 1 and told(store) == files
    monkeypatch.setattr(store, "chunker", line_chunks)
    publish = IndexStore._publish
    monkeypatch.setattr(IndexStore, "_publish", lambda *a: (_ for _ in ()).throw(OSError("driver lost")))
    with pytest.raises(OSError):
        store.apply(frame(spark, [("a", "change", "three")]))  # all is written, nothing published
    assert store.version() == 1 and told(store) == files
    monkeypatch.setattr(IndexStore, "_publish", publish)
    assert store.vacuum() == 2 and told(store) == files
    store.apply(frame(spark, [("a", "change", "three")]))
    assert told(store) == {"a": "three", "b": "two"} and store.vacuum(keep=1) >= 0 and told(store) == {"a": "three", "b": "two"}


def test_the_second_of_two_writers_is_told(spark, store):
    store.apply(frame(spark, [("a", "add", "one")]))
    m = store._read_manifest(1)
    store._publish(2, m)
    with pytest.raises(Conflict):
        store._publish(2, m)
    assert store.version() == 2 and told(store) == {"a": "one"}
    assert sorted(n for n in os.listdir(store.path.removeprefix("file://") + "/versions") if not n.startswith(".")) == ["1", "2"]


def test_stream_of_changes(spark, store, tmp_path):
    schema = "path string, type string, content string, ts bigint, ord bigint"
    for rows in ([("a", "add", "1", 1, 1), ("a", "change", "2", 2, 2), ("b", "add", "x", 1, 3)], [("b", "unlink", None, 5, 4), ("c", "add", "y", 5, 5)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for _ in range(2):  # a second run finds nothing new
        changes = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        store.apply_stream(changes, f"{tmp_path}/checkpoint").awaitTermination()
        assert told(store) == {"a": "2", "c": "y"} and store.version() == 2


def test_empty(spark, store):
    assert store.apply(frame(spark, [])) == 0 and told(store) == {}
