"""An index kept up by batches of changes: copy-on-write by buckets, published all at once.

Tables (chunks and state) are dealt over buckets by a hash of the path. A batch rewrites the buckets that its changes touch, into new
folders, and then publishes a manifest that names the folder of each bucket of each table; a manifest appears by one
rename, under the number after the version it was made from. So a reader sees the old version or the new one, both tables together; a batch that
fails leaves no trace but folders that no manifest names (`vacuum` takes them away); of two writers from one version, one
fails with Conflict and starts again.

Scale: the driver holds a manifest (buckets x tables) and the numbers of touched buckets, never rows. A path is in one
bucket, so a merge is an anti-join inside buckets; take about one bucket for each few hundred MB.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.prefix import written

SCHEMAS = {"chunks": "path string, place int, content string", "state": "path string, hash string"}


class Conflict(RuntimeError):
    """Another writer has published the version that this one wanted to."""


def line_chunks(files: DataFrame, lines: int = 20) -> DataFrame:
    """(path, place, content): each file(path, content) in pieces of so many lines."""
    split = F.split(F.coalesce("content", F.lit("")), "\n", -1)
    first = F.sequence(F.lit(1), F.size(split), F.lit(lines))
    return files.select("path", F.posexplode(F.transform(first, lambda i: F.array_join(F.slice(split, i, lines), "\n"))).alias("place", "content"))


class IndexStore:
    """The versions of an index under a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16, chunker: Callable[[DataFrame], DataFrame] = line_chunks):
        self.spark, self.path, self.chunker = spark, path.rstrip("/"), chunker
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        first = self._read_manifest(self.version())
        self.buckets = first["buckets"] if first else buckets

    # ---- versions ----

    def version(self) -> int:
        """The latest published version, 0 if there is none."""
        at = self._path(f"{self.path}/versions")
        if not self._fs.exists(at):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def _read_manifest(self, version: int) -> dict | None:
        if version == 0:
            return None
        return json.loads(self.spark.read.text(f"{self.path}/versions/{version}").first()["value"])

    def _publish(self, version: int, manifest: dict) -> None:
        tmp, to = f"{self.path}/versions/_{uuid.uuid4().hex}", f"{self.path}/versions/{version}"
        self.spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.text(tmp)
        # a rename onto a folder that is there would move into it, so whoever comes second has to find it there
        if self._fs.exists(self._path(to)) or not self._fs.rename(self._path(tmp), self._path(to)) or self._fs.exists(self._path(f"{to}/{tmp.rsplit('/', 1)[1]}")):
            self._fs.delete(self._path(tmp), True)
            self._fs.delete(self._path(f"{to}/{tmp.rsplit('/', 1)[1]}"), True)
            raise Conflict(f"version {version} is there already")

    # ---- rows ----

    def read(self, table: str, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A table of a version, the latest by default, or only some buckets of it."""
        m = self._read_manifest(self.version() if version is None else version)
        folders = [f for b, f in sorted((m or {"tables": {table: {}}})["tables"][table].items()) if buckets is None or int(b) in buckets]
        return self.spark.read.schema(SCHEMAS[table]).parquet(*folders) if folders else self.spark.createDataFrame([], SCHEMAS[table])

    def _bucket(self, path: str = "path") -> Column:
        return F.pmod(F.xxhash64(path), F.lit(self.buckets)).cast("int")

    def apply(self, changes: DataFrame) -> int:
        """Merges changes(path, type, content), one row a path, type `unlink` or any other; the version after it.

        Files whose hash is in the state already are passed over; a batch that changes nothing publishes nothing. Rows without a path are no files.
        """
        base = self.version()
        manifest = self._read_manifest(base) or {"buckets": self.buckets, "tables": {t: {} for t in SCHEMAS}}
        gone = F.coalesce(F.col("type") == "unlink", F.lit(False))
        own = changes.where(F.col("path").isNotNull()).select("path", gone.alias("gone"), "content", F.when(~gone, F.sha2(F.coalesce("content", F.lit("")), 256)).alias("hash"))
        at = [r["b"] for r in own.select(self._bucket().alias("b")).distinct().collect()]  # at most `buckets` numbers
        state = self.read("state", base, at)
        known = state.select(F.col("path").alias("p"), F.col("hash").alias("h"))
        own = own.join(known, F.col("path") == F.col("p"), "left").where(F.when(F.col("gone"), F.col("p").isNotNull()).otherwise(F.col("h").isNull() | (F.col("h") != F.col("hash"))))
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        written(own.select("path", "gone", "content", "hash", self._bucket().alias("bucket")), f"{folder}/changes")
        own = self.spark.read.parquet(f"{folder}/changes")
        touched = sorted(r["bucket"] for r in own.select("bucket").distinct().collect())
        if not touched:
            self._fs.delete(self._path(folder), True)
            return base
        new = own.where(~F.col("gone"))
        made = {"chunks": self.chunker(new.select("path", "content")), "state": new.select("path", "hash")}
        # which files stay is told by the narrow table; where they are few, the others' contents aren't shuffled
        stays = written(self.read("state", base, touched).join(own.select("path"), "path", "left_anti").select("path"), f"{folder}/stays")
        for table, rows in made.items():
            kept = self.read(table, base, touched).join(stays, "path", "left_semi")
            all_rows = kept.unionByName(rows).withColumn("bucket", self._bucket())
            written(all_rows.repartition(len(touched), "bucket"), f"{folder}/{table}", ["bucket"])
            filled = {s.getPath().getName() for s in self._fs.listStatus(self._path(f"{folder}/{table}"))}
            manifest["tables"][table] = {b: f for b, f in manifest["tables"][table].items() if int(b) not in touched}
            manifest["tables"][table] |= {str(b): f"{folder}/{table}/bucket={b}" for b in touched if f"bucket={b}" in filled}
        for done in ("changes", "stays"):
            self._fs.delete(self._path(f"{folder}/{done}"), True)
        self._publish(base + 1, manifest)
        return base + 1

    def apply_stream(self, changes: DataFrame, checkpoint: str):
        """Merges each micro-batch of changes(path, type, content, ts, ord): the last change of each path. A batch that runs again changes nothing."""

        def batch(df: DataFrame, epoch: int) -> None:
            last = df.groupBy("path").agg(F.max_by(F.struct("type", "content"), F.struct("ts", "ord")).alias("l"))
            self.apply(last.select("path", "l.type", "l.content"))

        return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def vacuum(self, keep: int = 2) -> int:
        """Takes away all but the last `keep` versions and the folders that only they, or failed batches, have made; the number of folders. Not
        beside a running batch."""
        latest = self.version()
        kept = [v for v in range(max(1, latest - keep + 1), latest + 1)]
        named = {f.rsplit("/", 2)[0] for v in kept for t in self._read_manifest(v)["tables"].values() for f in t.values()}
        for v in range(1, latest - keep + 1):
            self._fs.delete(self._path(f"{self.path}/versions/{v}"), True)
        data = self._path(f"{self.path}/data")
        old = [s.getPath() for s in self._fs.listStatus(data) if not any(n.endswith("/data/" + s.getPath().getName()) for n in named)] if self._fs.exists(data) else []
        for p in old:
            self._fs.delete(p, True)
        return len(old)
