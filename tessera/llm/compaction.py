"""Operator 12: executed bin-packed compaction of a folder of Parquet files by run-length first-fit decreasing.

A folder holds one sorted file for each key (`write_files`). Within a bin (here: a day) the files below a size are packed
into groups of at most `cap` rows: files by descending rows, each into the earliest-opened group that still holds it.
Equal-sized files are a run (size, times), and groups with equal room that were opened one after the other are a run too:
the earliest group takes floor(room / size) files of a run at once, a run of groups likewise, so the walk follows the
number of different sizes and not the number of files. What it says are ordinal ranges: files start .. start + per * groups - 1
of a size go to groups group .. group + groups - 1, `per` each; the ranges expand back to files by a join on the
file's place among those of its size. Each group of several is then merged by one task that streams its rows in joining
order, and put in the place of its first file; the other files are not touched.

Scale: rows move twice at most, once into their sorted file and, in small files, once into the merged one; both are
shuffles by file. Plans are tables of files (counts come from the footers), packed bin by bin as runs. Nothing is collected
on the driver but the number of rows. A merged file is put in place, and its sources are taken away, by the tasks: a repeated
task finds what an earlier one has done. Merged files wait in the hidden folder _merging of the target until all are written,
so a job that dies before leaves the folder as it was.

Defined results: rows without a sort key come first in their file, rows without a bin are a bin of their own (null); ids that
are null count as empty; rows equal in all sort keys follow the order of their other columns; an empty table gives an empty
folder and no rows; columns named like a part of the key are kept, the key takes other names. Folders can lie where Arrow's
file systems reach (file, hdfs, s3, gs).
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import packed, shared_dir, Stash, table

SALTS = 16
_HIDDEN = "_merging"


def pack(runs: list[tuple[int, int]], cap: int) -> list[tuple[int, int, int, int, int]]:
    """First-fit decreasing of runs (size, times), sizes falling: (size, start, per, group, groups), as told above.

    A file larger than cap is a group by itself.
    """
    said: list[tuple[int, int, int, int, int]] = []
    open_: list[tuple[int, int, int]] = []  # runs of groups: first, how many, room left in each
    opened = 0

    def fill(first: int, many: int, room: int, per: int, size: int, start: int, left: int) -> tuple[int, int]:
        """Puts files into a run of groups; (groups used, files used)."""
        whole = min(many, left // per)
        if whole:
            said.append((size, start, per, first, whole))
            after.append((first, whole, max(0, room - per * size)))
        rest = left - whole * per if whole < many else 0
        if rest:
            said.append((size, start + whole * per, rest, first + whole, 1))
            after.append((first + whole, 1, room - rest * size))
        return whole + (rest > 0), whole * per + rest

    for size, times in runs:
        start, after = 0, []
        for first, many, room in open_:
            per, used = room // size, 0
            if per and start < times:
                used, n = fill(first, many, room, per, size, start, times - start)
                start += n
            if used < many:
                after.append((first + used, many - used, room))
        if start < times:
            used, _ = fill(opened, times, cap, max(1, cap // size), size, start, times - start)
            opened += used
        open_ = after
    return said


def free(names: list[str], taken: list[str]) -> list[str]:
    """The names, each with as many x after it as it takes to clash with no column; Spark's names know no case."""
    used = {c.lower() for c in taken}
    out = []
    for n in names:
        while n in used:
            n += "x"
        used.add(n)
        out.append(n)
    return out


def _orderable(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.MapType, T.VariantType))


def write_files(rows: DataFrame, path: str, names: list[str], order: list[str]) -> None:
    """rows(row, names..) as one Parquet file of the struct's fields for each value of the names, sorted by the fields
    `order`, then by all others that have an order."""
    fields = rows.schema["row"].dataType.fields
    rest = [f.name for f in fields if f.name not in order and _orderable(f.dataType)]
    by = [F.col(f"`{c}`") for c in order + rest]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = rows.select("row.*", *names).repartition(n, *names).sortWithinPartitions(*names, *by)
    out.write.partitionBy(*names).parquet(path)


class Folder:
    """Parquet files of a folder by the parts of their key; the first part is the bin."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, names: list[str], kinds: list[str]):
        self.spark, self.path, self.names, self.schema = spark, path, names, schema
        self.bin = names[0]
        self.whole = T.StructType(schema.fields + [T.StructField(n, T._parse_datatype_string(k)) for n, k in zip(names, kinds, strict=True)])
        self.kinds = kinds

    def read(self, at: str = "") -> DataFrame:
        return self.spark.read.schema(self.whole).parquet(self.path + at)

    def files(self, at: str = "") -> DataFrame:
        """(key.., file, n_rows): no column of data is read, counts are in the footers."""
        return self.read(at).groupBy(*self.names, F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n_rows"))

    def plan(self, files: DataFrame, small: int, cap: int) -> DataFrame:
        """files with group, place (in joining order), members, first_<part> of the group's first file; large files are
        groups of one."""
        runs = files.where(F.col("n_rows") < small).groupBy(self.bin, "n_rows").agg(F.count("*").alias("times"))
        own_bin, bin_kind = self.bin, self.kinds[0]

        def packed(g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values("n_rows", ascending=False)
            out = pd.DataFrame(pack(list(zip(g["n_rows"].tolist(), g["times"].tolist(), strict=True)), cap), columns=["size", "start", "per", "group", "groups"])
            out.insert(0, "bin", [None if pd.isna(g[own_bin].iloc[0]) else g[own_bin].iloc[0]] * len(out))
            return out.astype({"bin": "object"})

        ranges = runs.groupBy(self.bin).applyInPandas(packed, f"bin {bin_kind}, size bigint, start bigint, per bigint, `group` bigint, groups bigint")
        rest = self.names[1:]
        placed = files.withColumn("_at", F.row_number().over(Window.partitionBy(self.bin, "n_rows").orderBy(*rest)) - 1)
        held = (F.col("_at") >= F.col("start")) & (F.col("_at") < F.col("start") + F.col("per") * F.col("groups"))
        own = placed.where(F.col("n_rows") < small).join(ranges, F.col(self.bin).eqNullSafe(F.col("bin")) & (F.col("n_rows") == F.col("size")) & held)
        own = own.select(*files.columns, (F.col("group") + F.floor((F.col("_at") - F.col("start")) / F.col("per"))).cast("long").alias("group"))
        line = Window.partitionBy(self.bin, "group").orderBy(F.col("n_rows").desc(), *rest)
        own = own.withColumn("place", F.row_number().over(line)).withColumn("members", F.count("*").over(Window.partitionBy(self.bin, "group")))
        for c in rest:
            own = own.withColumn(f"first_{c}", F.first(c).over(line))
        large = files.where(F.col("n_rows") >= small).select("*", F.lit(None).cast("long").alias("group"), F.lit(1).alias("place"), F.lit(1).cast("long").alias("members"), *(F.col(c).alias(f"first_{c}") for c in rest))
        return own.unionByName(large)

    def merge(self, plan: DataFrame) -> None:
        """Writes each group of several as one file and puts it in the place of its first; the sources go."""
        some = plan.where("members > 1").select(*(F.col(c).alias(f"_{c}") for c in self.names), *(F.col(f"first_{c}").alias(f"_first_{c}") for c in self.names[1:]), F.col("n_rows").alias("_n"))
        same = F.lit(True)
        for c in self.names:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        to = [self.bin, *(f"_first_{c}" for c in self.names[1:])]
        rows = self.read().withColumn("_row", F.col("_metadata.row_index")).join(some, same)
        rows = rows.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), *to).sortWithinPartitions(*to, F.col("_n").desc(), *self.names[1:], "_row")
        own = [F.col(f"`{f.name}`") for f in self.schema.fields]
        rows.select(*own, F.col(self.bin), *(F.col(f"_first_{c}").alias(c) for c in self.names[1:])).write.partitionBy(*self.names).parquet(f"{self.path}/{_HIDDEN}")
        new = self.files(f"/{_HIDDEN}").select(*(F.col(c).alias(f"_{c}") for c in self.names), F.col("file").alias("new"))
        old = plan.where("members > 1").groupBy(self.bin, *(f"first_{c}" for c in self.names[1:])).agg(F.collect_list("file").alias("old"), F.min_by("file", "place").alias("first"))
        same = F.col(self.bin).eqNullSafe(F.col(f"_{self.bin}"))
        for c in self.names[1:]:
            same = same & F.col(f"first_{c}").eqNullSafe(F.col(f"_{c}"))
        old.join(new, same).select("new", "first", "old").mapInPandas(_put_in_place, "done bigint").agg(F.sum("done")).collect()
        jvm = self.spark.sparkContext._jvm
        hidden = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{_HIDDEN}")
        hidden.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(hidden, True)


def _gone(fs: FileSystem, path: str) -> None:
    folder, name = path.rsplit("/", 1)
    for p in (path, f"{folder}/.{name}.crc"):
        try:
            fs.delete_file(p)
        except FileNotFoundError:
            pass


def _put_in_place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Moves each merged file beside its first source, then takes the sources away; what is done already stays done."""
    for b in batches:
        for new, first, old in zip(b["new"], b["first"], b["old"], strict=True):
            fs, at = FileSystem.from_uri(new)
            folder = FileSystem.from_uri(first)[1].rsplit("/", 1)[0]
            to = f"{folder}/merged-{at.rsplit('/', 1)[1]}"
            try:
                fs.move(at, to)
            except FileNotFoundError:
                if fs.get_file_info(to).size is None:
                    raise
            for o in old:
                _gone(fs, FileSystem.from_uri(o)[1])
        yield pd.DataFrame({"done": [len(b)]})


def digests(rows: DataFrame, by: list[str], order: str, number: str, amount: str) -> DataFrame:
    """(by.., n_rows, least, most, total, ids_sha256) of each file: one task streams a file's numbers in their order."""
    kinds = dict(rows.dtypes)
    out = ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", n_rows bigint, least bigint, most bigint, total bigint, ids_sha256 string"
    one = rows.select(*by, order, number, amount)
    one = one.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at = None, None

        def told() -> pa.RecordBatch:
            values = [*key, at["n"], at["least"], at["most"], at["total"], at["sha"].hexdigest()]
            return pa.RecordBatch.from_arrays([pa.array([v], type=f) for v, f in zip(values, kinds_out, strict=True)], names=[*by, "n_rows", "least", "most", "total", "ids_sha256"])

        kinds_out = None
        for b in batches:
            if kinds_out is None:
                kinds_out = [b.schema.field(c).type for c in by] + [pa.int64()] * 4 + [pa.string()]
            columns = [b.column(c) for c in by]
            change = [0]
            for c in columns:
                filled = pc.fill_null(c, -(1 << 31)).to_numpy(zero_copy_only=False)
                change += (1 + (filled[1:] != filled[:-1]).nonzero()[0]).tolist()
            cuts = sorted(set(change)) + [b.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                own = tuple(c[lo].as_py() for c in columns)
                if own != key:
                    if key is not None:
                        yield told()
                    key, at = own, {"n": 0, "least": None, "most": None, "total": 0, "sha": hashlib.sha256()}
                ids = b.column(number).slice(lo, hi - lo)
                text = pc.fill_null(ids.cast(pa.string()), "").to_pylist()
                at["sha"].update((("," if at["n"] else "") + ",".join(text)).encode())
                at["n"] += hi - lo
                at["total"] += pc.sum(b.column(amount).slice(lo, hi - lo)).as_py() or 0
                ends = pc.min_max(ids).as_py()
                for k, f in (("min", min), ("max", max)):
                    side = "least" if k == "min" else "most"
                    at[side] = f(x for x in (at[side], ends[k]) if x is not None) if ends[k] is not None or at[side] is not None else None
        if key is not None:
            yield told()

    return one.mapInArrow(run, out)


def dealt(clicks: DataFrame, names: list[str], rows: int) -> DataFrame:
    """(row, day, lot, piece under the given names) of every row. A day's number of rows is counted with map-side combine and
    meets the rows again over SALTS parts of the day."""
    day = F.unix_date(F.col("arrived_at").cast("date"))
    h = F.crc32(F.coalesce(F.col("click_id").cast("string"), F.lit("")))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("d_salt")
    days = clicks.groupBy(day.alias("d")).agg(F.count("*").alias("d_rows")).select("d", "d_rows", salts)
    own = clicks.select(packed(clicks).alias("row"), day.alias("day"), h.alias("h"), F.pmod(F.hash("click_id"), F.lit(SALTS)).alias("salt"))
    own = own.join(days, F.col("day").eqNullSafe(F.col("d")) & (F.col("salt") == F.col("d_salt")))
    lot = F.pmod(F.floor(F.col("h") / 16), 1 + F.floor(F.col("d_rows") / at_least(rows, 150)))
    piece = F.least(F.pmod("h", F.lit(4)), F.pmod(F.floor(F.col("h") / 4), F.lit(4)))
    return own.select("row", *(c.cast("int").alias(n) for c, n in zip([F.col("day"), lot, piece], names, strict=True)))


def at_least(rows: int, x: int) -> int:
    return 1 + rows // x


def described(folder: Folder, plan: DataFrame) -> DataFrame:
    """The contract's row for each final file, from the files as they lie there."""
    day, lot, piece = names = folder.names
    read = folder.read()
    cents = F.coalesce(F.floor(100 * F.col("value") + 0.5), F.lit(0)).cast("long")
    said = digests(read.select(*names, F.col("_metadata.row_index").alias("at"), F.col("click_id").alias("id"), cents.alias("amount")), names, "at", "id", "amount")
    at = F.url_decode(F.replace(F.col("file"), F.lit("+"), F.lit("%2B")))
    paths = folder.files().select(*(F.col(c).alias(f"p_{c}") for c in names), F.regexp_replace(at, "^file:/+", "/").alias("path"))
    columns = [c for c in folder.spark.read.option("recursiveFileLookup", "true").parquet(folder.path).columns] if not plan.isEmpty() else []
    code = F.concat_ws("-", F.col(lot).cast("string"), F.col(piece).cast("string"))
    groups = plan.groupBy(F.col(day).alias("g_day"), F.col(f"first_{lot}").alias("g_lot"), F.col(f"first_{piece}").alias("g_piece")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("place"), code.alias("code")))), lambda x: x["code"]), ",").alias("sources"), (F.count("*") > 1).alias("rewritten")
    )
    same = lambda p: F.col(day).eqNullSafe(F.col(f"{p}_{'day' if p == 'g' else day}")) & (F.col(lot) == F.col(f"{p}_{'lot' if p == 'g' else lot}")) & (F.col(piece) == F.col(f"{p}_{'piece' if p == 'g' else piece}"))
    out = said.join(paths, same("p")).join(groups, same("g"))
    whole = lambda c, n: F.col(c).cast("long").alias(n)
    return out.select(
        whole(day, "day"), whole(lot, "lot"), whole(piece, "piece"), "n_rows", F.col("least").alias("min_click_id"), F.col("most").alias("max_click_id"), F.col("total").alias("cents"),
        "sources", "ids_sha256", F.lit(",".join(columns)).alias("columns"), "path", "rewritten",
    )


def compact_clicks(clicks: DataFrame, path: str) -> DataFrame:
    """Writes clicks under path, one file for each day, lot and piece, compacts there, and describes the final files."""
    spark, rows = clicks.sparkSession, clicks.count()
    names = free(["day", "lot", "piece"], clicks.columns)
    write_files(dealt(clicks, names, rows), path, names, ["arrived_at", "click_id"])
    folder = Folder(spark, path, clicks.schema, names, ["int", "int", "int"])
    plan = Stash(spark).keep(folder.plan(folder.files(), at_least(rows, 600), at_least(rows, 500)))
    folder.merge(plan)
    return described(folder, plan)


def op12_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each final file of clicks, in a new folder under spark.checkpoint.dir at each call."""
    return compact_clicks(table(spark, sf_dir, "clicks"), f"{shared_dir(spark)}/compaction-{uuid.uuid4().hex}")


QUERIES = {"op12_compaction": op12_compaction}
#: It writes files, so it has no SQL; tests/llm compare it with a brute-force version.
ORACLES: dict[str, str] = {}
