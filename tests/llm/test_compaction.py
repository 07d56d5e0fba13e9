import hashlib
import math
import os
import zlib
from collections import defaultdict
from datetime import datetime, timedelta

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import compaction as C

EPOCH = datetime(1970, 1, 1)
SCHEMA = "click_id bigint, day string, arrived_at timestamp_ntz, value double, lot int, _x map<string,int>, row string"


def first_fit(files, cap):
    """[(room, [file, ..])] of files (rows, lot, piece) in falling order, one at a time."""
    groups = []
    for f in sorted(files, key=lambda f: (-f[0], f[1], f[2])):
        for g in groups:
            if sum(x[0] for x in g) + f[0] <= cap:
                g.append(f)
                break
        else:
            groups.append([f])
    return groups


def brute(rows):
    """The contract's rows but for columns and path, of rows (click_id, arrived_at, value)."""
    n = len(rows)
    s = lambda x: 1 + n // x
    days = defaultdict(list)
    for r in rows:
        days[None if r[1] is None else (r[1] - EPOCH).days].append(r)
    out = []
    for day, own in days.items():
        files = defaultdict(list)
        for r in own:
            h = zlib.crc32(b"" if r[0] is None else str(r[0]).encode())
            files[(h // 16) % (1 + len(own) // s(150)), min(h % 4, h // 4 % 4)].append(r)
        for f in files.values():
            f.sort(key=lambda r: (r[1] is not None, r[1] or EPOCH, r[0] is not None, r[0] or 0, r[2] is not None, r[2] or 0))
        sizes = [(len(v), *k) for k, v in files.items()]
        for g in first_fit([x for x in sizes if x[0] < s(600)], s(500)) + [[x] for x in sizes if x[0] >= s(600)]:
            of = [r for _, lot, piece in g for r in files[lot, piece]]
            ids = [r[0] for r in of if r[0] is not None]
            cents = sum(0 if r[2] is None else math.floor(100 * r[2] + 0.5) for r in of)
            sha = hashlib.sha256(",".join("" if r[0] is None else str(r[0]) for r in of).encode()).hexdigest()
            out.append((day, g[0][1], g[0][2], len(of), min(ids, default=None), max(ids, default=None), cents, ",".join(f"{a}-{b}" for _, a, b in g), sha, len(g) > 1))
    return out


def told(df):
    return [(r["day"], r["lot"], r["piece"], r["n_rows"], r["min_click_id"], r["max_click_id"], r["cents"], r["sources"], r["ids_sha256"], r["rewritten"]) for r in df]


def order(rows):
    return sorted(rows, key=str)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.integers(1, 12)), max_size=7, unique_by=lambda x: x[0]), st.integers(9, 40))
def test_runs_give_the_groups_of_single_files(runs, cap):
    runs = sorted(runs, reverse=True)
    files = [(size, 0, k) for size, times in runs for k in range(times)]
    want = [[(f[0], f[2]) for f in g] for g in first_fit(files, cap)]
    got = defaultdict(list)
    for size, start, per, group, groups in C.pack(runs, cap):
        for k in range(per * groups):
            got[group + k // per].append((size, start + k))
    assert [got[k] for k in sorted(got)] == want and sorted(got) == list(range(len(want)))


def test_runs_of_a_million_files_are_a_few_ranges():
    assert len(C.pack([(400, 10**6), (90, 10**6), (7, 10**7)], 1000)) < 20


@pytest.fixture(scope="module")
def clicks():
    import random

    r = random.Random(5)
    rows = []
    for k in range(3000):
        at = EPOCH + timedelta(days=19800 + min(int(r.expovariate(0.3)), 9), seconds=r.randrange(86400))
        rows.append((r.choice([k, k, k, r.randrange(3000)]), "x", at, r.choice([None, -3.005, 0.125, round(r.uniform(-50, 500), 2)]), 7, {"a": k}, "r"))
    rows += rows[:40] + [(None, None, rows[0][2], 1.0, None, None, None), (5, None, None, 2.0, None, None, None), (None, None, None, None, None, None, None)]
    r.shuffle(rows)
    return rows


def test_against_brute_force(spark, clicks, tmp_path):
    df = spark.createDataFrame(clicks, SCHEMA).repartition(5)
    path = f"{tmp_path}/a folder+"
    got = C.compact_clicks(df, path).collect()
    assert order(told(got)) == order(brute([(x[0], x[2], x[3]) for x in clicks]))
    assert any(r["rewritten"] for r in got) and not all(r["rewritten"] for r in got)
    here = {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}
    assert here == {r["path"] for r in got} and not os.path.exists(f"{path}/_merging")
    for r in got:
        t = pq.ParquetFile(r["path"])
        assert t.metadata.num_rows == r["n_rows"] and r["columns"] == "click_id,day,arrived_at,value,lot,_x,row" == ",".join(t.schema_arrow.names)
    left = spark.read.schema(df.schema).option("recursiveFileLookup", "true").parquet(path).drop("_x")
    assert sorted(map(str, left.collect())) == sorted(map(str, df.drop("_x").collect()))


def test_untouched_files_stay_byte_for_byte(spark, clicks, tmp_path):
    df, path = spark.createDataFrame(clicks, SCHEMA), f"{tmp_path}/c"
    names = C.free(["day", "lot", "piece"], df.columns)
    assert names == ["dayx", "lotx", "piece"]
    C.write_files(C.dealt(df, names, len(clicks)), path, names, ["arrived_at", "click_id"])
    before = {os.path.join(d, f): hashlib.sha256(open(os.path.join(d, f), "rb").read()).hexdigest() for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
    folder = C.Folder(spark, path, df.schema, names, ["int", "int", "int"])
    plan = folder.plan(folder.files(), C.at_least(len(clicks), 600), C.at_least(len(clicks), 500)).cache()
    sources = plan.where("members > 1").count()
    folder.merge(plan)
    after = {os.path.join(d, f): hashlib.sha256(open(os.path.join(d, f), "rb").read()).hexdigest() for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
    stayed = set(before) & set(after)
    assert len(stayed) == len(before) - sources and all(before[p] == after[p] for p in stayed)


def test_putting_in_place_can_be_repeated(tmp_path):
    import pandas as pd

    for name in ("new.parquet", "a.parquet", "b.parquet"):
        (tmp_path / name).write_text(name)
    job = pd.DataFrame({"new": [f"file://{tmp_path}/new.parquet"], "first": [f"file://{tmp_path}/a.parquet"], "old": [[f"file://{tmp_path}/a.parquet", f"file://{tmp_path}/b.parquet"]]})
    for _ in range(2):
        assert list(C._put_in_place(iter([job])))[0]["done"].tolist() == [1]
        assert os.listdir(tmp_path) == ["merged-new.parquet"]


def test_empty_table(spark, tmp_path):
    assert C.compact_clicks(spark.createDataFrame([], SCHEMA), f"{tmp_path}/e").collect() == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables here")
def test_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/clicks.parquet").select("click_id", "arrived_at", "value").collect()
    got = C.op12_compaction(spark, "/root/testdata/sf0.001").collect()
    assert order(told(got)) == order(brute([tuple(r) for r in rows]))
