"""Op 7 beyond its broadcast words: what it holds on disk, pairs of numbers that don't fit 64 bits."""

import os
import random
import threading
import time

import brute
import pytest

from tessera.llm import common, katz


def _bytes(*folders: str) -> int:
    total = 0
    for d, _, names in (x for f in folders for x in os.walk(f)):
        for name in names:
            try:
                total += os.lstat(f"{d}/{name}").st_size
            except OSError:
                pass
    return total


def test_disk_beyond_the_broadcast_words(spark, tmp_path):
    r = random.Random(5)
    say = lambda: f"w{int(r.paretovariate(0.6)) % 1_000_000}"
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame([(i, " ".join(say() for _ in range(700))) for i in range(900)], "doc_id bigint, text string").repartition(4).write.parquet(path)
    docs = spark.read.parquet(path)
    size = docs.selectExpr("sum(length(text))").first()[0]
    disks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    at = [common.shared_dir(spark).removeprefix("file:"), *disks.localDirsString()]
    floor, peak, ended = _bytes(*at), [0], threading.Event()

    def watch():
        while not ended.is_set():
            peak[0] = max(peak[0], _bytes(*at) - floor)
            time.sleep(0.02)

    watcher = threading.Thread(target=watch)
    watcher.start()
    out = katz.train_and_score(docs, ~katz.held_out("doc_id"), vocabulary=2000, share=20_000).collect()
    ended.set()
    watcher.join()
    assert len(out) == 900 and {x["n_tokens"] for x in out} == {701}
    assert peak[0] < 2.5 * size


@pytest.mark.parametrize("order", [2, 3])
def test_numbers_beyond_32_bits(docs, texts, order, monkeypatch):
    monkeypatch.setattr(katz, "NARROW", 0)
    want, _, _, _ = brute.katz(texts, katz.discounts, order)
    out = {x["doc_id"]: x for x in katz.train_and_score(docs.select("doc_id", "text"), ~katz.held_out("doc_id"), share=300, order=order).collect()}
    for i, w in want.items():
        assert (out[i]["n_tokens"], out[i]["n_known"], out[i]["train_tokens"]) == w[:3]
        assert out[i]["base_score"] == pytest.approx(w[3], abs=1e-6) and out[i]["score"] == pytest.approx(w[4], abs=1e-6)
