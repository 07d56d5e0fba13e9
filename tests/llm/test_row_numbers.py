"""Rows that share a key, or have none, are documents each."""

from collections import Counter

import brute
from pyspark.sql import functions as F

from tessera.llm import mixing, pii

SCHEMA = "doc_id bigint, text string"


def told(df):
    return Counter((tuple(map(tuple, r["base"])), tuple(map(tuple, r["terms"]))) for r in df.collect())


def test_spans_of_shared_and_missing_keys(spark):
    texts = ["Zugspitze bob@corp.example.com at Waldheim today 0", "see bob@corp.example.com Zugspitze", "call bob@corp.example.com of Waldheim", None, ""] + [f"plain words number {k}" for k in range(30)]
    texts += texts[:3]
    alone = told(pii.spans(spark.createDataFrame(list(enumerate(texts)), SCHEMA)))
    assert sum(len(k[1]) * n for k, n in alone.items()) >= 6
    assert told(pii.spans(spark.createDataFrame([(7 if k % 2 else None, t) for k, t in enumerate(texts)], SCHEMA))) == alone
    said = lambda ids: Counter(r["sanitised"] for r in pii.sanitise(spark.createDataFrame(list(zip(ids, texts, strict=True)), SCHEMA)).collect())
    assert said(range(len(texts))) == said([5] * len(texts)) == said([None] * len(texts))


def test_terms_lie_in_their_own_text(spark):
    rows = [(100, "Zugspitze bob@corp.example.com at Waldheim today 0"), (100, "see bob@corp.example.com")] + [(k, "Zugspitze bob@corp.example.com Waldheim") for k in range(4)] + [(k, f"other {k} words") for k in range(10, 40)]
    out = pii.spans(spark.createDataFrame(rows, SCHEMA).withColumn("both", F.struct("doc_id", "text")), "both").collect()
    for r in out:
        text = r["both"]["text"]
        for t in r["terms"]:
            assert t["end"] <= len(text) and text[t["start"] : t["end"]] in ("Zugspitze", "Waldheim")
    assert [len(r["terms"]) for r in out if r["both"]["text"].startswith("see")] == [0]


def test_many_matches_in_one_text(spark):
    text = " ".join(f"name{k}@host{k}.example.org" for k in range(3000)) + " 10.0.0.1"
    r = pii.spans(spark.createDataFrame([(1, text)], SCHEMA)).collect()[0]
    assert ",".join(f"{pii.KINDS[s['kind']]}:{s['start']}:{s['end']}" for s in r["base"]) == brute.pii(text)[4]


def test_copies_of_shared_and_missing_keys(spark):
    """Each row at most three times, the sources' words near their targets."""
    rows = [(7, f"word{k} " * (20 + k % 50), "s1") for k in range(60)] + [(None, f"text{k} " * 30, "s2") for k in range(60)] + [(k, f"more{k} " * 25, "s3") for k in range(100, 200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    target = {r["source"]: r["target"] for r in mixing.mix(docs).select("source", "target").distinct().collect()}
    out = mixing.stage_mix(spark, docs, "").collect()
    assert max(Counter(map(tuple, out)).values()) <= mixing.MOST and set(map(tuple, out)) <= set(rows)
    words = Counter()
    for r in out:
        words[r["source"]] += len(r["text"].split())
    assert all(abs(words[s] - t) <= 60 for s, t in target.items()), (words, target)
