"""What is learned or computed from the corpus, against plain versions and held-out rows."""

import math
import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import pii, quality, toxicity

SF = "/root/testdata/sf0.01"


def test_likelihood_ratio_as_a_column(spark):
    rows = [(a, b) for a in (0, 1, 5, 30) for b in (0, 1, 7, 70)]
    df = spark.createDataFrame(rows, "a int, b int").select("a", "b", toxicity._ratio(F.col("a"), F.col("b"), 30, 70).alias("r"))
    assert all(x["r"] == pytest.approx(toxicity.ratio(x["a"], x["b"], 30, 70), abs=1e-9) for x in df.collect())


def test_chosen_terms_are_no_prefixes_of_each_other():
    counts = [("idiot", False, 40, 0), ("idio", True, 45, 1), ("idiotic", False, 20, 0), ("clown", False, 30, 0), ("rare", False, 5, 0), ("mixed", False, 20, 90)]
    out = [t for t, *_ in toxicity.choose(counts, 100, 1000)]
    assert set(out) == {"idio", "clown"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_toxicity_of_held_out_rows(spark):
    got = toxicity.op9_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("toxic is not null and held_out").collect()
    hit = [r["predicted"] for r in got if r["toxic"] == 1]
    clean = [r["predicted"] for r in got if r["toxic"] == 0]
    assert len(hit) > 3 and sum(hit) >= 0.6 * len(hit) and sum(clean) <= 0.05 * len(clean)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)


def test_disclosure_against_plain_counts(spark, texts):
    rows = [(i, t) for i, t in texts.items()] + [(9000 + i, f"write ann@x.org in Zugspitzdorf {w} now") for i, w in enumerate(["apple", "apple", "pear"])] + [(9100 + i, "apple trees everywhere") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    n_t, n_e, n_et = Counter(), Counter(), Counter()
    for r in pii.find(docs).collect():
        n_e.update({(s["kind"], s["value"]) for s in r["base"]})
        n_et.update({(x["kind"], x["value"], x["term"]) for x in r["near"]})
    for _, t in rows:
        n_t.update(set(re.findall(r"[^\W\d_]{4,}", (t or "").lower())))
    d = len(rows)
    want = {k: math.log2(c * d / (n_e[k[:2]] * n_t[k[2]])) / math.log2(d / n_e[k[:2]]) for k, c in n_et.items() if c >= pii.LEAST}
    got = {(r["kind"], r["value"], r["term"]): r["disclosure"] for r in pii.disclosure(docs, pii.find(docs)).collect()}
    assert want and got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items())


def test_judge_leaves_other_columns_alone(docs):
    own = docs.withColumn("failed_rules", F.lit("mine")).withColumn("base_failed", F.lit("mine"))
    out = quality.judge(own)
    assert out.columns == [*own.columns, "quality"] and {tuple(r) for r in out.select("q", "kept", "failed_rules", "base_failed").collect()} == {(1, None, "mine", "mine")}
