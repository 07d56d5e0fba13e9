"""Queries that search the documents for all benchmark items at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import core_tokens, token_estimate
from tessera.operators import retrieval as R
from tessera.operators import sparse as X
from tessera.plans.fixture import spread
from tessera.plans.indexing import folder
from tessera.sources.versioned import line_chunks

K, BUDGET = 10, 2000


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")


def _chunks(docs: DataFrame) -> DataFrame:
    """(id, text): documents in pieces of twenty lines, id is the document's times 2^20 and the piece's place."""
    return line_chunks(docs.select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))).select((F.shiftleft(F.col("path").cast("long"), 20) + F.col("place")).alias("id"), F.col("content").alias("text"))


def _found(spark: SparkSession, d: str) -> DataFrame:
    items = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("query"), "text")
    return X.search(items, _chunks(spread(_documents(spark, d))), K, folder(spark, "search"), core_tokens)[0]


def search_benchmark(spark, d):
    """The ten best pieces for each benchmark item."""
    return _found(spark, d).select("query", F.shiftright("id", 20).alias("doc_id"), F.col("id").bitwiseAND(F.lit((1 << 20) - 1)).alias("place"), "rank", F.round("score", 6).alias("score"))


def bundle_benchmark(spark, d):
    """Of these the first that fit a budget of tokens, for each item."""
    found = _found(spark, d)
    docs = _documents(spark, d).join(found.select(F.shiftright("id", 20).alias("doc_id")).distinct(), "doc_id", "left_semi")
    size = _chunks(docs).select("id", token_estimate(F.col("text")).alias("tokens"))
    out = X.bundle(found.join(size, "id"), BUDGET)
    return out.select("query", F.shiftright("id", 20).alias("doc_id"), F.col("id").bitwiseAND(F.lit((1 << 20) - 1)).alias("place"), "rank", "tokens", "used")


QUERIES = {f.__name__: f for f in (search_benchmark, bundle_benchmark)}
_STOP = ", ".join(f"'{w}'" for w in R.STOPWORDS)
_TOKENS = f"list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda x: x <> '' AND x NOT IN ({_STOP}))"
#: Every text of every query scored.
_BEST = f"""WITH c AS (SELECT doc_id, i AS place, array_to_string(ls[i * 20 + 1:i * 20 + 20], chr(10)) AS text FROM (SELECT doc_id, ls, unnest(range(0, (len(ls) + 19) // 20)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
t AS (SELECT doc_id, place, {_TOKENS} AS ts FROM c), s AS (SELECT count(*) AS n, avg(len(ts)) AS mean FROM t), p AS (SELECT doc_id, place, len(ts) AS len, unnest(ts) AS term FROM t),
f AS (SELECT doc_id, place, len, term, count(*) AS tf FROM p GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM f GROUP BY term),
q AS (SELECT DISTINCT item_id AS query, unnest({_TOKENS}) AS term FROM benchmark),
b AS (SELECT query, doc_id, place, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * {X.K1 + 1}::DOUBLE / (tf + {X.K1}::DOUBLE * ({1 - X.B}::DOUBLE + {X.B}::DOUBLE * len / mean))) AS score FROM q JOIN f USING (term) JOIN d USING (term), s GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc_id, place) AS INTEGER) AS rank FROM b QUALIFY rank <= {K})"""
ORACLES = {
    "search_benchmark": f"{_BEST} SELECT query, doc_id, place, rank, round(score, 6) AS score FROM r",
    "bundle_benchmark": f"{_BEST}, u AS (SELECT query, r.doc_id, r.place, rank, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens, CAST(sum(CAST(ceil(length(text) / 4) AS BIGINT)) OVER (PARTITION BY query ORDER BY rank) AS BIGINT) AS used FROM r JOIN c USING (doc_id, place)) SELECT * FROM u WHERE used <= {BUDGET}",
}
