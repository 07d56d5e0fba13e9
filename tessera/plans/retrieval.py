"""Queries of the retrieval family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import core_tokens, line_range, overlap, relevance_label, token_estimate
from tessera.operators import retrieval as R
from tessera.operators.prefix import running_sum
from tessera.plans.fixture import Fixture, ctes


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _asked(spark, d, ids):
    e = _t(spark, d, "embeddings")
    rank = {v: i for i, v in enumerate(ids)}
    pick = F.create_map(*[F.lit(x) for kv in rank.items() for x in kv])
    return e.where(F.col("vec_id").isin(ids)).select(pick[F.col("vec_id").cast("int")].alias("variant"), F.when(pick[F.col("vec_id").cast("int")] == 0, 1.0).otherwise(0.7).alias("weight"), F.col("embedding").alias("q"))


def vector_topk(spark, d):
    s = R.scored(_t(spark, d, "embeddings"), _asked(spark, d, [0]))
    return R.top_k(s, 10, ["variant"], [F.col("score").desc(), F.col("vec_id")]).select("vec_id", "label", "rank", F.round("score", 6).alias("score"))


_COS = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"
_TOPK = f"SELECT e.vec_id, e.label, {_COS} AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"
_VARIANT = f"""v AS (SELECT * FROM (VALUES (0, 0, 1.0), (1, 7, 0.7), (2, 21, 0.7), (3, 42, 0.7), (4, 99, 0.7)) t(variant, id, weight)),
s AS (SELECT e.vec_id, e.label, v.variant, v.weight, {_COS} AS score FROM embeddings e, v JOIN embeddings q ON q.vec_id = v.id),
k AS (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 8)"""
_IDS = [0, 7, 21, 42, 99]


def _variant_hits(spark, d):
    s = R.scored(_t(spark, d, "embeddings"), _asked(spark, d, _IDS))
    return R.top_k(s, 8, ["variant"], [F.col("score").desc(), F.col("vec_id")])


def vector_topk_variants(spark, d):
    k = _variant_hits(spark, d)
    w = Window.partitionBy("vec_id")
    return k.select("variant", "vec_id", "rank", F.round("score", 6).alias("score"), F.count("*").over(w).alias("times"), (F.max((F.col("variant") == 0).cast("int")).over(w) == 1).alias("has_original"))


def variant_combined_score(spark, d):
    k = _variant_hits(spark, d)
    w = Window.partitionBy("vec_id")
    combined = F.col("score") + F.log2(1 + F.count("*").over(w)) * 0.08 + F.when(F.max((F.col("variant") == 0).cast("int")).over(w) == 1, 0.05).otherwise(0.0) + (F.col("weight") - 0.5) * 0.05
    return k.withColumn("c", combined).select("variant", "vec_id", F.round("c", 6).alias("combined_score"))


def vector_label_vote(spark, d):
    """Most frequent label among the 25 nearest of vector 0; ties to the smaller label."""
    s = R.scored(_t(spark, d, "embeddings"), _asked(spark, d, [0]))
    k = R.top_k(s, 25, ["variant"], [F.col("score").desc(), F.col("vec_id")])
    n = k.groupBy("label").agg(F.count("*").alias("votes"))
    return n.agg(F.max_by(F.struct("label", "votes"), F.struct("votes", -F.col("label"))).alias("b")).select("b.label", "b.votes")


def chunk_embedding_join(spark, d):
    docs, e = _t(spark, d, "documents"), _t(spark, d, "embeddings")
    return docs.join(e, docs.doc_id == e.vec_id).select("doc_id", "source", "label", F.size("embedding").cast("long").alias("dim"))


def relevance_floor(spark, d):
    s = R.scored(_t(spark, d, "embeddings"), _asked(spark, d, [0]))
    return s.where(F.coalesce("score", F.lit(0.0)) >= 0.3).select("vec_id", relevance_label(F.round("score", 6)).alias("relevance"))


def file_relevance_max(spark, d):
    s = R.scored(_t(spark, d, "embeddings"), _asked(spark, d, [0])).select(F.col("label").cast("string").alias("path"), "score")
    return R.file_relevance(s).select("path", F.round("relevance", 6).alias("relevance"), "hits")


def best_per_path(spark, d):
    s = R.scored(_t(spark, d, "embeddings"), _asked(spark, d, [0])).select(F.col("label").alias("path"), F.col("vec_id").alias("ord"), "score")
    return R.best_per_path(s).select("path", F.col("ord").alias("vec_id"), F.round("score", 6).alias("score"))


def context_budget(spark, d):
    """Documents of each source in doc_id order up to 3000 tokens."""
    docs = _t(spark, d, "documents").select("source", "doc_id", token_estimate(F.col("text")).alias("tokens"))
    return running_sum(docs, "tokens", ["source"], "doc_id", out="used").where("used <= 3000").select("source", "doc_id", "tokens", "used")


HITS = Fixture(
    "hits",
    "ord bigint, path string, content string, lines string, score double, variant int, weight double",
    [
        (0, "src/auth/login.ts", "export function login() {}\n", "1-30", 0.92, 0, 1.0),
        (1, "src/auth/login.ts", "export  function login() {}", "1-30", 0.9, 1, 0.7),
        (2, "src/auth/login.ts", "function logout() {}", "20-40", 0.81, 0, 1.0),
        (3, "src/auth/login.ts", "function logout2() {}", "25-60", 0.8, 1, 0.7),
        (4, "src/db/schema.ts", "type Row = {}", None, 0.65, 0, 1.0),
        (5, "src/db/schema.ts", "type  Row = {}", None, 0.64, 2, 0.7),
        (6, "src/db/schema.ts", "type Col = {}", "x", None, 2, 0.7),
        (7, "src/db/pool.ts", "const pool = 1", "5-8", 0.65, 0, 1.0),
        (8, "src/db/pool.ts", "const pool = 1", "8-5", 0.6, 1, 0.7),
        (9, "lib/a.ts", "import x from 'y'", "2-9", 0.25, 3, 0.6),
    ],
)


def rerank_scores(spark, d):
    return R.rerank(HITS.df(spark)).select("ord", "position", F.round("combined_score", 6).alias("combined_score"))


def dedupe_overlap(spark, d):
    return R.suppress_overlap(HITS.df(spark)).select("ord", "path")


def overlap_pairs(spark, d):
    h = HITS.df(spark).select("ord", "path", line_range(F.col("lines")).alias("r")).where("r is not null")
    o = h.select(F.col("ord").alias("other"), "path", F.col("r").alias("s"))
    return h.join(o, "path").where("ord < other").select("ord", "other", F.round(overlap(F.col("r"), F.col("s")), 6).alias("ratio"))


def retrieve_pipeline(spark, d):
    return R.retrieve(HITS.df(spark), 5).select("ord", "path", "position", F.round("combined_score", 6).alias("combined_score"))


def context_bundle_files(spark, d):
    return R.context_bundle(HITS.df(spark), 200, 3)


QUERY_TEXTS = ["How is the auth config handled?", "login", "  ", "where is `x`", "fix db repo api err", "the of and"]


def expand_query(spark, d):
    from functools import reduce

    frames = [R.variants(spark, q).withColumn("asked", F.lit(q)) for q in QUERY_TEXTS]
    return reduce(DataFrame.unionByName, frames)


Q = Fixture("q", "id int, query string", list(enumerate(QUERY_TEXTS)))


def query_tokens(spark, d):
    return Q.df(spark).select("id", F.array_join(core_tokens(F.col("query")), " ").alias("core"))


CODE = Fixture(
    "code",
    "id int, path string, content string",
    [
        (0, "src/utils/strings.ts", "export function pad(s) {\n  return s;\n}"),
        (1, "src/index.ts", "import a from './a';\nimport b from './b';\n\nexport const x = 1;\n" + "\n".join(f"call{i}(x);" for i in range(30)) + "\nexport class Big {\n  run() {}\n}\n"),
        (2, "tests/a.test.ts", "describe('a', () => {\n it('b', () => {})\n})"),
        (3, "src/api/user.ts", "interface User { id: string }"),
        (4, "src/components/Nav.tsx", "  export const Nav = () => null"),
        (5, "src/types/plan.ts", "/** doc */ type A = 1"),
        (6, "src/core/run.ts", "x = 1"),
        (7, "src/core/kind.ts", "export enum Kind { A }"),
    ],
)


def code_type_case(spark, d):
    c = CODE.df(spark)
    return c.select("id", R.code_type(F.col("content")).alias("code_type"))


def file_summary_case(spark, d):
    c = CODE.df(spark)
    return c.select("id", R.file_summary(F.col("path"), F.array(R.code_type(F.col("content")))).alias("summary"))


def smart_snippet(spark, d):
    return CODE.df(spark).select("id", R.smart_snippet(F.col("content"), 40).alias("snippet"))


_KIND = "CASE " + " ".join(f"WHEN regexp_matches(trim(content), '{p}') THEN '{v}'" for p, v in R.CODE_TYPES) + " ELSE 'code' END"
QUERIES = {f.__name__: f for f in (
    vector_topk, vector_topk_variants, variant_combined_score, vector_label_vote, chunk_embedding_join, relevance_floor, file_relevance_max, best_per_path, context_budget,
    rerank_scores, dedupe_overlap, overlap_pairs, retrieve_pipeline, context_bundle_files, expand_query, query_tokens, code_type_case, file_summary_case, smart_snippet,
)}
ORACLES = {
    "vector_topk": f"SELECT vec_id, label, CAST(row_number() OVER (ORDER BY s DESC, vec_id) AS INTEGER) AS rank, round(s, 6) AS score FROM ({_TOPK}) QUALIFY rank <= 10",
    "vector_topk_variants": f"WITH {_VARIANT} SELECT variant, vec_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score, count(*) OVER (PARTITION BY vec_id) AS times, bool_or(variant = 0) OVER (PARTITION BY vec_id) AS has_original FROM k",
    "variant_combined_score": f"WITH {_VARIANT} SELECT variant, vec_id, round(score + log2(1 + count(*) OVER (PARTITION BY vec_id)) * 0.08::DOUBLE + CASE WHEN bool_or(variant = 0) OVER (PARTITION BY vec_id) THEN 0.05::DOUBLE ELSE 0 END + (weight::DOUBLE - 0.5::DOUBLE) * 0.05::DOUBLE, 6) AS combined_score FROM k",
    "vector_label_vote": f"WITH k AS (SELECT * FROM ({_TOPK}) ORDER BY s DESC, vec_id LIMIT 25) SELECT label, count(*) AS votes FROM k GROUP BY label ORDER BY votes DESC, label LIMIT 1",
    "chunk_embedding_join": "SELECT doc_id, source, label, CAST(len(embedding) AS BIGINT) AS dim FROM documents JOIN embeddings ON doc_id = vec_id",
    "relevance_floor": f"SELECT vec_id, CASE WHEN round(s, 6) >= 0.8 THEN '🔥 High' WHEN round(s, 6) >= 0.6 THEN '✅ Good' WHEN round(s, 6) >= 0.4 THEN '📊 Moderate' ELSE '📌 Low' END AS relevance FROM ({_TOPK}) WHERE s >= 0.3",
    "file_relevance_max": f"SELECT CAST(label AS VARCHAR) AS path, round(max(s), 6) AS relevance, count(*) AS hits FROM ({_TOPK}) GROUP BY label",
    "best_per_path": f"SELECT label AS path, vec_id, round(s, 6) AS score FROM ({_TOPK}) QUALIFY row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) = 1",
    "context_budget": "SELECT source, doc_id, tokens, used FROM (SELECT source, doc_id, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens, CAST(sum(CAST(ceil(length(text) / 4) AS BIGINT)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM documents) WHERE used <= 3000",
    "rerank_scores": ctes(HITS) + r""", h AS (SELECT *, concat_ws('::', path, coalesce(lines, ''), trim(regexp_replace(substr(content, 1, 120), '\s+', ' ', 'g'))) AS sig, coalesce(score, 0) AS base FROM hits),
c AS (SELECT *, base + log2(1 + count(*) OVER (PARTITION BY sig)) * 0.08::DOUBLE + CASE WHEN bool_or(variant = 0) OVER (PARTITION BY sig) THEN 0.05::DOUBLE ELSE 0 END + (weight - 0.5::DOUBLE) * 0.05::DOUBLE AS s FROM h)
SELECT ord, CAST(row_number() OVER (ORDER BY s DESC, base DESC, path, coalesce(try_cast(regexp_extract(lines, '(\d+)', 1) AS BIGINT), 9007199254740991), ord) AS INTEGER) AS position, round(s, 6) AS combined_score FROM c""",
    "overlap_pairs": ctes(HITS) + r""", r AS (SELECT ord, path, try_cast(regexp_extract(lines, '(\d+)\s*-\s*(\d+)', 1) AS INTEGER) AS a, try_cast(regexp_extract(lines, '(\d+)\s*-\s*(\d+)', 2) AS INTEGER) AS b FROM hits)
SELECT x.ord, y.ord AS other, round(greatest(0, least(x.b, y.b) - greatest(x.a, y.a) + 1) / least(x.b - x.a + 1, y.b - y.a + 1), 6) AS ratio FROM r x JOIN r y USING (path) WHERE x.ord < y.ord AND x.a <= x.b AND y.a <= y.b""",
    "query_tokens": ctes(Q) + ", t AS (SELECT id, list_filter(regexp_split_to_array(lower(query), '[^a-z0-9_]+'), lambda x: x <> '' AND x NOT IN (" + ", ".join(f"'{w}'" for w in R.STOPWORDS) + ")) AS w FROM q) SELECT id, array_to_string(w, ' ') AS core FROM t",
    "code_type_case": ctes(CODE) + f" SELECT id, {_KIND} AS code_type FROM code",
}
