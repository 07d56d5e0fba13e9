"""Ranked retrieval: cosine top-K for query variants, overlap suppression, rerank, budgets and context bundles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import STOPWORDS, SYNONYMS, cosine, line_range, overlap, squeeze, token_estimate

#: Bounds of a request.
MAX_K, MAX_VARIANTS = 50, 6


def expand_query(query: str, most: int = 4) -> list[tuple[int, str, str, float]]:
    """(index, query, source, weight) of a query and its rewrites, on the driver: a request is one short string."""
    whole = query.strip()
    found: dict[str, tuple[int, str, str, float]] = {}

    def add(text: str, source: str, weight: float) -> None:
        if text and text.lower() not in found:
            found[text.lower()] = (len(found), text, source, weight)

    add(whole, "original", 1.0)
    words = [w for w in "".join(c if c.isascii() and (c.isalnum() or c == "_") else " " for c in whole.lower()).split()]
    core = [w for w in words if w not in STOPWORDS]
    if most > 1 and "`" not in whole and len(whole) <= 200 and len(core) > 1:
        add(f"where {' '.join(core)} is handled", "expanded", 0.7)
        add(f"implementation of {' '.join(core)}", "expanded", 0.7)
        rewrites = [(i, r) for i, w in enumerate(core) for r in SYNONYMS.get(w, [])]
        for i, r in rewrites:
            if len(found) >= most:
                break
            add(" ".join([*core[:i], r, *core[i + 1 :]]), "expanded", 0.6)
    return list(found.values())[: max(1, most)] if whole else []


def variants(spark: SparkSession, query: str, most: int = 4) -> DataFrame:
    return spark.createDataFrame(expand_query(query, max(1, min(MAX_VARIANTS, most))), "variant int, query string, source string, weight double")


def scored(vectors: DataFrame, queries: DataFrame, vector: str = "embedding") -> DataFrame:
    """Each row with each of at most MAX_VARIANTS queries(variant, weight, q): score, -1 for rows without a vector.

    The queries become one row that is broadcast; its size is bounded by their number.
    """
    asked = queries.orderBy("variant").limit(MAX_VARIANTS).agg(F.sort_array(F.collect_list(F.struct("variant", "weight", "q"))).alias("qs"))
    one = vectors.join(F.broadcast(asked)).select(*vectors.columns, F.explode("qs").alias("v")).select(*vectors.columns, "v.variant", "v.weight", "v.q")
    return one.withColumn("score", F.when(F.col(vector).isNull(), F.lit(-1.0)).otherwise(cosine(F.col(vector), F.col("q")))).drop("q")


def top_k(hits: DataFrame, k: int, by: list[str], order: list[Column]) -> DataFrame:
    """The first k rows of each group; Spark limits groups before the shuffle, so k rows a task travel."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= max(1, min(MAX_K, k)))


def signature(path: Column, lines: Column, content: Column) -> Column:
    return F.concat_ws("::", path, F.coalesce(lines, F.lit("")), squeeze(F.substring(content, 1, 120)))


def rerank(hits: DataFrame) -> DataFrame:
    """hits(ord, path, content, lines, score, variant, weight) with combined_score and position.

    Bonuses: log2(1 + occurrences of the hit) * 0.08, 0.05 if the original query found it, (weight - 0.5) * 0.05.
    """
    same = Window.partitionBy("_signature")
    h = hits.withColumn("_signature", signature(F.col("path"), F.col("lines"), F.col("content"))).withColumn("_base", F.coalesce("score", F.lit(0.0)))
    bonus = F.log2(1 + F.count("*").over(same)) * 0.08 + F.when(F.max((F.col("variant") == 0).cast("int")).over(same) == 1, 0.05).otherwise(0.0) + (F.col("weight") - 0.5) * 0.05
    h = h.withColumn("combined_score", F.col("_base") + bonus)
    first = F.when(F.col("lines").rlike(r"\d"), F.regexp_extract("lines", r"(\d+)", 1).cast("long")).otherwise(F.lit(2**53 - 1))
    w = Window.orderBy(F.col("combined_score").desc(), F.col("_base").desc(), "path", first, "ord")
    return h.withColumn("position", F.row_number().over(w)).drop("_signature", "_base")


def suppress_overlap(hits: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Of hits(ord, path, content, lines, score) those that no better hit of their path covers.

    A greedy walk from the best score: a hit goes if a kept one overlaps it by `threshold` of the shorter range, or, where
    one has no range, if the texts are equal but for white space. Suppressed hits suppress nothing. A path's hits are one
    array; they come from top-K lists, so there are few.
    """
    h = hits.withColumn("_r", line_range(F.col("lines"))).withColumn("_c", squeeze(F.col("content")))
    row = F.struct((-F.coalesce("score", F.lit(0.0))).alias("_s"), "ord", "_r", "_c", F.struct(*hits.columns).alias("_row"))
    groups = h.groupBy(F.coalesce("path", F.lit("")).alias("_p")).agg(F.sort_array(F.collect_list(row)).alias("_hits"))
    kept = F.aggregate(
        "_hits",
        F.slice("_hits", 1, 0),
        lambda a, x: F.when(
            F.exists(a, lambda y: F.when(x["_r"].isNotNull() & y["_r"].isNotNull(), overlap(x["_r"], y["_r"]) >= threshold).otherwise(x["_c"] == y["_c"])), a
        ).otherwise(F.array_append(a, x)),
    )
    return groups.select(F.explode(kept).alias("k")).select("k._row.*")


def best_per_path(hits: DataFrame) -> DataFrame:
    """The best hit of each path, the earliest of equal ones."""
    best = F.max_by(F.struct(*hits.columns), F.struct(F.coalesce("score", F.lit(0.0)), -F.col("ord")))
    return hits.groupBy("path").agg(best.alias("b")).select("b.*")


def file_relevance(hits: DataFrame) -> DataFrame:
    return hits.groupBy("path").agg(F.max(F.coalesce("score", F.lit(0.0))).alias("relevance"), F.count("*").alias("hits"))


def within_budget(items: DataFrame, budget: int, by: list[str], order: list[Column], tokens: str = "tokens") -> DataFrame:
    """Items of each group up to the first that would pass the token budget."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("used", F.sum(tokens).over(w)).where(F.col("used") <= budget)


def retrieve(hits: DataFrame, k: int = 10, dedupe: bool = True) -> DataFrame:
    """Dedupe, then rerank, then the first k."""
    return rerank(suppress_overlap(hits) if dedupe else hits).where(F.col("position") <= max(1, min(MAX_K, k)))


#: What the first words of a snippet make it.
CODE_TYPES = [
    (r"^(export\s+)?(async\s+)?function\s+\w+", "function"),
    (r"^(export\s+)?(abstract\s+)?class\s+\w+", "class"),
    (r"^(export\s+)?interface\s+\w+", "interface"),
    (r"^(export\s+)?type\s+\w+", "type"),
    (r"^(export\s+)?const\s+\w+", "constant"),
    (r"^import\s+", "import"),
    (r"^(export\s+)?enum\s+\w+", "enum"),
    (r"^/\*\*", "documentation"),
    (r"^(describe|it|test)\s*\(", "test"),
]
#: How much a line of a snippet counts.
LINE_PRIORITIES = [
    (r"^\s*(export\s+)?(async\s+)?function\s+\w+", 10),
    (r"^\s*(export\s+)?(abstract\s+)?class\s+\w+", 10),
    (r"^\s*(export\s+)?interface\s+\w+", 9),
    (r"^\s*(export\s+)?type\s+\w+", 8),
    (r"^\s*export\s+(const|let|var)\s+", 7),
    (r"^\s*import\s+", 5),
    (r"^\s*\*|^\s*/\*\*", 4),
    (r"\S", 1),
]


def _first(rules: list, text: Column, other) -> Column:
    out = F.lit(other)
    for pattern, value in reversed(rules):
        out = F.when(text.rlike(pattern), F.lit(value)).otherwise(out)
    return out


def code_type(content: Column) -> Column:
    return _first(CODE_TYPES, squeeze(F.substring(content, 1, 400)), "code")


def smart_snippet(content: Column, budget: int) -> Column:
    """The text if it fits; else its weightiest lines up to the first that doesn't fit, in order, gaps marked."""
    rows = F.transform(F.split(content, "\n", -1), lambda x, i: F.struct((-_first(LINE_PRIORITIES, x, 0)).alias("p"), i.alias("i"), x.alias("line")))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(False).alias("full"), F.slice(rows, 1, 0).alias("kept"))

    def take(a: Column, x: Column) -> Column:
        used = a["used"] + token_estimate(F.concat(x["line"], F.lit("\n")))
        full = a["full"] | (used > budget)
        return F.struct(F.when(full, a["used"]).otherwise(used).alias("used"), full.alias("full"), F.when(full, a["kept"]).otherwise(F.array_append(a["kept"], x)).alias("kept"))

    kept = F.aggregate(F.array_sort(rows), start, take, lambda a: F.array_sort(F.transform(a["kept"], lambda x: F.struct(x["i"].alias("i"), x["line"].alias("line")))))
    text = F.aggregate(
        kept,
        F.struct(F.lit(-1).alias("last"), F.lit("").alias("out")),
        lambda a, x: F.struct(x["i"].alias("last"), F.concat(a["out"], F.when((a["last"] != -1) & (x["i"] > a["last"] + 1), "\n// ... (lines omitted) ...\n").otherwise(""), x["line"], F.lit("\n")).alias("out")),
        lambda a: F.regexp_replace(a["out"], r"^\s+|\s+$", ""),
    )
    return F.when(token_estimate(content) <= budget, content).otherwise(text)


def file_summary(path: Column, types: Column) -> Column:
    """What a file is for, by its path, and what its snippets hold (the first three distinct types)."""
    from tessera.functions.text import basename, dirname, strip_extension

    name, folder = strip_extension(basename(path)), dirname(path)
    where = (
        F.when(folder.contains("test") | name.contains(".test") | name.contains(".spec"), F.concat(F.lit("Test file for "), F.regexp_replace(name, r"\.(test|spec)$", "")))
        .when(folder.contains("types") | name.contains("types"), "Type definitions")
        .when(folder.contains("utils") | name.contains("util"), "Utility functions")
        .when(folder.contains("components"), F.concat(F.lit("UI component: "), name))
        .when(folder.contains("hooks"), F.concat(F.lit("React hook: "), name))
        .when(folder.contains("api") | folder.contains("routes"), F.concat(F.lit("API endpoint: "), name))
        .when(name == "index", F.concat(F.lit("Entry point for "), folder))
        .otherwise(F.concat(name, F.lit(" module")))
    )
    return F.concat(where, F.when(F.size(types) > 0, F.concat(F.lit(" (contains: "), F.array_join(F.slice(F.array_distinct(types), 1, 3), ", "), F.lit(")"))).otherwise(""))


def context_bundle(hits: DataFrame, budget: int = 8000, max_files: int = 5, floor: float = 0.3) -> DataFrame:
    """(path, relevance, file_rank, snippets, tokens) of the best files within the budget.

    Hits under the floor go; files rank by their best hit; a file has floor(budget / max_files) tokens, its snippets an
    equal part each, up to the first that doesn't fit; files are taken up to the first that passes the whole budget.
    """
    per_file = math.floor(budget / max_files)
    h = hits.where(F.coalesce("score", F.lit(0.0)) >= floor)
    files = file_relevance(h).withColumn("file_rank", F.row_number().over(Window.orderBy(F.col("relevance").desc(), "path"))).where(F.col("file_rank") <= max_files)
    rows = h.join(files, "path").withColumn("part", F.floor(F.lit(per_file) / F.col("hits")))
    cut = rows.withColumn("snippet", F.when(token_estimate(F.col("content")) <= F.col("part"), F.col("content")).otherwise(F.substring(F.col("content"), F.lit(1), (F.col("part") * 4).cast("int"))))
    cut = within_budget(cut.withColumn("tokens", token_estimate(F.col("snippet"))), per_file, ["path"], [F.col("score").desc(), F.col("ord")])
    by_file = cut.groupBy("path", "relevance", "file_rank").agg(F.count("*").alias("snippets"), F.sum("tokens").alias("tokens"))
    return within_budget(by_file.withColumn("_all", F.lit(0)), budget, ["_all"], [F.col("file_rank")]).select("path", "relevance", "file_rank", "snippets", "tokens")


def hints(files: DataFrame, snippets: DataFrame, most: int = 4) -> DataFrame:
    """(bundle, hint, value, n): files(bundle, extension) by extension ("unknown" without one), and snippets(bundle,
    code_type) by type, the `most` frequent ones; ties by name."""
    e = files.groupBy("bundle", F.coalesce(F.when(F.col("extension") != "", F.col("extension")), F.lit("unknown")).alias("value")).agg(F.count("*").alias("n")).select("bundle", F.lit("extension").alias("hint"), "value", "n")
    t = snippets.where("code_type <> ''").groupBy("bundle", F.col("code_type").alias("value")).agg(F.count("*").alias("n"))
    t = t.withColumn("_n", F.row_number().over(Window.partitionBy("bundle").orderBy(F.col("n").desc(), "value"))).where(F.col("_n") <= most)
    return e.unionByName(t.select("bundle", F.lit("code_type").alias("hint"), "value", "n"))


def memory_hits(hits: DataFrame, folder: str = ".memories/") -> DataFrame:
    """Hits that lie in the folder of memories."""
    return hits.where(F.col("path").startswith(folder))


def score_percent(score: Column) -> Column:
    return F.concat(F.round(score * 100, 0).cast("int").cast("string"), F.lit("%"))
