"""Operator 5: quality rules as one projection compiled from a threshold table.

Every metric and every rule is a Column over the row's own text, so the whole operator is one scan without a shuffle,
however the sources are skewed. No user functions.

Defined results: null or empty texts have no words, every count is 0 and base_failed is true (fewer than 20 words);
repeated rows are judged one by one; an empty table gives an empty result; `judge` leaves all columns but `quality` alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import SPACE_CHARS, spread, table, words

#: Frequent function words of the corpus' languages.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "on", "with", "as", "are", "was", "by", "this", "be", "at"],
    "fr": ["le", "la", "les", "de", "des", "et", "un", "une", "du", "en", "que", "qui", "dans", "pour", "par", "sur", "au", "pas"],
    "de": ["der", "die", "das", "und", "in", "von", "zu", "mit", "den", "ein", "eine", "ist", "auf", "nicht", "dem", "als", "auch", "für"],
    "es": ["el", "la", "los", "las", "de", "que", "y", "en", "un", "una", "del", "por", "con", "para", "se", "al", "es", "su"],
}


@dataclass(frozen=True)
class Rule:
    """A document fails if metric (a name of `metrics`) is below `least` or above `most`."""

    metric: str
    least: float | None = None
    most: float | None = None


#: Length, symbol, stop-word and line ratios; a null ratio (nothing to divide by) passes.
RULES = [
    Rule("mean_word_chars", least=2.0, most=20.0),
    Rule("symbol_ratio", most=0.25),
    Rule("stop_ratio", least=0.02),
    Rule("dup_line_ratio", most=0.5),
    Rule("bar_ratio", most=0.25),
]


def n_symbols(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))


def repeated_words(w: Column, k: int = 8) -> Column:
    """Number of words inside k-word windows that occur twice or more in the array w, the first occurrence included.

    Windows are compared by 64-bit hashes. A text whose windows all differ stops after a hash-set test; otherwise the
    (hash, place) pairs are sorted, equal neighbours give the places, and gaps between places give the cover.
    """
    none = F.lit(0).cast("long")

    def places(own: Column) -> Column:
        return F.slice(F.transform(own, lambda x, i: F.xxhash64(x, *(F.get(own, i + j) for j in range(1, k)))), 1, F.size(own) - (k - 1))


    def cover(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def at(s: Column) -> Column:
            last = F.size(s) - 1
            same = lambda i, j: F.get(s, i)["h"] == F.get(s, j)["h"]
            flag = lambda x, i: ((i > 0) & same(i, i - 1)) | ((i < last) & same(i, i + 1))
            return F.sort_array(F.transform(F.filter(s, flag), lambda x: x["i"]))

        spans = lambda p: F.aggregate(
            p, F.struct(none.alias("n"), F.lit(-k).alias("at")), lambda a, x: F.struct((a["n"] + F.least(F.lit(k), x - a["at"])).alias("n"), x.alias("at")), lambda a: a["n"]
        )
        return let(let(pairs, at), spans)

    # the later of two equal windows repeats k words
    few = (F.size(w) < 2 * k) & (F.size(w) - F.size(F.array_distinct(w)) < k)
    hashed = let(F.transform(w, lambda x: F.xxhash64(x)), places)
    return F.when((F.size(w) < k) | few, none).otherwise(let(hashed, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(cover(h))))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once: a one-element transform binds it as a lambda variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def metrics(text: Column) -> Column:
    """Struct of base counts and of the ratios that rules may name, each part evaluated once."""
    t = F.coalesce(text, F.lit(""))
    stop = sorted({x + end for v in STOP_WORDS.values() for x in v for end in ("", *".,;:!?")})
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE_CHARS))) > 0)
    ratio = lambda a, b: F.when(b > 0, a / b)

    def counts(w: Column, ls: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.concat_ws("", w)).cast("long").alias("word_chars"),
            n_symbols(t).cast("long").alias("n_symbols"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
            F.size(ls).cast("long").alias("n_lines"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(stop))).cast("long").alias("n_stop"),
            F.size(F.filter(w, lambda x: x == "|")).cast("long").alias("n_bars"),
        )

    def all_of(q: Column) -> Column:
        base = [q[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
        return F.struct(
            *base,
            ratio(q["word_chars"], q["n_words"]).alias("mean_word_chars"),
            ratio(q["n_symbols"], q["word_chars"]).alias("symbol_ratio"),
            ratio(q["n_stop"], q["n_words"]).alias("stop_ratio"),
            ratio(q["n_dup_lines"], q["n_lines"]).alias("dup_line_ratio"),
            ratio(q["n_bars"], q["n_words"]).alias("bar_ratio"),
        )

    return let(let(words(text), lambda w: let(lines, lambda ls: counts(w, ls))), all_of)


def base_failed(q: Column) -> Column:
    return (q["n_words"] < 20) | (100 * q["n_repeat_words"] > 30 * q["n_words"])


def verdict(q: Column, rules: list[Rule] = RULES) -> Column:
    """Names of the failed rules, compiled from the table."""
    failed = []
    for r in rules:
        bad = F.lit(False)
        if r.least is not None:
            bad = bad | F.coalesce(q[r.metric] < r.least, F.lit(False))
        if r.most is not None:
            bad = bad | F.coalesce(q[r.metric] > r.most, F.lit(False))
        failed.append(F.when(bad, F.lit(r.metric)))
    return F.array_compact(F.array(*failed))


def passes(text: Column, rules: list[Rule] = RULES) -> Column:
    """The whole decision as one expression, so that a filter, wherever the optimiser puts it, counts once."""
    return let(metrics(text), lambda q: ~base_failed(q) & (F.size(verdict(q, rules)) == 0))


def judge(docs: DataFrame, rules: list[Rule] = RULES, text: str = "text") -> DataFrame:
    """docs with the struct `quality` (replacing a column of that name): q (metrics), base_failed, failed_rules and kept.

    One expression, so that a filter, wherever the optimiser puts it, counts once.
    """

    def told(q: Column) -> Column:
        def verdicts(failed: Column) -> Column:
            return F.struct(q.alias("q"), base_failed(q).alias("base_failed"), failed.alias("failed_rules"), (~base_failed(q) & (F.size(failed) == 0)).alias("kept"))

        return let(verdict(q, rules), verdicts)

    return docs.withColumn("quality", let(metrics(F.col(text)), told))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judge(docs).select("doc_id", *(F.col(f"quality.q.{k}") for k in base), "quality.base_failed", "quality.kept")


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, with their own columns."""
    return docs.where(passes(F.col("text")))


_STOP_SQL = "|".join(sorted({x for v in STOP_WORDS.values() for x in v}))
#: The same rules for DuckDB, over a relation {docs} with doc_id and text.
QUALITY_SQL = r"""
w AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM {docs}),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
g AS (SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, sum(least(8, d)) AS n FROM (SELECT doc_id, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i), 8) AS d FROM r) GROUP BY doc_id),
m AS (
  SELECT l.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
    len(ls) AS n_lines, len(list_filter(w, lambda x: regexp_full_match(lower(x), '({stop})[.,;:!?]?'))) AS n_stop, len(list_filter(w, lambda x: x = '|')) AS n_bars
  FROM l LEFT JOIN c USING (doc_id)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
quality AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(word_chars::DOUBLE / nullif(n_words, 0) < 2 OR word_chars::DOUBLE / nullif(n_words, 0) > 20, false)
    AND NOT coalesce(n_symbols::DOUBLE / nullif(word_chars, 0) > 0.25, false) AND NOT coalesce(n_stop::DOUBLE / nullif(n_words, 0) < 0.02, false)
    AND NOT coalesce(n_dup_lines::DOUBLE / nullif(n_lines, 0) > 0.5, false) AND NOT coalesce(n_bars::DOUBLE / nullif(n_words, 0) > 0.25, false) AS kept FROM v)
""".replace("{stop}", _STOP_SQL)  # fmt: skip

QUERIES = {"op5_quality_rules": op5_quality_rules}
ORACLES = {"op5_quality_rules": f"WITH {QUALITY_SQL.replace('{docs}', 'documents')} SELECT * FROM quality"}
