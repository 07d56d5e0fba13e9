"""Text, path and label scalars. All are Column expressions; whitespace is trimmed as Unicode white space."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say nothing about a query, and the rewrites of its other words.
STOPWORDS = ["a", "an", "the", "and", "or", "to", "for", "of", "in", "on", "with", "by", "is", "are", "be", "from", "at", "as", "it", "this", "that", "these", "those", "how", "what", "where", "when", "why"]
SYNONYMS = {
    "auth": ["authentication", "authorization"], "login": ["sign-in", "signin"], "log": ["logging"], "config": ["configuration"],
    "cfg": ["configuration"], "db": ["database"], "repo": ["repository"], "svc": ["service"], "util": ["utility"],
    "api": ["endpoint"], "err": ["error"], "msg": ["message"],
}
#: Language of a file extension, as the parser tells them.
PARSER_LANGUAGE = {
    ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".py": "python", ".pyi": "python", ".go": "go", ".rs": "rust", ".java": "java", ".kt": "java", ".scala": "java",
    ".c": "c", ".cpp": "c", ".cc": "c", ".h": "c", ".hpp": "c", ".cs": "csharp", ".rb": "ruby", ".php": "php",
}


def trim(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def squeeze(s: Column) -> Column:
    """White space runs to one blank, none at the ends."""
    return trim(F.regexp_replace(s, r"(?U)\s+", " "))


def lines(s: Column) -> Column:
    """Lines of a text; a final line break is followed by an empty line."""
    return F.split(s, "\n", -1)


def tokens(s: Column) -> Column:
    """Lower-case runs of a-z, 0-9 and underscore."""
    return F.regexp_extract_all(F.lower(s), F.lit("[a-z0-9_]+"), F.lit(0))  # splitting at all else costs three times as much


def core_tokens(s: Column) -> Column:
    return F.filter(tokens(s), lambda x: ~x.isin(STOPWORDS))


def token_estimate(s: Column) -> Column:
    return F.ceil(F.length(s) / 4).cast("long")


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision, 0 if either norm is 0."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when((norm(a) == 0) | (norm(b) == 0), F.lit(0.0)).otherwise(dot / (norm(a) * norm(b)))


def line_range(s: Column) -> Column:
    """struct(start, end) of the first `a-b` in a string; null if there is none or it ends before it starts."""
    a, b = (F.regexp_extract(s, r"(\d+)\s*-\s*(\d+)", k) for k in (1, 2))
    lo, hi = F.try_to_number(a, F.lit("999999999")).cast("int"), F.try_to_number(b, F.lit("999999999")).cast("int")
    return F.when(F.length(a).between(1, 9) & F.length(b).between(1, 9) & (lo <= hi), F.struct(lo.alias("start"), hi.alias("end")))


def overlap(a: Column, b: Column) -> Column:
    """Common lines over the shorter of two line ranges."""
    both = F.greatest(F.lit(0), F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"]) + 1)
    return both / F.least(a["end"] - a["start"] + 1, b["end"] - b["start"] + 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def dirname(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def strip_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", "")


def normal_path(path: Column) -> Column:
    """The path without `.` and with `..` taken back; what would climb out of the root is dropped."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    none = F.array().cast("array<string>")
    folded = F.aggregate(parts, none, lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, x)))
    return F.array_join(folded, "/")


def parser_language(path: Column) -> Column:
    pairs = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in PARSER_LANGUAGE.items()))
    return F.coalesce(pairs[extension(path)], F.lit("unknown"))


def relevance_label(score: Column) -> Column:
    return F.when(score >= 0.8, "🔥 High").when(score >= 0.6, "✅ Good").when(score >= 0.4, "📊 Moderate").otherwise("📌 Low")


def human_bytes(n: Column) -> Column:
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1024 * 1024, F.format_string("%.1f KB", n / 1024)).otherwise(F.format_string("%.1f MB", n / (1024 * 1024)))


def shorten(s: Column, n: int, mark: str = "...") -> Column:
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n), F.lit(mark))).otherwise(s)


def is_binary(s: Column) -> Column:
    """Whether control characters (but tab, line feed, carriage return) make up over a tenth of a text, or it has a NUL."""
    control = F.length(s) - F.length(F.regexp_replace(s, r"[\x00-\x08\x0E-\x1F]", ""))
    return F.coalesce(s.contains("\x00") | (control > 0.1 * F.length(s)), F.lit(False))


def repository(url: Column) -> Column:
    """struct(owner, repo) of a hosting URL; the repository stops at the first dot."""
    pattern = r"github\.com[:/]([^/]+)/([^/.]+)"
    return F.when(url.rlike(pattern), F.struct(F.regexp_extract(url, pattern, 1).alias("owner"), F.regexp_extract(url, pattern, 2).alias("repo")))


def is_stale(last: Column, now: Column, hours: int = 24) -> Column:
    """Whether a table was never indexed, at an unreadable time, or more than `hours` ago."""
    at = F.try_to_timestamp(last)
    return F.when(at.isNull(), F.lit(True)).otherwise(F.unix_timestamp(now) - F.unix_timestamp(at) > hours * 3600)


def plan_name(goal: Column) -> Column:
    """Title from a goal: the letters, digits and blanks of its first 50 characters, each word with a capital; null if
    nothing is left."""
    cleaned = trim(F.regexp_replace(F.substring(goal, 1, 50), r"[^a-zA-Z0-9\s]", ""))
    return F.when(cleaned != "", F.array_join(F.transform(F.split(cleaned, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 50)))), " "))


def finding_hash(columns: list[Column]) -> Column:
    """16 hex digits over the parts that are there, in order."""
    return F.substring(F.sha2(F.concat_ws("|", *columns), 256), 1, 16)


def glob_regex(glob: str) -> str:
    """A path glob (`*`, `**`, `?`, `[..]`, `{a,b}`) as an anchored regular expression; dots count like other letters."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "[" and "]" in glob[i + 1 :]:
            j = glob.index("]", i + 1)
            out, i = out + "[" + glob[i + 1 : j].replace("!", "^", 1).replace("\\", "\\\\") + "]", j + 1
            continue
        if c == "{":
            depth += 1
        out += {"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")" if depth else r"\}", ",": "|" if depth else ","}.get(c) or ("\\" + c if c in r".+()^$|\\" else c)
        if c == "}" and depth:
            depth -= 1
        i += 1
    return f"^{out}$"


def _hashed_codes(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint"))


def hashed_places(text: Column, dims: int = 64) -> Column:
    """The places at which `hashed_counts` has the words of a text."""
    return F.array_distinct(F.transform(_hashed_codes(text), lambda c: F.pmod(c, F.lit(dims))))


def hashed_counts(text: Column, dims: int = 64) -> Column:
    """Whole numbers of a text: each word (letters and digits, lower case) adds or takes one at a place that its md5 tells."""

    def summed(cs: Column) -> Column:
        at = lambda d: F.aggregate(F.filter(cs, lambda c: F.pmod(c, F.lit(dims)) == d), F.lit(0), lambda a, c: a + F.when(F.pmod(F.floor(c / dims), F.lit(2)) == 0, 1).otherwise(-1))
        return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), at)

    return F.get(F.transform(F.array(_hashed_codes(text)), summed), F.lit(0))


def round_half(x: Column, digits: int) -> Column:
    """x rounded as SQL engines in C do: the scaled double to the nearest whole number, not its decimal digits."""
    return F.round(x * 10.0**digits, 0) / 10.0**digits


def hashed_vector(text: Column, dims: int = 64) -> Column:
    """Vector of a text without a model: its `hashed_counts`, then the length is 1 (all 0 without words). A stand-in where no
    embedding model is at hand; see `embed_with`."""

    def scaled(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint") * x).cast("double"))
        return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(0.0))

    return F.get(F.transform(F.array(hashed_counts(text, dims)), scaled), F.lit(0))


def embed_with(model: Callable[[list[str]], list[list[float]]]) -> Callable[[Column], Column]:
    """A column function of a model that turns a list of texts into vectors: Arrow batches, null texts as empty."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(model([x or "" for x in texts]))

    return run
