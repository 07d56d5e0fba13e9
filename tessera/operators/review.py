"""Review of unified diffs: parsing, classification, risk, policy rules, findings, reports."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import glob_regex

_LINE = "diff_id int, file_no int, old_path string, new_path string, is_new boolean, is_deleted boolean, is_binary boolean, hunk int, old_start int, old_lines int, new_start int, new_lines int, pos int, type string, content string, old_line int, new_line int"
_ARROW = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
BATCH = 8192
_FILE = re.compile(r"^diff --git a/(.+?) b/(.+?)$", re.M)
_HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", re.M)


def _sections(pattern: re.Pattern, text: str) -> Iterator[tuple[re.Match, str]]:
    found = list(pattern.finditer(text))
    ends = [x.start() for x in found[1:]] + [len(text)]
    for m, end in zip(found, ends, strict=False):
        yield m, text[m.start() : end]


def _diff_rows(diff_id, text: str, phantom: bool) -> Iterator[tuple]:
    for no, (f, part) in enumerate(_sections(_FILE, text)):
        head = (diff_id, no, f[1], f[2], "new file mode" in part, "deleted file mode" in part, "Binary files" in part)
        any_hunk = False
        for h, (m, body) in enumerate(_sections(_HUNK, part)):
            any_hunk = True
            old, new = int(m[1]), int(m[3])
            span = (h, old, int(m[2] or 1), new, int(m[4] or 1))
            rows = body.split("\n")[1:]
            if not phantom and rows and rows[-1] == "":
                rows.pop()
            for pos, x in enumerate(rows):
                kind = {"+": "add", "-": "remove", " ": "context", "": "context"}.get(x[:1])
                if kind is None:
                    continue
                yield *head, *span, pos, kind, x[1:], None if kind == "add" else old, None if kind == "remove" else new
                old, new = old + (kind != "add"), new + (kind != "remove")
        if not any_hunk:
            yield *head, *[None] * 10


def diff_lines(diffs: DataFrame, phantom: bool = True) -> DataFrame:
    """One row for each line of each hunk of diffs(diff_id, diff); a file without hunks has one row of nulls.

    A blank line is context, so the line break at the end of a hunk makes one; `phantom` false leaves it out.
    """
    schema = _LINE.replace("diff_id int", f"diff_id {dict(diffs.dtypes)['diff_id']}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            types = [b.schema.field("diff_id").type, *(_ARROW[c.split()[1]] for c in _LINE.split(", ")[1:])]
            made = pa.schema([(c.split()[0], t) for c, t in zip(_LINE.split(", "), types, strict=True)])
            told = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], schema=made)
            rows: list[tuple] = []
            for i, text in zip(b.column("diff_id").to_pylist(), b.column("diff").to_pylist(), strict=True):
                for row in _diff_rows(i, text or "", phantom):
                    rows.append(row)
                    if len(rows) == BATCH:
                        yield told(rows)
                        rows = []
            if rows:
                yield told(rows)

    return diffs.select("diff_id", "diff").mapInArrow(run, schema)


def diff_stats(lines: DataFrame) -> DataFrame:
    return lines.groupBy("diff_id").agg(F.countDistinct("file_no").alias("files"), F.count_if(F.col("type") == "add").alias("added"), F.count_if(F.col("type") == "remove").alias("removed"))


#: Kinds of paths, whatever the case.
DOCS = r"(?i)^docs/|(^|/)readme\.md$|\.(md|mdx|rst|txt)$"
INFRA = r"(?i)^\.github/|^scripts/|^infra/|^package(-lock)?\.json$|^tsconfig(\.test)?\.json$|^dockerfile$|^docker/|\.ya?ml$"
TESTS = r"(?i)^tests/|/__tests__/|\.(test|spec)\.(ts|js)$"
CONFIG = r"(?i)^package\.json$|^package-lock\.json$|^tsconfig(\..+)?\.json$|^\.github/|^dockerfile$|^docker/|^scripts/|\.ya?ml$"
BUGFIX = r"(?i)\b(fix|bug|error|null|undefined|regression|crash|leak)\b"
EXPORT = r"(?i)^\s*(export\s+|module\.exports\b|exports\.)"
HOTSPOTS = [
    ("src/mcp", r"(?i)^src/mcp/"),
    ("src/reactive", r"(?i)^src/reactive/"),
    ("src/internal", r"(?i)^src/internal/"),
    ("src/http", r"(?i)^src/http/"),
    ("auth", r"(?i)(^|/)(auth|oauth|jwt|token)(/|$)"),
    ("security", r"(?i)(^|/)(security|crypto|tls|ssl)(/|$)"),
]


def files_of(lines: DataFrame) -> DataFrame:
    """One row for each file of each diff, with its counts and changed lines."""
    keys = ["diff_id", "file_no", "old_path", "new_path", "is_new", "is_deleted", "is_binary"]
    added = F.col("type") == "add"
    return lines.groupBy(*keys).agg(
        F.count_if(added).alias("added"),
        F.count_if(F.col("type") == "remove").alias("removed"),
        F.count_if(added & F.col("content").rlike(BUGFIX)).alias("bugfix_lines"),
        F.count_if(F.col("type").isin("add", "remove") & F.col("content").rlike(EXPORT)).alias("export_lines"),
        F.array_sort(F.collect_set(F.when(added, F.col("new_line")))).alias("changed_lines"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(added, F.struct("hunk", "pos", "content")))), lambda x: x["content"]), "\n").alias("added_text"),
    )


def classify(files: DataFrame) -> DataFrame:
    """(diff_id, change): docs, infra, feature, bugfix or refactor, by the first rule that holds."""
    n, p = F.count("*"), F.col("new_path")
    g = files.groupBy("diff_id").agg(
        n.alias("n"),
        F.count_if(p.rlike(DOCS)).alias("docs"),
        F.count_if(p.rlike(INFRA)).alias("infra"),
        F.count_if(F.col("is_new") & ~p.rlike(DOCS)).alias("new"),
        F.sum("bugfix_lines").alias("bugfix"),
        F.count_if(p.rlike(TESTS)).alias("tests"),
        F.sum("added").alias("added"),
        F.sum("removed").alias("removed"),
    )
    churn = F.least("added", "removed") / F.greatest(F.lit(1), F.greatest("added", "removed"))
    change = (
        F.when(F.col("docs") == F.col("n"), "docs")
        .when((F.col("infra") > 0) & (F.col("infra") >= F.ceil(F.col("n") / 2)), "infra")
        .when(F.col("new") > 0, "feature")
        .when(F.col("bugfix") > 0, "bugfix")
        .when(F.col("tests") == F.col("n"), "refactor")
        .when((F.col("added") + F.col("removed") >= 20) & (churn >= 0.6), "refactor")
        .otherwise("feature")
    )
    return g.select("diff_id", change.alias("change"))


def preflight(files: DataFrame) -> DataFrame:
    """(diff_id, files, hotspots, flags, raw_risk, risk 1 to 5)."""
    p = F.col("new_path")
    hot = F.array_compact(F.array(*(F.when(p.rlike(r), F.lit(i)) for i, r in HOTSPOTS)))
    g = files.withColumn("_hot", hot).groupBy("diff_id").agg(
        F.count("*").alias("files"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("_hot")))).alias("hotspots"),
        (F.count_if(p.rlike(r"(?i)^src/index\.ts$|^src/mcp/tools/") | (F.col("export_lines") > 0)) > 0).alias("public_api"),
        (F.count_if(p.rlike(CONFIG)) > 0).alias("config"),
        (F.count_if(p.rlike(r"(?i)^tests/|/__tests__/|\.(test|spec)\.[jt]s$")) > 0).alias("tests"),
        (F.count_if("is_binary") > 0).alias("binary"),
        F.min_by("new_path", "file_no").alias("first_path"),
    )
    one = lambda c, x: F.when(c, F.lit(float(x))).otherwise(0.0)
    raw = 1.0 + one(F.col("files") > 10, 1) + F.size("hotspots") * 0.5 + one(F.col("public_api"), 1.5) + one(F.col("config"), 0.5) + one(~F.col("tests"), 1)
    return g.withColumn("raw_risk", raw).withColumn("risk", F.least(F.lit(5), F.greatest(F.lit(1), F.ceil("raw_risk"))).cast("int"))


def preflight_findings(checked: DataFrame, changes: DataFrame) -> DataFrame:
    """Findings (diff_id, ord, id, severity, category, confidence, title, file) that the flags call for."""
    c = checked.join(changes, "diff_id")
    item = lambda test, i, severity, category, confidence, title: F.when(test, F.struct(F.lit(i).alias("id"), F.lit(severity).alias("severity"), F.lit(category).alias("category"), F.lit(confidence).alias("confidence"), F.lit(title).alias("title")))
    items = F.array(
        item(~F.col("tests") & ~F.col("change").isin("docs", "infra"), "PRE001", "MEDIUM", "reliability", 0.95, "No tests appear to be touched by this change"),
        item(F.col("public_api"), "PRE002", "HIGH", "architecture", 0.9, "Possible public API surface change detected"),
        item(F.col("config"), "PRE003", "MEDIUM", "infra", 0.9, "Configuration or CI-related files changed"),
        item(F.col("binary"), "PRE004", "LOW", "maintainability", 0.85, "Binary file change detected in diff"),
        item(F.size("hotspots") > 0, "PRE005", "INFO", "maintainability", 0.9, "Hotspot paths detected"),
    )
    return c.select("diff_id", F.col("first_path").alias("file"), F.posexplode(F.array_compact(items)).alias("ord", "f")).select("diff_id", "ord", "f.*", "file")


def invariant_findings(files: DataFrame, rules: list[dict]) -> DataFrame:
    """Findings of policy rules {id, rule, paths, severity, category, action, deny, require, when} on added text.

    Rules come from a small configuration; each is one column of globs and patterns, so files are read once. deny: the
    pattern must not occur; require: it must; when_require: it must where `when` occurs.
    """

    def found(r: dict) -> Column:
        here = F.col("new_path").rlike("|".join(glob_regex(g) for g in r["paths"]))
        has = lambda k: F.col("added_text").rlike(r[k])
        fails = {"deny": lambda: has("deny"), "require": lambda: ~has("require"), "when_require": lambda: has("when") & ~has("require")}.get(r.get("action"), lambda: F.lit(False))()
        return F.when(here & fails, F.struct(F.lit(r["id"]).alias("id"), F.lit(r["severity"]).alias("severity"), F.lit(r["category"]).alias("category"), F.lit(0.95).alias("confidence"), F.lit(r["rule"][:80]).alias("title")))

    hits = F.array_compact(F.array(*map(found, rules)))
    return files.select("diff_id", "file_no", F.col("new_path").alias("file"), F.explode(hits).alias("f")).select("diff_id", "file_no", "f.*", "file")


def first_of_each(findings: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return findings.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def post_process(findings: DataFrame, threshold: float = 0.55, categories: list[str] | None = None, allow: list[str] | None = None, most: int = 20, by: list[str] | None = None) -> DataFrame:
    """Findings over the threshold, of the categories, not allowed by id; the first `most` by ord, of each diff where `by`
    names its key."""
    f = findings.where(F.col("confidence") >= threshold)
    if categories:
        f = f.where(F.col("category").isin(categories))
    if allow:
        f = f.where(~F.col("id").isin([x for x in allow if x]))
    if not by:
        return f.orderBy("ord").limit(most)
    return f.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("ord"))).where(F.col("_n") <= most).drop("_n")


RANK = {"CRITICAL": 5, "HIGH": 4, "MEDIUM": 3, "LOW": 2, "INFO": 1}


def severity_rank(c: Column) -> Column:
    out = F.lit(0)
    for k, v in RANK.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def failure_policy(findings: DataFrame, fail_on: str = "CRITICAL", forced: list[str] | None = None, by: list[str] | None = None, most: int = 20) -> DataFrame:
    """(by, should_fail, reasons), one row without `by`: ids that force a failure, and findings of the severity or above; the
    first `most` reasons, ranked before they are gathered."""
    force = F.col("id").isin([x for x in forced or [] if x])
    reason = F.when(force, F.concat(F.lit("Invariant "), "id", F.lit(" forced-fail"))).when(severity_rank(F.col("severity")) >= RANK.get(fail_on, 5), F.concat("severity", F.lit(" "), "id", F.lit(": "), "title"))
    said = findings.withColumn("_r", reason)
    gather = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "_r"))), lambda x: x["_r"]), "; ")
    if not by:
        first = said.where("_r is not null").orderBy("ord").limit(most)
        return first.agg((F.count("*") > 0).alias("should_fail"), gather.alias("reasons"))
    first = said.where("_r is not null").withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("ord"))).where(F.col("_n") <= most)
    told = first.groupBy(*by).agg(gather.alias("reasons"))
    return findings.select(*by).distinct().join(told, by, "left").select(*by, F.col("reasons").isNotNull().alias("should_fail"), F.coalesce("reasons", F.lit("")).alias("reasons"))


def _plain(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "^[ab]/", ""), r"^\.?/", "")


def on_changed_line(findings: DataFrame, files: DataFrame) -> DataFrame:
    """findings(ord, file, lo, hi, on_line) with on_line filled in where it is null: whether an added line is in the range.
    Findings with a diff_id are held against the files of their diff.

    An equi-join on the path, new before old; the array of changed lines is tested in place, so nothing is multiplied.
    """
    keys = ["diff_id"] if "diff_id" in findings.columns else []
    new = files.select(*keys, _plain(F.col("new_path")).alias("_p"), F.lit(0).alias("_o"), "changed_lines")
    both = new.unionByName(files.select(*keys, _plain(F.col("old_path")).alias("_p"), F.lit(1).alias("_o"), "changed_lines"))
    by_path = both.groupBy(*keys, "_p").agg(F.min_by("changed_lines", F.struct("_o", "changed_lines")).alias("changed_lines"))
    f = findings.withColumn("_p", _plain(F.col("file"))).join(by_path, [*keys, "_p"], "left")
    lo, hi = F.greatest(F.lit(1), F.least("lo", "hi")), F.greatest(F.lit(1), F.greatest("lo", "hi"))
    hit = F.exists("changed_lines", lambda x: (x >= lo) & (x <= hi))
    return f.withColumn("on_line", F.coalesce("on_line", hit, F.lit(False))).drop("_p", "changed_lines")


def on_line_only(findings: DataFrame) -> DataFrame:
    """Findings on changed lines, and all of priority 0; by priority."""
    return findings.where((F.col("priority") == 0) | F.col("on_line")).orderBy("priority", "ord")


def context_plan(files: DataFrame, checked: DataFrame, budget: int = 8000, most: int = 5) -> DataFrame:
    """(diff_id, file, priority, tokens, strategy): the weightiest files and their shares of the token budget."""
    prefix = F.lit(False)
    for i, r in HOTSPOTS[:4]:
        prefix = prefix | (F.array_contains("hotspots", i) & F.col("new_path").rlike(r))
    changed = F.col("added") + F.col("removed")
    one = lambda c, x: F.when(c, x).otherwise(0)
    p = 5 + one(changed > 50, 1) + one(F.col("is_new"), 2) - one(F.col("is_deleted"), 1) + one(prefix, 2) + one(F.col("public_api"), 1)
    f = files.join(checked.select("diff_id", "hotspots", "public_api"), "diff_id").withColumn("priority", F.greatest(F.lit(1), F.least(F.lit(10), p)))
    whole = Window.partitionBy("diff_id")
    f = f.withColumn("strategy", F.when((F.count("*").over(whole) <= 3) & (F.sum(changed).over(whole) <= 200), "broad").otherwise("focused")).where(~F.col("is_binary"))
    f = f.withColumn("place", F.row_number().over(Window.partitionBy("diff_id").orderBy(F.col("priority").desc(), "file_no"))).where(F.col("place") <= most)
    f = f.withColumn("tokens", F.greatest(F.lit(200), F.floor(F.lit(budget) * F.col("priority") / F.sum("priority").over(whole))))
    total = F.sum("tokens").over(whole)
    tokens = F.when(total > budget, F.greatest(F.lit(200), F.floor(F.col("tokens") * (F.lit(budget) / total)))).otherwise(F.col("tokens"))
    return f.withColumn("tokens", tokens.cast("long")).select("diff_id", F.col("new_path").alias("file"), "priority", "tokens", "strategy")


def merge_ranges(ranges: DataFrame, by: list[str]) -> DataFrame:
    """Ranges(lo, hi) of each key, those that touch or overlap made one: a gap opens where lo passes all before by 2."""
    w = Window.partitionBy(*by).orderBy("lo", "hi")
    r = ranges.where("lo <= hi").withColumn("_top", F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    r = r.withColumn("_island", F.sum((F.col("_top").isNull() | (F.col("lo") > F.col("_top") + 1)).cast("int")).over(w))
    return r.groupBy(*by, "_island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_island")


def context_sections(files: DataFrame, contents: DataFrame, around: int = 20, most_chars: int = 20_000) -> DataFrame:
    """(diff_id, file, lo, hi, section): numbered lines around the changes, ranges merged."""
    lines = contents.select(F.col("path").alias("file"), F.split("content", "\n", -1).alias("ls"))
    ch = files.select("diff_id", F.col("new_path").alias("file"), F.explode("changed_lines").alias("x")).join(lines.select("file", F.size("ls").alias("n")), "file")
    r = merge_ranges(ch.select("diff_id", "file", F.greatest(F.lit(1), F.col("x") - around).alias("lo"), F.least("n", F.col("x") + around).alias("hi")), ["diff_id", "file"])
    numbered = F.transform(F.sequence("lo", "hi"), lambda i: F.concat(F.lpad(i.cast("string"), 5, " "), F.lit("  "), F.coalesce(F.get("ls", i - 1), F.lit(""))))
    text = F.concat(F.lit("Path: "), "file", F.format_string("\nLines %d-%d\n", "lo", "hi"), F.array_join(numbered, "\n"))
    return r.join(lines, "file").select("diff_id", "file", "lo", "hi", F.when(F.length(text) > most_chars, F.concat(F.substring(text, 1, most_chars), F.lit("\n..."))).otherwise(text).alias("section"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """(ord, result): each finding(ord, id, severity, category, confidence, title, impact, recommendation, file, lo, hi) as a SARIF 2.1.0 result."""
    rule = F.regexp_replace("id", "[^A-Za-z0-9_.-]", "_")
    level = F.when(F.col("severity").isin("CRITICAL", "HIGH"), "error").when(F.col("severity") == "MEDIUM", "warning").otherwise("note")
    where = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.col("lo").alias("startLine"), F.coalesce("hi", "lo").alias("endLine")).alias("region")).alias("physicalLocation"))
    text = F.concat("title", F.lit("\n\nImpact: "), "impact", F.lit("\n\nRecommendation: "), "recommendation")
    made = F.struct(rule.alias("ruleId"), level.alias("level"), F.struct(text.alias("text")).alias("message"), F.array(where).alias("locations"), F.struct("id", "category", "severity", "confidence").alias("properties"))
    return findings.select("ord", F.to_json(made).alias("result"))


def sarif_rules(findings: DataFrame) -> DataFrame:
    """(id, rule): one rule for each id, from its first finding."""
    rule = F.regexp_replace("id", "[^A-Za-z0-9_.-]", "_")
    made = F.struct(rule.alias("id"), rule.alias("name"), F.struct(F.col("title").alias("text")).alias("shortDescription"), F.struct(F.col("recommendation").alias("text")).alias("fullDescription"), F.struct("category", "severity", "confidence").alias("properties"))
    return first_of_each(findings, ["id"], [F.col("ord")]).select("id", F.to_json(made).alias("rule"))


def finding_hash(findings: DataFrame, lines: bool = True, message: bool = True) -> DataFrame:
    """findings with `hash`: sha-256 over path, category, severity and, as asked for, rule, lines and message."""
    said = F.lower(F.regexp_replace(F.regexp_replace("message", r"\s+", " "), "^ | $", ""))
    parts = [F.col("file"), F.col("category"), F.col("severity"), F.when(F.col("rule") != "", F.col("rule"))]
    parts += [F.col("lo").cast("string"), F.col("hi").cast("string")] if lines else []
    parts += [said] if message else []
    return findings.withColumn("hash", F.sha2(F.concat_ws("|", *parts), 256))


def review_chunks(files: DataFrame, threshold: int = 15, size: int = 10) -> DataFrame:
    """files(diff_id, ord, path) with `chunk`: slices of `size` where a diff has more than `threshold` files."""
    n = F.count("*").over(Window.partitionBy("diff_id"))
    rank = F.row_number().over(Window.partitionBy("diff_id").orderBy("ord"))
    return files.withColumn("chunk", F.when(n > threshold, F.floor((rank - 1) / size)).otherwise(0).cast("int"))


def adaptive_timeout(n: Column, workers: int = 3, per_file: int = 60_000, buffer: float = 1.5, least: int = 300_000, most: int = 3_600_000) -> Column:
    """Milliseconds for n files: batches of the workers, a buffer and two minutes, within bounds."""
    return F.round(F.greatest(F.lit(least), F.least(F.lit(most), F.ceil(n / workers) * per_file * buffer + 120_000))).cast("long")


def parse_tsc(outputs: DataFrame) -> DataFrame:
    """(id, ord, file, line, col, code, message) of compiler errors in outputs(id, output)."""
    p = r"^(.+?)\((\d+),(\d+)\):\s+error\s+TS(\d+):\s+(.*)$"
    t = outputs.select("id", F.posexplode(F.split("output", "\r?\n")).alias("ord", "raw")).withColumn("raw", F.trim("raw")).where(F.col("raw").rlike(p))
    part = lambda k: F.regexp_extract("raw", p, k)
    return t.select("id", "ord", part(1).alias("file"), part(2).cast("int").alias("line"), part(3).cast("int").alias("col"), F.concat(F.lit("TS"), part(4)).alias("code"), F.trim(part(5)).alias("message")).where("message <> ''")


def parse_semgrep(outputs: DataFrame, most: int = 20) -> DataFrame:
    """(id, finding, severity, file, lo, hi, message) of scanner JSON in outputs(id, output); unreadable JSON has none."""
    schema = "struct<results array<struct<check_id string, path string, start struct<line int>, `end` struct<line int>, extra struct<message string, severity string>>>>"
    r = outputs.select("id", F.posexplode(F.slice(F.from_json("output", schema)["results"], 1, most)).alias("i", "r"))
    s = F.upper(F.coalesce("r.extra.severity", F.lit("")))
    level = F.when(s.isin("ERROR", "CRITICAL"), "CRITICAL").when(s.isin("WARNING", "HIGH"), "HIGH").when(s.isin("INFO", "LOW"), "LOW").otherwise("MEDIUM")
    name = F.coalesce("r.check_id", F.concat(F.lit("unknown-"), (F.col("i") + 1).cast("string")))
    lo = F.coalesce("r.start.line", F.lit(1))
    return r.select("id", F.concat(F.lit("SEMGREP-"), name, F.lit("-"), (F.col("i") + 1).cast("string")).alias("finding"), level.alias("severity"), F.coalesce("r.path", F.lit("(unknown file)")).alias("file"), lo.alias("lo"), F.coalesce("r.end.line", lo).alias("hi"), F.coalesce("r.extra.message", F.lit("Semgrep finding")).alias("message"))


def parse_model_findings(replies: DataFrame) -> DataFrame:
    """(id, finding, severity, title, evidence) of replies(id, reply): JSON from a fence, or from the first brace to the last.

    Findings without id, severity or title go; five pieces of evidence stay.
    """
    fence = F.regexp_extract("reply", r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    body = F.when(fence != "", fence).otherwise(F.regexp_extract("reply", r"(?s)(\{.*\})", 1))
    parsed = F.from_json(body, "struct<findings array<struct<id string, severity string, title string, evidence array<string>>>>")
    f = replies.select("id", F.explode(parsed["findings"]).alias("f")).where("f.id is not null and f.severity is not null and f.title is not null")
    return f.select("id", F.col("f.id").alias("finding"), "f.severity", "f.title", F.array_join(F.slice(F.coalesce("f.evidence", F.array().cast("array<string>")), 1, 5), "; ").alias("evidence"))


def exclude_files(files: DataFrame, patterns: list[str]) -> DataFrame:
    """files without those whose new or old path fits a pattern; `*` stands for anything, all else is a regular expression."""
    fits = F.lit(False)
    for p in patterns:
        whole = "^(?:" + p.replace("*", ".*") + ")$"
        fits = fits | F.coalesce(F.col("new_path").rlike(whole), F.lit(False)) | F.coalesce(F.col("old_path").rlike(whole), F.lit(False))
    return files.where(~fits)


def noise_gate(checked: DataFrame, invariants: DataFrame, force: bool = False) -> DataFrame:
    """checked (see `preflight`) with `skip`: risk of 2 at the most, no broken invariant, tests touched, and not forced."""
    broken = invariants.select("diff_id").distinct().withColumn("_broken", F.lit(True))
    out = checked.join(broken, "diff_id", "left")
    return out.withColumn("skip", F.lit(not force) & (F.col("risk") <= 2) & F.col("_broken").isNull() & F.col("tests")).drop("_broken")


def _markdown(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\`*_{}\[\]()#+\-!|>])", r"\\$1")


def pr_comment(findings: DataFrame, results: DataFrame, most: int = 20) -> DataFrame:
    """(diff_id, comment) of results(diff_id, risk, change, should_fail): a Markdown comment with the `most` weightiest of
    findings(diff_id, ord, id, severity, category, title, file, lo). They are ranked before they are gathered."""
    order = Window.partitionBy("diff_id").orderBy(severity_rank(F.col("severity")).desc(), "ord")
    f = findings.withColumn("_n", F.row_number().over(order)).withColumn("_all", F.count("*").over(Window.partitionBy("diff_id"))).where(F.col("_n") <= most)
    line = F.concat(F.lit("- **"), "severity", F.lit("** `"), "id", F.lit("` ("), "category", F.lit(") at `"), "file", F.lit(":"), F.col("lo").cast("string"), F.lit("`: "), _markdown(F.col("title")))
    g = f.groupBy("diff_id").agg(F.array_sort(F.collect_list(F.struct("_n", line.alias("line")))).alias("ls"), F.max("_all").alias("n"))
    head = F.concat(F.lit("## Code Review Summary\n\n- Risk: **"), F.col("risk").cast("string"), F.lit("/5**\n- Classification: **"), "change", F.lit("**\n- CI gate: **"), F.when(F.col("should_fail"), "FAIL").otherwise("PASS"), F.lit("**\n\n"))
    more = F.when(F.col("n") > most, F.concat(F.lit(f"\n\n(Showing first {most} of "), F.col("n").cast("string"), F.lit(" findings.)"))).otherwise("")
    body = F.when(F.col("n").isNull(), "No findings.").otherwise(F.concat(F.lit("## Findings\n\n"), F.array_join(F.transform("ls", lambda x: x["line"]), "\n"), more))
    return results.join(g, "diff_id", "left").select("diff_id", F.concat(head, body).alias("comment"))
