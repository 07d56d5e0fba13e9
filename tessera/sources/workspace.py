"""Workspaces: files under a folder as a table, ignore rules, JSON and Parquet indexes, policy files."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import basename, extension, glob_regex

#: Folders that hold no sources, and limits of the scans.
SKIP_DIRS = ["node_modules", "dist", "build", ".git", ".next", "__pycache__", "vendor", ".dart_tool", "Pods", ".pub-cache", "coverage", ".local-context", ".memories"]
MAX_BYTES = {"index": 1 << 20, "parse": 500_000, "markers": 1_000_000, "stats": 5_000_000}


def read_files(spark: SparkSession, root: str, most_bytes: int = MAX_BYTES["index"]) -> DataFrame:
    """files(path, content, bytes) under a folder, paths relative to it. Size and path are tested before contents are
    read. Spark's listing passes over names that begin with a dot or an underscore."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length") <= most_bytes)
    base = re.escape(root.rstrip("/").split(":", 1)[-1].lstrip("/"))
    return raw.select(F.regexp_replace("path", rf"^(?:\w+:)?/*{base}/+", "").alias("path"), F.decode("content", "UTF-8").alias("content"), F.col("length").alias("bytes"))


def in_scope(path: Column, scopes: list[str]) -> Column:
    """Whether a path lies under one of the folders; no folders: all do."""
    out = F.lit(not scopes)
    for s in scopes:
        s = s.strip("/")
        out = out | (path == s) | path.startswith(s + "/")
    return out


def skipped(path: Column) -> Column:
    """Whether a path leads through a folder without sources."""
    return path.rlike("(^|/)(" + "|".join(map(re.escape, SKIP_DIRS)) + ")/")


def ignore_patterns(text: str) -> list[str]:
    """Patterns of an ignore file; blank lines, comments and negations are left out."""
    return [x for x in map(str.strip, text.splitlines()) if x and x[0] not in "#!"]


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether a path falls under one of the patterns, compiled into one regular expression.

    A slash in front ties a pattern to the root; one behind means a folder and all below it; a bare name is a file or
    folder anywhere; anything else is a glob that may match from any folder on.
    """
    rules = []
    for p in patterns:
        rooted, folder = p.startswith("/"), p.endswith("/")
        body = glob_regex(p.strip("/"))[1:-1]
        rules.append(("^" if rooted else "(?:^|.*/)") + body + ("/.*$" if folder else "(?:/.*)?$"))
    return path.rlike("|".join(f"(?:{r})" for r in rules)) if rules else F.lit(False)


def crawl(files: DataFrame, extensions: list[str], names: list[str] = (), patterns: list[str] = (), scopes: list[str] = (), hidden: bool = False, most: int | None = None) -> DataFrame:
    """Files of a workspace that a tool reads: by extension or name, not hidden, not skipped, not ignored, in scope."""
    p = F.col("path")
    f = files.where(~skipped(p) & ~ignored(p, list(patterns)) & in_scope(p, list(scopes)) & (extension(p).isin(extensions) | F.lower(basename(p)).isin([n.lower() for n in names])))
    if not hidden:
        f = f.where(~p.rlike(r"(^|/)\.[^/]") | F.lower(basename(p)).isin([n.lower() for n in names]))
    return f.orderBy("path").limit(most) if most else f


def valid_path(path: str) -> str:
    """A relative path inside the workspace; anything else is refused."""
    if not path or path.startswith(("/", "\\")) or re.match(r"^[A-Za-z]:", path) or ".." in path.replace("\\", "/").split("/"):
        raise ValueError(f"not a path inside the workspace: {path!r}")
    return path


INDEX = ("version int, chunks array<struct<id string, filePath string, content string, startLine int, endLine int, embedding array<double>>>, fileHashes map<string, string>")


def read_json_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(chunks, state) of a JSON index; an unreadable one is empty."""
    doc = spark.read.schema(INDEX).option("multiLine", "true").option("mode", "PERMISSIVE").json(path)
    chunks = doc.select(F.explode("chunks").alias("c")).select("c.id", F.col("c.filePath").alias("path"), "c.content", F.col("c.startLine").alias("start_line"), F.col("c.endLine").alias("end_line"), "c.embedding")
    return chunks, doc.select(F.explode("fileHashes").alias("path", "hash"))


def migrate_json_index(spark: SparkSession, source: str, target: str, buckets: int = 64) -> None:
    """A JSON index as Parquet tables chunks and state under `target`, vectors kept; chunks partitioned by path hash."""
    chunks, state = read_json_index(spark, source)
    write_index(chunks, state, target, buckets)


def write_index(chunks: DataFrame, state: DataFrame, target: str, buckets: int = 64) -> None:
    chunks.withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(buckets))).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/chunks")
    state.write.mode("overwrite").parquet(f"{target}/state")


def clear_index(spark: SparkSession, target: str) -> None:
    """Delete chunks and state together."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _parsed(text: str):
    """A YAML document, or JSON (a part of YAML) where no YAML parser is installed."""
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text)


def _pattern(x) -> str | None:
    """A regular expression given as text or as {regex: {pattern, flags}}; the flag i goes into the pattern."""
    if isinstance(x, str):
        return x
    r = x.get("regex", x) if isinstance(x, dict) else {}
    return ("(?i)" if "i" in str(r.get("flags") or "") else "") + r["pattern"] if isinstance(r, dict) and isinstance(r.get("pattern"), str) else None


def load_rules(text: str) -> list[dict]:
    """Policy rules of a YAML or JSON document {section: [rule, ...]}, with `section`; sections that are no lists, and rules
    without id, rule, paths, severity or category go. A document that is no mapping is refused."""
    doc = _parsed(text) if text and text.strip() else {}
    if not isinstance(doc, dict):
        raise ValueError("policy rules are a mapping of sections to lists of rules")
    out = []
    for section, rules in doc.items():
        for r in rules if isinstance(rules, list) else []:
            words = [r.get(k) for k in ("id", "rule", "severity", "category")] if isinstance(r, dict) else [None]
            paths = [p for p in r["paths"] if isinstance(p, str)] if isinstance(r, dict) and isinstance(r.get("paths"), list) else []
            if paths and all(isinstance(w, str) and w for w in words):
                out.append({**r, "section": section, "paths": paths} | {k: _pattern(r[k]) for k in ("when", "require", "deny") if k in r})
    return out


def read_issues(spark: SparkSession, path: str) -> DataFrame:
    """Issues and pull requests saved as JSON lines: (number, title, state, labels, is_pull)."""
    schema = "number long, title string, body string, state string, labels array<struct<name string>>, pull_request struct<url string>"
    d = spark.read.schema(schema).json(path)
    return d.select("number", "title", "state", F.array_join(F.transform("labels", lambda x: x["name"]), ",").alias("labels"), F.col("pull_request").isNotNull().alias("is_pull"))
