"""Index maintenance: changed files by hash, state merges, incremental chunks, trees, git text, memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import trim


def with_hash(files: DataFrame) -> DataFrame:
    return files.withColumn("hash", F.sha2(F.coalesce("content", F.lit("")), 256))


def changed(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files whose (path, hash) isn't in the state."""
    return with_hash(files).join(state.select("path", "hash"), ["path", "hash"], "left_anti")


def merge_state(state: DataFrame, present: DataFrame, done: DataFrame) -> DataFrame:
    """New state (path, hash): files indexed now, and older entries of files that are still there."""
    old = state.join(present.select("path"), "path", "left_semi").join(done.select("path"), "path", "left_anti")
    return old.select("path", "hash").unionByName(done.select("path", "hash"))


def merge_chunks(chunks: DataFrame, new: DataFrame, gone: DataFrame) -> DataFrame:
    """chunks without those of changed or deleted paths, and the new ones: one anti-join for all files of a batch."""
    dead = new.select("path").unionByName(gone.select("path")).distinct()
    return chunks.join(dead, "path", "left_anti").unionByName(new)


def tree(files: DataFrame, depth: int = 4, most: int = 50) -> DataFrame:
    """(parent, name, is_dir, entries, place) of the tree of paths down to `depth`: folders first, then by name, `most` of
    each folder and a line for the rest; hidden names are left out."""
    parts = F.split("path", "/")
    up = F.explode(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(depth)))).alias("k")
    e = files.select(parts.alias("p"), up).select(F.array_join(F.slice("p", 1, F.col("k") - 1), "/").alias("parent"), F.get("p", F.col("k") - 1).alias("name"), (F.col("k") < F.size("p")).alias("is_dir"), F.get("p", F.col("k")).alias("child"))
    e = e.where(~F.col("name").startswith(".")).groupBy("parent", "name", "is_dir").agg(F.countDistinct("child").alias("entries"))
    w = Window.partitionBy("parent").orderBy(F.col("is_dir").desc(), "name")
    first = e.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)  # ranked alone: tasks cut a hot folder before it is shuffled
    more = e.groupBy("parent").agg(F.count("*").alias("n")).where(F.col("n") > most)
    more = more.select("parent", F.format_string("... and %d more entries", F.col("n") - most).alias("name"), F.lit(False).alias("is_dir"), F.lit(0).cast("long").alias("entries"), F.lit(most + 1).alias("place"))
    return first.unionByName(more)


def file_slice(content: Column, first: Column, last: Column) -> Column:
    """Lines first..last from 1, both included; null where first is past the end."""
    ls = F.split(content, "\n", -1)
    return F.when(first <= F.size(ls), F.array_join(F.slice(ls, first, F.greatest(F.lit(0), F.least(last, F.size(ls)) - first + 1)), "\n"))


def git_log(logs: DataFrame) -> DataFrame:
    """(repo, ord, hash, author, when, message) of `hash|author|when|message` lines; the message keeps its bars."""
    t = logs.select("repo", F.posexplode(F.split("output", "\n")).alias("ord", "x")).where("x <> ''").withColumn("p", F.split("x", r"\|", 4))
    return t.select("repo", "ord", *(F.get("p", F.lit(i)).alias(n) for i, n in enumerate(["hash", "author", "when", "message"])))


def blame(outputs: DataFrame) -> DataFrame:
    """(file, line, author, date, content) of line-porcelain output: headers hold until the line that begins with a tab."""
    t = outputs.select("file", F.posexplode(F.split("output", "\n", -1)).alias("pos", "x"))
    w = Window.partitionBy("file").orderBy("pos")
    told = lambda prefix: F.last(F.when(F.col("x").startswith(prefix), F.substr("x", F.lit(len(prefix) + 1))), True).over(w)
    t = t.withColumn("author", told("author ")).withColumn("at", told("author-time ")).where(F.col("x").startswith("\t"))
    return t.select("file", F.row_number().over(w).alias("line"), "author", F.date_format(F.timestamp_seconds(F.col("at").cast("long")), "yyyy-MM-dd").alias("date"), F.substr("x", F.lit(2)).alias("content"))


def ownership(lines: DataFrame) -> DataFrame:
    """(file, author, lines, pct)."""
    g = lines.groupBy("file", "author").agg(F.count("*").alias("lines"))
    return g.withColumn("pct", F.round(F.col("lines") / F.sum("lines").over(Window.partitionBy("file")) * 100, 1))


def contributors(outputs: DataFrame) -> DataFrame:
    """(repo, author, commits) of shortlog lines."""
    t = outputs.select("repo", F.explode(F.split("output", "\n")).alias("x")).withColumn("x", trim(F.col("x"))).where(F.col("x").rlike(r"^\d+\s+.+$"))
    return t.select("repo", F.regexp_extract("x", r"^(\d+)\s+(.+)$", 2).alias("author"), F.regexp_extract("x", r"^(\d+)\s+(.+)$", 1).cast("long").alias("commits"))


def status_counts(outputs: DataFrame) -> DataFrame:
    """(repo, kind, files) of porcelain status lines: staged, unstaged, untracked."""
    t = outputs.select("repo", F.explode(F.split("output", "\n")).alias("x")).where(F.length("x") > 3)
    a, b = F.substring("x", 1, 1), F.substring("x", 2, 1)
    kinds = F.array_compact(F.array(F.when(F.col("x").startswith("??"), "untracked"), F.when(~a.isin(" ", "?"), "staged"), F.when(~b.isin(" ", "?"), "unstaged")))
    return t.select("repo", F.explode(kinds).alias("kind")).groupBy("repo", "kind").agg(F.count("*").alias("files"))


def memory_entry(title: Column, content: Column, date: Column) -> Column:
    """A dated entry: `### [date] title` and the lines of the content as bullets; content is cut at 5000 signs."""
    ls = F.filter(F.transform(F.split(F.substring(content, 1, 5000), "\n"), trim), lambda x: x != "")
    bullets = F.transform(ls, lambda x: F.when(x.startswith("- "), x).otherwise(F.concat(F.lit("- "), x)))
    return F.concat(F.lit("### ["), date, F.lit("] "), title, F.lit("\n"), F.array_join(bullets, "\n"))


def memory_counts(memories: DataFrame) -> DataFrame:
    """(category, entries, preview) of memories(category, content): lines that begin an entry or a bullet."""
    ls = F.split("content", "\n")
    return memories.select("category", F.size(F.filter(ls, lambda x: trim(x).startswith("-") | trim(x).startswith("###"))).alias("entries"), F.substring("content", 1, 500).alias("preview"))
