"""Unified diffs of texts: shortest edit scripts by lines, hunks with context, pairs of versions.

A pair of versions is one row, so pairs are dealt over tasks as they come and nothing is grouped; two long texts cost
(lines + lines) x edits steps of one task, with memory in proportion to their lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OUT = -(1 << 40)  # a path that has left the grid


def matches(a: list, b: list) -> list[tuple[int, int, int]]:
    """(place in a, place in b, length) of the runs that a shortest edit script keeps, in order.

    Myers' O(ND) walk in linear space: furthest paths from both ends meet in a middle run, and both rests are
    done likewise. All diagonals of a step are advanced at once.
    """
    number: dict = {}
    x = np.array([number.setdefault(v, len(number)) for v in a], dtype=np.int64)
    y = np.array([number.setdefault(v, len(number)) for v in b], dtype=np.int64)
    found: list[tuple[int, int, int]] = []
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        n = min(a1 - a0, b1 - b0)
        differs = np.flatnonzero(x[a0 : a0 + n] != y[b0 : b0 + n])
        head = int(differs[0]) if len(differs) else n
        if head:
            found.append((a0, b0, head))
        a0, b0, n = a0 + head, b0 + head, n - head
        differs = np.flatnonzero(x[a1 - n : a1][::-1] != y[b1 - n : b1][::-1])
        tail = int(differs[0]) if len(differs) else n
        if tail:
            found.append((a1 - tail, b1 - tail, tail))
        a1, b1 = a1 - tail, b1 - tail
        if a0 < a1 and b0 < b1:
            p, q, length = _middle(x[a0:a1], y[b0:b1])
            if length:
                found.append((a0 + p, b0 + q, length))
            todo += [(a0, a0 + p, b0, b0 + q), (a0 + p + length, a1, b0 + q + length, b1)]
    return sorted(found)


def _advance(v: np.ndarray, d: int, zero: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One step of furthest paths: diagonals, where each came to, where its run of equal elements ends (kept in v)."""
    k = np.arange(max(-d, -len(b) + (d + len(b)) % 2), min(d, len(a) - (d + len(a)) % 2) + 1, 2)
    right, down = v[zero + k - 1] + 1, v[zero + k + 1]
    came = np.where(down >= right, down, right) if d else np.zeros(1, dtype=np.int64)
    came = np.where((came < 0) | (came > len(a)) | (came - k < 0) | (came - k > len(b)), _OUT, came)
    to = came.copy()
    open_ = np.flatnonzero(came >= 0)
    while len(open_):
        at = to[open_]
        inside = (at < len(a)) & (at - k[open_] < len(b))
        open_, at = open_[inside], at[inside]
        same = a[at] == b[at - k[open_]]
        open_ = open_[same]
        to[open_] += 1
    v[zero + k] = to
    return k, came, to


def _middle(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """(place in a, place in b, length) of the run, maybe empty, where the walks from both ends of a shortest script meet."""
    n, m = len(a), len(b)
    delta, zero = n - m, n + m + 1
    forth, back = np.full(2 * zero + 1, _OUT, dtype=np.int64), np.full(2 * zero + 1, _OUT, dtype=np.int64)
    ra, rb = a[::-1], b[::-1]
    for d in range((n + m + 1) // 2 + 1):
        k, came, to = _advance(forth, d, zero, a, b)
        if delta % 2:
            other = delta - k
            met = np.flatnonzero((abs(other) <= d - 1) & (to >= 0) & (to + back[zero + np.clip(other, -zero, zero)] >= n))
            if len(met):
                i = met[0]
                return int(came[i]), int(came[i] - k[i]), int(to[i] - came[i])
        k, came, to = _advance(back, d, zero, ra, rb)
        if delta % 2 == 0:
            other = delta - k
            met = np.flatnonzero((abs(other) <= d) & (to >= 0) & (to + forth[zero + np.clip(other, -zero, zero)] >= n))
            if len(met):
                i = met[0]
                return int(n - to[i]), int(m - (to[i] - k[i])), int(to[i] - came[i])
    raise AssertionError("walks from both ends meet")


def hunks(a: list[str], b: list[str], context: int = 3) -> Iterator[str]:
    """The hunks of a unified diff, without a line break at their ends."""
    kept = [*matches(a, b), (len(a), len(b), 0)]
    edits, at_a, at_b = [], 0, 0  # ranges of a that go and of b that come
    for i, j, n in kept:
        if i > at_a or j > at_b:
            edits.append((at_a, i, at_b, j))
        at_a, at_b = i + n, j + n
    k = 0
    while k < len(edits):
        z = k
        while z + 1 < len(edits) and edits[z + 1][0] - edits[z][1] <= 2 * context:
            z += 1
        lo, hi = max(0, edits[k][0] - context), min(len(a), edits[z][1] + context)
        lo_b, hi_b = edits[k][2] - (edits[k][0] - lo), edits[z][3] + (hi - edits[z][1])
        rows, at = [], lo
        for a0, a1, b0, b1 in edits[k : z + 1]:
            rows += [" " + x for x in a[at:a0]] + ["-" + x for x in a[a0:a1]] + ["+" + x for x in b[b0:b1]]
            at = a1
        rows += [" " + x for x in a[at:hi]]
        said = lambda first, last: f"{first + (last > first)},{last - first}"
        yield f"@@ -{said(lo, hi)} +{said(lo_b, hi_b)} @@\n" + "\n".join(rows)
        k = z + 1


def unified(old_path: str, new_path: str, old: str | None, new: str | None, context: int = 3) -> str:
    """A file's diff; a text that is null isn't there, so the file is new or deleted. Equal texts have no hunks."""
    head = [f"diff --git a/{old_path} b/{new_path}"]
    head += ["new file mode 100644"] if old is None else ["deleted file mode 100644"] if new is None else []
    a, b = ([] if t is None else t.split("\n") for t in (old, new))
    head += [f"--- {'/dev/null' if old is None else 'a/' + old_path}", f"+++ {'/dev/null' if new is None else 'b/' + new_path}"]
    return "\n".join([*head, *hunks(a, b, context)])


def with_diff(pairs: DataFrame, context: int = 3) -> DataFrame:
    """(diff_id, diff) of pairs(diff_id, old_path, new_path, old, new)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [unified(p, q, x, y, context) for p, q, x, y in zip(b["old_path"], b["new_path"], b["old"], b["new"], strict=True)]
            yield pd.DataFrame({"diff_id": b["diff_id"], "diff": texts})

    return pairs.select("diff_id", "old_path", "new_path", "old", "new").mapInPandas(run, f"diff_id {dict(pairs.dtypes)['diff_id']}, diff string")


def turn_pairs(turns: DataFrame) -> DataFrame:
    """Each turn(conv_id, turn, role, text) as the next version of the turn before it; a first turn is a new file.

    An equi-join on (conversation, turn), so a conversation with a third of all turns is dealt like any other. A role
    stands for a kind of file.
    """
    path = F.when(F.col("role") == "user", F.concat(F.lit("docs/"), "conv_id", F.lit(".md"))).when(F.col("role") == "assistant", F.concat(F.lit("src/mcp/"), "conv_id", F.lit(".ts"))).otherwise(F.concat(F.lit("config/"), "conv_id", F.lit(".yml")))
    new = turns.select("conv_id", "turn", path.alias("new_path"), F.col("text").alias("new"))
    old = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), path.alias("old_path"), F.col("text").alias("old"))
    out = new.join(old, ["conv_id", "turn"], "left")
    return out.select(F.concat_ws("/", "conv_id", "turn").alias("diff_id"), F.coalesce("old_path", "new_path").alias("old_path"), "new_path", "old", "new")


def longest_line(text: Column) -> Column:
    """The hash of a text's longest line, the first of the longest; null for a text without words."""
    lines = F.split(text, "\n", -1)
    longest = F.array_max(F.transform(lines, lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("i"), x.alias("x"))))
    return F.when(F.length(F.trim(longest["x"])) > 0, F.sha2(longest["x"], 256))


def revision_pairs(docs: DataFrame, salts: int = 16) -> DataFrame:
    """Each doc(doc_id, source, text) that shares its longest line with an earlier one, as a version of the first of them.

    First documents are found by an aggregation and met by parts of a line's documents, so a line that a third of all
    texts share is no single task.
    """
    path = F.concat_ws("/", "source", "doc_id")
    lines = docs.select("doc_id", path.alias("path"), "text", longest_line(F.col("text")).alias("line")).where("line is not null")
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")
    first = lines.groupBy("line").agg(F.min(F.struct("doc_id", "path", "text")).alias("f"), F.count("*").alias("n")).where("n > 1")
    first = first.select("line", "f", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    out = lines.withColumn("salt", salt).join(first, ["line", "salt"]).where(F.col("doc_id") > F.col("f.doc_id"))
    return out.select(F.col("doc_id").alias("diff_id"), F.col("f.path").alias("old_path"), F.col("path").alias("new_path"), F.col("f.text").alias("old"), F.col("text").alias("new"))
