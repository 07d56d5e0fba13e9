"""Operator 8: removal of globally repeated multi-line passages by content-defined line chunks.

A text is its \\n-split lines; the lines with a word are numbered. The rolling hash of two lines that follow each other is the
MD5 of their MD5s. A pair of lines is a boundary if its rolling hash lies in the lowest of EVERY parts of its range, or is the least of the last SPAN:
a chunk may begin at its first line, and end at its second. Both depend on these lines alone (and on SPAN before
them where none else would come), so boundaries stay with their lines when text before them is put in or taken out. A chunk begins at each boundary
and at the text's first line, and ends at the first boundary, or the text's last line, where it counts: two or more lines with a word and
`least_words` words in all; after LOOK further lines it ends without one.

A chunk is repeated if it stands, byte for byte, in an earlier place too (smaller doc_id, then line) that does not overlap it.
From a repeated chunk the match is extended line by line, up to CONTEXT lines each way, while the lines equal those around the
first place (told by 128 bits of their SHA-256); it ends on a line with a word. All of it goes; the first place stays. So a passage goes
whole if it holds a chunk and no more than CONTEXT lines before or after its chunks; a passage without a boundary pair in a fit place
would stay, so the query and the pipeline take windows beside the chunks: from each line with a word the shortest passage that counts (two
lines, `least_words` words) downwards, and the shortest upwards. Each passage that counts is the union of its windows, so every repeated one goes
whole. Every line that goes stands in an earlier place too.

Narrow steps: hashes of chunks, without text, are written and counted with map-side combine; texts meet their repeated
hashes and are written with them; only those chunks are grouped by their bytes, which is the comparison: hashes never
decide on them. Texts without such a chunk then pass, the others travel once more, to the lines that go. A chunk that a third
of all rows share is combined before it is counted or compared, and its rows are dealt by SALTS where they meet the result.
The steps before the last run while the query is built.

Defined results: null texts are kept as they are; empty texts and single lines have no chunk; repeated rows
with one doc_id, or without one, count as one document; a document may lose all its lines and stays with an empty text; an empty table
gives an empty result. Blank lines at the edges of a match stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import keyed, packed, SPACE_CHARS, SPACE_CLASS, spread, Stash, table
from tessera.llm.quality import let

EVERY, LEAST_WORDS, SPAN, LOOK, CONTEXT = 2, 12, 16, 32, 16
NO_SPACE = r"[^\x20\x09-\x0D]"
#: A chunk of HOT places or more is dealt over SALTS parts where it meets its class.
HOT, SALTS = 256, 16


def _has_word(line: Column) -> Column:
    return F.length(F.btrim(line, F.lit(SPACE_CHARS))) > 0


def boundaries(hashes: Column, every: int = EVERY) -> Column:
    """Array of booleans, one for each pair of lines that follow each other in the array of their MD5s."""

    def told(r: Column) -> Column:
        return F.transform(r, lambda x, k: (x < f"{(1 << 32) // every:08x}" if every > 1 else F.lit(True)) | (x == F.array_min(F.slice(r, F.greatest(k + 2 - SPAN, F.lit(1)), F.least(k + 1, F.lit(SPAN))))))

    pair = lambda x, k: F.md5(F.concat(F.get(hashes, k), F.get(hashes, k + 1)))
    return F.when(F.size(hashes) < 2, F.array().cast("array<boolean>")).otherwise(let(F.transform(F.slice(hashes, 1, F.greatest(F.size(hashes) - 1, F.lit(0))), pair), told))


def _counted(x: Column, i: Column, most: int) -> Column:
    """Line number, words (`most` stands for more, too) and the line itself; most lines have enough words, which one pattern tells without cutting them out."""
    own = F.btrim(x, F.lit(SPACE_CHARS))
    many = own.rlike(f"^(?:{NO_SPACE}++{SPACE_CLASS}++){{{most - 1}}}")
    n = F.when(F.length(own) == 0, 0).when(many, most).otherwise(F.size(F.split(own, SPACE_CLASS + "+", most)))
    return F.struct((i + 1).alias("line"), n.alias("words"), x.alias("own"))


def _code(a: Column, z: Column) -> Column:
    """The lines from a to z as one number."""
    return F.shiftleft(a["line"].cast("long"), 32) + (z["line"] - a["line"] + 1)


def _reach(x: Column, then: Column, near: Column, least_words: int) -> Column:
    """How many of the lines `near`, of which x and `then` are the first, are enough; null if all are not."""
    start = F.struct(F.lit(0).alias("words"), F.lit(0).alias("n"))
    enough = lambda a: (a["n"] >= 2) & (a["words"] >= least_words)
    add = lambda a, x: F.when(enough(a), a).otherwise(F.struct((a["words"] + x["words"]).alias("words"), (a["n"] + 1).alias("n")))
    return F.when(x["words"] + then["words"] >= least_words, 2).otherwise(F.aggregate(near, start, add, lambda a: F.when(enough(a), a["n"])))


def _chunk_codes(at: Column, every: int, least_words: int) -> Column:
    most = max(2, least_words)  # of lines with a word that a chunk can need

    def ranges(b: Column) -> Column:
        begins = lambda k: (k == 0) | F.coalesce(F.get(b, k), F.lit(False))

        def end(reach: Column, k: Column) -> Column:  # place in `at` of the last line
            least = k + reach - 1
            found = F.array_position(F.slice(b, F.greatest(least, F.lit(1)), LOOK), F.lit(True))  # b[least - 1] is the pair that ends at `least`
            return F.when(found > 0, least + found.cast("int") - 1).when(least.isNotNull(), F.least(least + LOOK - 1, F.size(at) - 1))

        code = lambda x, k: F.when(begins(k), let(_reach(x, F.get(at, k + 1), F.slice(at, k + 1, most), least_words), lambda r: _code(x, F.get(at, end(r, k)))))
        return F.array_compact(F.transform(at, code))

    return let(F.transform(at, lambda x: F.md5(x["own"])), lambda hashes: let(boundaries(hashes, every), ranges))


def _window_codes(at: Column, least_words: int) -> Column:
    most = max(2, least_words)  # of lines with a word in a window
    down = lambda x, k: _code(x, F.get(at, k + _reach(x, F.get(at, k + 1), F.slice(at, k + 1, most), least_words) - 1))
    up = lambda x, k: _code(F.get(at, k - _reach(x, F.get(at, k - 1), F.reverse(F.slice(at, F.greatest(k + 2 - most, F.lit(1)), F.least(k + 1, F.lit(most)))), least_words) + 1), x)
    return F.array_compact(F.array_union(F.transform(at, down), F.transform(at, up)))


def _pieces(text: Column, least_words: int, codes) -> Column:
    """Array of (first, n, hash) of the passages that codes(lines with a word) tells, null for a single line; each line is looked at once."""

    def cut(lines: Column) -> Column:
        def piece(h: Column, told: Column) -> Column:
            def one(c: Column) -> Column:
                first, n = F.shiftright(c, 32).cast("int"), c.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
                return F.struct(first.alias("first"), n.alias("n"), F.xxhash64(F.slice(h, first, n)).alias("hash"))

            return F.transform(told, one)

        at = F.filter(F.transform(lines, lambda x, i: _counted(x, i, max(2, least_words))), lambda x: x["words"] > 0)
        return let(F.transform(lines, lambda x: F.xxhash64(x)), lambda h: piece(h, let(at, codes)))

    return F.when(F.instr(text, "\n") == 0, None).otherwise(let(F.split(text, "\n"), cut))


def chunks(text: Column, every: int = EVERY, least_words: int = LEAST_WORDS) -> Column:
    """Array of (first, n, hash) of the chunks that count; first is a line from 1, n a number of lines."""
    return _pieces(text, least_words, lambda at: _chunk_codes(at, every, least_words))


def windows(text: Column, least_words: int = LEAST_WORDS) -> Column:
    """Array of (first, n, hash) of the shortest passages that count, downwards and upwards from each line with a word."""
    return _pieces(text, least_words, lambda at: _window_codes(at, least_words))


def chunks_and_windows(text: Column, every: int = EVERY, least_words: int = LEAST_WORDS) -> Column:
    """Both, each passage once."""
    return _pieces(text, least_words, lambda at: F.array_union(_chunk_codes(at, every, least_words), _window_codes(at, least_words)))


def _common(mine: Column, theirs: Column) -> Column:
    """How many leading lines of two arrays of line digests are equal, up to the last of them with a word."""
    differs = F.array_position(F.transform(F.arrays_zip(mine.alias("a"), theirs.alias("b")), lambda z: F.coalesce(z["a"] == z["b"], F.lit(False))), F.lit(False))
    n = F.when(differs > 0, differs - 1).otherwise(F.least(F.size(mine), F.size(theirs)).cast("long")).cast("int")

    def ended(same: Column) -> Column:
        last = F.array_position(F.reverse(F.transform(same, lambda x: F.substring(x, 1, 1) == F.lit(b"\x01"))), F.lit(True)).cast("int")
        return F.when(last > 0, F.size(same) - last + 1).otherwise(0)

    return F.when(n == 0, 0).otherwise(let(F.slice(mine, 1, n), ended))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", every: int = EVERY, least_words: int = LEAST_WORDS, context: int = CONTEXT, whole_passages: bool = False) -> DataFrame:
    """docs with `kept_text`, `n_lines` and `n_removed_lines`; clashing names of docs don't matter, they are packed in a struct `row`. `whole_passages`:
    the windows beside the chunks, so that no repeated passage stays."""
    stash = Stash(docs.sparkSession)
    base = docs.select(keyed(key).alias("_id"), packed(docs).alias("row"))
    whole = F.col(f"row.`{text}`")
    pieces = (chunks_and_windows if whole_passages else chunks)(whole, every, least_words)
    cut = base.select("_id", F.explode(pieces).alias("c")).select("_id", F.col("c.hash").alias("h"), (F.shiftleft(F.col("c.first").cast("long"), 32) + F.col("c.n")).alias("code"))
    cut = stash.keep(cut)
    salt = F.pmod(F.xxhash64(F.lit(8), "_id"), F.lit(SALTS)).cast("int").alias("salt")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    twice = cut.groupBy("h").agg(F.count("*").alias("times")).where("times > 1").select("h", (F.col("times") >= HOT).alias("hot"), salts)
    suspects = cut.select("*", salt).join(twice, ["h", "salt"]).groupBy("_id").agg(F.collect_set(F.struct("h", "code", "hot")).alias("cs"))
    met = stash.keep(base.join(suspects.withColumnRenamed("_id", "_sid"), F.col("_id") == F.col("_sid"), "left").select("_id", "row", "cs"))
    stash.drop(cut)

    def told_of(ls: Column) -> Column:
        lines = F.get(ls, F.lit(0))
        digest = lambda x: F.unhex(F.concat(F.when(_has_word(x), "01").otherwise("00"), F.substring(F.sha2(x, 256), 1, 32)))

        def one(c: Column, digests: Column) -> Column:
            first, n = F.shiftright(c["code"], 32).cast("int"), c["code"].bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
            up = F.reverse(F.slice(digests, F.greatest(first - context, F.lit(1)), F.least(first - 1, F.lit(context))))
            down = F.slice(digests, first + n, context)
            return F.struct(c["h"].alias("h"), c["hot"].alias("hot"), first.alias("first"), n.alias("n"), F.array_join(F.slice(lines, first, n), "\n").alias("bytes"), up.alias("up"), down.alias("down"))

        return let(F.transform(lines, digest), lambda digests: F.transform("cs", lambda c: one(c, digests)))

    some = met.where("cs is not null")
    told = some.select("_id", F.explode(let(F.array(F.split(whole, "\n")), told_of)).alias("c")).select("_id", "c.*")
    digest = F.unhex(F.sha2("bytes", 256)).alias("digest")
    classes = told.groupBy("h", "hot", "bytes").agg(F.min(F.struct("_id", "first", "up", "down")).alias("keeper"), F.count("*").alias("times")).where("times > 1")
    classes = classes.select("h", digest, "keeper", F.explode(F.sequence(F.lit(0), F.when(F.col("hot"), SALTS - 1).otherwise(0))).alias("salt"))
    salt = F.when(F.col("hot"), salt).otherwise(0).alias("salt")
    gone = (
        told.select("_id", "h", "first", "n", "up", "down", digest, salt)
        .join(classes, ["h", "digest", "salt"])
        .where((F.col("_id") != F.col("keeper._id")) | (F.col("first") >= F.col("keeper.first") + F.col("n")))
        .select("_id", "first", "n", _common(F.col("up"), F.col("keeper.up")).alias("more_up"), _common(F.col("down"), F.col("keeper.down")).alias("more_down"))
        .groupBy(F.col("_id").alias("_gid"))
        .agg(F.collect_set(F.struct((F.col("first") - F.col("more_up")).alias("first"), (F.col("first") + F.col("n") - 1 + F.col("more_down")).alias("last"))).alias("gone"))
    )
    out = some.join(gone, F.col("_id") == F.col("_gid"), "left").select("row", "gone")
    out = out.unionByName(met.where("cs is null").select("row", F.lit(None).cast("array<struct<first:int,last:int>>").alias("gone")))
    lines = F.split(whole, "\n")

    def kept(ls: Column) -> Column:
        n = F.size(F.get(ls, F.lit(0)))
        out_of = F.flatten(F.transform("gone", lambda g: F.sequence(g["first"], F.least(g["last"], n))))
        return F.transform(F.array_except(F.sequence(F.lit(1), n), out_of), lambda i: F.get(F.get(ls, F.lit(0)), i - 1))

    left = out.withColumn("left", F.when(F.col("gone").isNotNull(), let(F.array(lines), kept)))
    return left.select(
        "row",
        F.when(F.col("gone").isNull(), whole).otherwise(F.array_join("left", "\n")).alias("kept_text"),
        F.when(whole.isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size(lines) - F.size("left")).cast("long").alias("n_removed_lines"),
    )


def op8_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed_lines (long), kept_sha256 of the remaining text (null: empty)."""
    out = dedup_lines(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), whole_passages=True)
    return out.select("row.doc_id", "n_lines", "n_removed_lines", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def stage_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with what is left of their texts; n_chars follows where there is such a column."""
    own = docs.columns
    out = dedup_lines(docs, whole_passages=True)
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return out.select(*(new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in own))


QUERIES = {"op8_line_chunks": op8_line_chunks}
#: Chunks and boundaries by windows over the numbered lines, then extension by counting equal lines.
ORACLES = {
    "op8_line_chunks": rf"""WITH l AS (SELECT doc_id, i, string_split(text, chr(10))[i] AS x FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)),
n AS (SELECT *, len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS n FROM l),
o AS (SELECT doc_id, i, md5(x) AS h, row_number() OVER d AS k, sum(n) OVER d AS upto, sum(n) OVER d - n AS before, count(*) OVER (PARTITION BY doc_id) AS m FROM n WHERE n > 0 WINDOW d AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
r AS (SELECT *, CASE WHEN k < m THEN md5(h || lead(h) OVER (PARTITION BY doc_id ORDER BY k)) END AS r FROM o),
b AS (SELECT *, coalesce(r < '{(1 << 32) // EVERY:08x}' OR r = min(r) OVER (PARTITION BY doc_id ORDER BY k ROWS {SPAN - 1} PRECEDING), false) AS cut FROM r),
e AS (SELECT a.doc_id, a.k, a.i AS lo, min(z.k) AS least FROM b a JOIN o z ON a.doc_id = z.doc_id AND z.k BETWEEN a.k + 1 AND a.k + {LEAST_WORDS - 1} AND z.upto - a.before >= {LEAST_WORDS} WHERE a.cut OR a.k = 1 GROUP BY ALL),
f AS (SELECT e.doc_id, lo, coalesce(min(y.k) + 1, least(any_value(e.least) + {LOOK - 1}, any_value(q.m))) AS k FROM e JOIN (SELECT DISTINCT doc_id, m FROM o) q ON q.doc_id = e.doc_id LEFT JOIN b y ON y.doc_id = e.doc_id AND y.cut AND y.k + 1 BETWEEN e.least AND e.least + {LOOK - 1} GROUP BY e.doc_id, lo),
p AS (SELECT a.doc_id, a.i AS lo, b.i AS hi FROM o a JOIN o b ON a.doc_id = b.doc_id AND b.k BETWEEN a.k + 1 AND a.k + {LEAST_WORDS - 1} AND b.upto - a.before >= {LEAST_WORDS}),
w AS (SELECT doc_id, lo, min(hi) AS hi FROM p GROUP BY doc_id, lo UNION SELECT doc_id, max(lo), hi FROM p GROUP BY doc_id, hi UNION SELECT f.doc_id, lo, o.i FROM f JOIN o ON o.doc_id = f.doc_id AND o.k = f.k),
t AS (SELECT w.doc_id, lo, hi, array_to_string(string_split(text, chr(10))[lo:hi], chr(10)) AS piece FROM w JOIN documents d ON d.doc_id = w.doc_id),
c AS (SELECT piece, min((doc_id, lo)) AS keeper FROM t GROUP BY piece HAVING count(*) > 1),
g AS (SELECT doc_id, lo, hi, keeper[1] AS kd, keeper[2] AS klo FROM t JOIN c USING (piece) WHERE doc_id <> keeper[1] OR lo >= keeper[2] + (hi - lo + 1)),
s AS (SELECT g.doc_id, lo, hi, w.side, w.d, a.n > 0 AS has, bool_and(coalesce(a.x = z.x, false)) OVER (PARTITION BY g.doc_id, lo, hi, w.side ORDER BY w.d) AS same FROM g, (SELECT side, d FROM (VALUES (1), (-1)) z(side), range(1, {CONTEXT + 1}) q(d)) w
LEFT JOIN n a ON a.doc_id = g.doc_id AND a.i = CASE side WHEN 1 THEN hi + d ELSE lo - d END LEFT JOIN l z ON z.doc_id = kd AND z.i = CASE side WHEN 1 THEN klo + hi - lo + d ELSE klo - d END),
v AS (SELECT g.doc_id, g.lo - coalesce(max(d) FILTER (same AND has AND side = -1), 0) AS lo, g.hi + coalesce(max(d) FILTER (same AND has AND side = 1), 0) AS hi FROM g LEFT JOIN s ON s.doc_id = g.doc_id AND s.lo = g.lo AND s.hi = g.hi GROUP BY g.doc_id, g.lo, g.hi),
x AS (SELECT DISTINCT l.doc_id, l.i FROM l JOIN v ON v.doc_id = l.doc_id AND l.i BETWEEN v.lo AND v.hi),
y AS (SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (x.i IS NOT NULL) AS n_removed_lines, string_agg(l.x, chr(10) ORDER BY l.i) FILTER (x.i IS NULL) AS kept FROM l LEFT JOIN x ON x.doc_id = l.doc_id AND x.i = l.i GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed_lines, 0) AS n_removed_lines, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN y ON y.doc_id = d.doc_id"""
}
