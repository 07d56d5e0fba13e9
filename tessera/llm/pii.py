"""Operator 1: information-theoretic sanitisation.

Personal data (email, ip, card, phone) is found by pattern in every whole text. Then the corpus tells which terms give
it away: for a protected entity e and a term t that stands within WINDOW code points of e, with document counts n_e, n_t
(anywhere in the text), n_et (t in a window of e) and D documents,

    disclosure(t, e) = PMI(t, e) / IC(e) = log2(n_et D / (n_e n_t)) / log2(D / n_e)

is 1 where t never occurs without e. Terms at or above REMOVE are removed, terms at or above GENERALISE are replaced by
their word class; a pair counts from LEAST documents on. Base spans always stay; spans of terms come on top.

All steps are Columns, joins and aggregations. Counts are combined before each shuffle, so an entity or a term in a third
of all rows is one row for each task. Only (entity, term) pairs and counts are shuffled, texts only by `sanitise`.

Defined results: null and empty texts have no spans; a match that fails its check is dropped without another try; an
entity that is in every document has no information and discloses nothing; repeated rows, rows that share a key and rows without
one are documents each, with spans of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import packed, spread, Stash, table
from tessera.llm.quality import let

#: Matches whose places are summed up at once: the cost of a text follows their number times this.
BLOCK = 128
KINDS = ["email", "ip", "card", "phone", "term"]
WINDOW, LEAST, GENERALISE, REMOVE = 48, 2, 0.8, 0.95

# The contract's patterns in forms that neither recurse nor start anew inside a run: possessive where nothing could be
# given back, and begun only where a run begins or the last match ended. card starts only where 13 digits follow.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?:(?<![0-9])(?<![0-9][\x20-])|\G)[0-9](?:[\x20-]?[0-9]){12}(?:[\x20-]?[0-9])*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"\p{L}{4,}"


def locate(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of a pattern's leftmost matches, in code points, end exclusive."""
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def place(found: Column) -> Column:
        def laid(steps: Column) -> Column:
            part = lambda k: F.slice(steps, k * BLOCK + 1, BLOCK)
            size = lambda k: F.aggregate(part(k), F.lit(0), lambda a, s: a + s["gap"] + F.length(s["m"]))

            def add(a: Column, s: Column) -> Column:
                start = a["at"] + s["gap"]
                end = start + F.length(s["m"])
                return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(start.alias("start"), end.alias("end"), s["m"].alias("value")))).alias("out"))

            def within(begins: Column) -> Column:
                return F.flatten(F.transform(begins, lambda at, k: F.aggregate(part(k), F.struct(at.alias("at"), none.alias("out")), add, lambda a: a["out"])))

            blocks = F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int"))
            first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
            begins = F.aggregate(blocks, first, lambda a, k: F.struct((a["at"] + size(k)).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
            return let(begins, within)

        gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
        return F.when(F.size(found) == 0, none).otherwise(let(F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("m")), laid))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def base_spans(text: Column) -> Column:
    """Array of (kind, start, end, value) by kind as in KINDS, then start. value is normalised."""
    none = F.array().cast("array<struct<kind:int,start:int,end:int,value:string>>")
    t = F.coalesce(text, F.lit(""))
    octets = lambda m: F.forall(F.split(m, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3) & F.forall(F.split(m, r"\."), lambda p: F.lpad(F.ltrim(p, F.lit("0")), 3, "0") <= "255")
    tests = [
        (EMAIL, t.contains("@"), lambda m: F.lit(True), F.lower),
        (IP, t.rlike(r"[0-9]\.[0-9]"), octets, lambda m: m),
        (CARD, t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), lambda m: F.length(_digits(m)).between(13, 19) & F.call_function("luhn_check", _digits(m)), _digits),
        (PHONE, t.contains("+"), lambda m: F.length(_digits(m)).between(9, 15), _digits),
    ]
    def one(k: int, pattern: str, may: Column, ok, value) -> Column:
        kept = F.filter(locate(t, pattern), lambda s: ok(s["value"]))
        named = F.transform(kept, lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), value(s["value"]).alias("value")))
        return F.when(may, named).otherwise(none)

    return F.concat(*(one(k, *x) for k, x in enumerate(tests)))


def _near(text: Column, spans: Column, window: int) -> Column:
    """Array of (kind, value, term, start, end): terms wholly inside the window of a span and outside all base spans."""

    def side(s: Column, w: Column, low: Column, high: Column, cut_low: bool) -> Column:
        def terms(piece: Column) -> Column:
            def whole(x: Column) -> Column:  # a term that touches the window's outer border may go on beyond it
                return (x["start"] > 0) | (low == 0) if cut_low else (x["end"] < F.length(piece)) | (high >= w["size"])

            return F.transform(
                F.filter(locate(piece, TERM), whole),
                lambda x: F.struct(s["kind"].alias("kind"), s["value"].alias("value"), F.lower(x["value"]).alias("term"), (low + x["start"]).alias("start"), (low + x["end"]).alias("end")),
            )

        return let(F.substring(text, low + 1, high - low), terms)

    def around(s: Column, size: Column) -> Column:
        def outside(w: Column) -> Column:
            def free(terms: Column) -> Column:  # spans are looked through only where there are terms
                apart = lambda close: F.filter(terms, lambda x: ~F.exists(close, lambda o: (o["start"] < x["end"]) & (x["start"] < o["end"])))
                return F.when(F.size(terms) == 0, terms).otherwise(let(F.filter(spans, lambda o: (o["start"] < w["high"]) & (w["low"] < o["end"])), apart))

            return let(F.concat(side(s, w, w["low"], s["start"], True), side(s, w, s["end"], w["high"], False)), free)

        low, high = F.greatest(F.lit(0), s["start"] - window), F.least(size, s["end"] + window)
        return let(F.struct(low.alias("low"), high.alias("high"), size.alias("size")), outside)

    return let(F.length(text), lambda size: F.flatten(F.transform(spans, lambda s: around(s, size))))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, base, near): the base spans of each row and the terms around them."""
    out = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_t")).withColumn("base", base_spans(F.col("_t")))
    near = F.when(F.size("base") == 0, F.array().cast("array<struct<kind:int,value:string,term:string,start:int,end:int>>")).otherwise(_near(F.col("_t"), F.col("base"), window))
    return out.select(key, "base", near.alias("near"))


def disclosure(docs: DataFrame, found: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """(kind, value, term, n_e, n_t, n_et, disclosure) of all pairs that share at least `least` documents."""
    pair = found.select(F.explode(F.array_distinct(F.transform("near", lambda x: F.struct(x["kind"].alias("kind"), x["value"].alias("value"), x["term"].alias("term"))))).alias("p"))
    pair = pair.groupBy("p.kind", "p.value", "p.term").agg(F.count("*").alias("n_et")).where(F.col("n_et") >= least)
    entity = found.select(F.explode(F.array_distinct(F.transform("base", lambda x: F.struct(x["kind"].alias("kind"), x["value"].alias("value"))))).alias("e"))
    entity = entity.groupBy("e.kind", "e.value").agg(F.count("*").alias("n_e"))
    term = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(TERM), F.lit(0)))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    total = docs.agg(F.count("*").alias("d"))
    ic = F.log2(F.col("d") / F.col("n_e"))
    pmi = F.log2(F.col("n_et") * F.col("d") / (F.col("n_e") * F.col("n_t")))
    return pair.join(term, "term").join(entity, ["kind", "value"]).join(F.broadcast(total)).withColumn("disclosure", F.when(ic > 0, pmi / ic)).drop("d")


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, least: int = LEAST, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """(key, base, terms) of every row; terms: array of (start, end, action) with action remove or generalise."""
    stash = Stash(docs.sparkSession)
    found = stash.keep(find(docs, key, text, window), "_row")
    known = disclosure(docs, found, text, least).where(F.col("disclosure") >= generalise)
    known = known.select("kind", "value", "term", F.when(F.col("disclosure") >= remove, "remove").otherwise("generalise").alias("action"))
    told = (
        found.select(F.col("_row").alias("_id"), F.explode("near").alias("x"))
        .select("_id", "x.*")
        .join(known, ["kind", "value", "term"])
        .groupBy("_id", "start", "end")
        .agg(F.max("action").alias("action"))  # remove wins over generalise
        .groupBy("_id")
        .agg(F.sort_array(F.collect_list(F.struct("start", "end", "action"))).alias("terms"))
    )
    none = F.array().cast("array<struct<start:int,end:int,action:string>>")
    return found.join(told, F.col("_row") == F.col("_id"), "left").select(key, "base", F.coalesce("terms", none).alias("terms"))


def mask(text: Column, base: Column, terms: Column) -> Column:
    """The text with base spans as [KIND], removed terms as [REMOVED] and generalised ones as [NAME] or [WORD]."""
    named = F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(F.get(F.array(*map(F.lit, KINDS)), s["kind"])), F.lit("]")).alias("label")))
    initial = lambda s: F.substring(text, s["start"] + 1, F.lit(1))
    told = F.transform(terms, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["action"] == "remove", "[REMOVED]").when(initial(s) != F.lower(initial(s)), "[NAME]").otherwise("[WORD]").alias("label")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def add(a: Column, s: Column) -> Column:  # spans of different kinds may overlap: the earlier label covers them
        new = F.concat(a["out"], F.array(F.substring(text, a["at"] + 1, s["start"] - a["at"]), s["label"]))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] < a["at"], a["out"]).otherwise(new).alias("out"))

    return F.aggregate(F.sort_array(F.concat(named, told)), start, add, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))


def sanitise(docs: DataFrame, text: str = "text", **settings) -> DataFrame:
    """docs with `base`, `terms` and `sanitised` in the place of columns of these names."""
    rows = docs.select(packed(docs).alias("row"), F.col(f"`{text}`").alias("whole"))
    out = spans(rows, "row", "whole", **settings)
    own = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c.lower() not in ("base", "terms", "sanitised")]
    whole = F.col(f"row.`{text}`")
    return out.select(*own, "base", "terms", F.when(F.size("base") == 0, whole).otherwise(mask(whole, F.col("base"), F.col("terms"))).alias("sanitised"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spans(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    said = lambda s, kind: F.concat_ws(":", kind, s["start"].cast("string"), s["end"].cast("string"))
    base = F.transform("base", lambda s: said(s, F.get(F.array(*map(F.lit, KINDS)), s["kind"])))
    terms = F.transform("terms", lambda s: said(s, F.lit("term")))
    return out.select(
        "doc_id",
        *(count(k).alias(f"n_{KINDS[k]}") for k in range(4)),
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, terms), ",").alias("spans"),
        F.size("terms").cast("long").alias("n_term"),
    )


QUERIES = {"op1_pii": op1_pii}
ORACLES: dict[str, str] = {}
