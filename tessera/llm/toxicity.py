"""Operator 9: toxicity by a lexicon trie, Levenshtein automata and context windows.

Training rows (crc32 of doc_id mod 4 is not 2) give a lexicon: words, and stems (prefixes of MIN_STEM letters or more),
whose document frequencies differ by label more than chance allows (likelihood ratio). Copies would count a word again
and again, so documents of one label whose KIN smallest shingle hashes are equal count once. The lexicon becomes a trie; a word of a text is
caught if the Levenshtein automaton (with transpositions) of a path of the trie accepts it; a term allows only as many
edits as catch next to nothing in training rows of label 0. Each hit is weighed by its context window: inside quotation
marks or after a word of saying or naming it is a mention and counts MENTION, else 1. A logistic model over the sums of
weights turns hits into a score.

Bound (a parameter): the lexicon and the model are fitted on at most FIT labelled rows, those with the smallest hashes of
doc_id; a term of the lexicon is in LEAST_DOCS of them or more, so their words bound it. Both are broadcast. Scoring covers whole texts of all rows without a shuffle;
a worker keeps what it knows of words, and the states of the automaton, in bounded caches.

Defined results: null and empty texts score as texts without hits; repeated rows are scored each; labels that are null
are no training rows; without training rows of both labels the score is the share of label 1 (0 without any); an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import packed, spread, table
from tessera.llm.minhash import shingle_sets

FIT, MIN_STEM, MAX_STEM, RATIO, LEAST_DOCS, PURE, KIN = 8_000, 5, 9, 26.0, 6, 0.75, 4
MENTION, REACH, AT, CACHE, STATES, TOLERATED = 0.25, 4, 0.3, 200_000, 50_000, 0.0005
STRIP = ".,;:!?\"'()[]{}<>|*%&$#~`´’‘“”«»„…-–—_/\\"
OPEN_QUOTES, CLOSE_QUOTES, BOTH_QUOTES = "“«„‘", "”»’", "\""
#: Words of saying and naming that turn a term into a mention.
SAYING = frozenset("said says say saying wrote writes called quoted quotes quote quoting word words term terms slur insult phrase reads named so-called dit écrit mot sagte schrieb wort dijo escribió palabra".split())


def edits(term: str, stem: bool) -> int:
    """Edits a term allows: words of 5 letters one, of 8 two, stems of 7 one, shorter ones none."""
    n = len(term)
    return int(n >= 7) if stem else 2 if n >= 8 else int(n >= 5)


def apart(term: str, word: str, stem: bool) -> int:
    """Edits, with transpositions, from a term to a word, of a stem to the nearest beginning of the word."""
    rows = [list(range(len(word) + 1))]
    for i, c in enumerate(term, 1):
        row = [i]
        for j, x in enumerate(word, 1):
            d = min(rows[-1][j] + 1, row[j - 1] + 1, rows[-1][j - 1] + (c != x))
            if i > 1 and j > 1 and c == word[j - 2] and term[i - 2] == x:
                d = min(d, rows[-2][j - 2] + 1)
            row.append(d)
        rows.append(row)
    return min(rows[-1]) if stem else rows[-1][-1]


class Lexicon:
    """Trie of terms, and the product of its paths with Levenshtein automata as a lazily determinised automaton.

    Terms are (term, is a stem, edits allowed, is mixed); mixed ones are rare or also stand in texts without label 1. A match has a rank:
    0 exact, 1 exact of a mixed term, 2 and 3 the same with edits. A place is (node, pending letter of a transposition); a
    state of the product holds the fewest edits at each place and the best rank of a stem passed. States and transitions are made when a word first needs them and kept, so a word costs a few
    dictionary lookups; most words die within four letters.
    """

    def __init__(self, terms: list[tuple]):
        self.children: list[dict[str, int]] = [{}]
        self.most = [0]  # edits allowed by any term below a node
        self.ends: list[list[tuple[bool, int, bool]]] = [[]]  # (is a stem, edits, is mixed) of the terms that end in a node
        for term, stem, *rest in terms:
            k, mixed = (*rest, False)[:2] if rest else (edits(term, stem), False)
            node = 0
            self.most[0] = max(self.most[0], k)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.most.append(0)
                    self.ends.append([])
                node = self.children[node][c]
                self.most[node] = max(self.most[node], k)
            self.ends[node].append((stem, k, mixed))
        self.reset()

    def reset(self) -> None:
        self.moves: list[dict[str, int]] = []
        self.places: list[tuple] = []
        self.verdicts: list[int | None] = []
        self.number: dict[tuple, int] = {}
        self.start = self._state({(0, ""): 0}, 9)

    def _state(self, at: dict[tuple[int, str], int], stem: int) -> int:
        """Number of the state with these places, after skipping letters of terms; -1 if it can't accept any more."""
        todo = list(at.items())
        while todo:
            (node, wait), e = todo.pop()
            if wait or at.get((node, wait)) != e:
                continue
            for child in self.children[node].values():
                if e + 1 <= self.most[child] and e + 1 < at.get((child, ""), 9):
                    at[child, ""] = e + 1
                    todo.append(((child, ""), e + 1))
        ranks = [(own, 2 * (e > 0) + mixed) for (node, wait), e in at.items() if not wait for own, k, mixed in self.ends[node] if e <= k]
        stem = min([stem, *(r for own, r in ranks if own)])
        key = (tuple(sorted((n, w, e) for (n, w), e in at.items())), stem)
        if not key[0] and stem == 9:
            return -1
        if key not in self.number:
            self.number[key] = len(self.moves)
            self.moves.append({})
            self.places.append((at, stem))
            best = min([stem, *(r for _, r in ranks)])
            self.verdicts.append(None if best == 9 else best)
        return self.number[key]

    def _move(self, state: int, c: str) -> int:
        places, stem = self.places[state]
        at: dict[tuple[int, str], int] = {}

        def put(node: int, wait: str, e: int) -> None:
            if e <= self.most[node] and e < at.get((node, wait), 9):
                at[node, wait] = e

        for (node, wait), e in places.items():
            if wait:
                if c == wait:
                    put(node, "", e)
                continue
            put(node, "", e + 1)  # a letter too many
            for x, child in self.children[node].items():
                put(child, "", e + (x != c))
                if x != c and c in self.children[child]:  # two letters changed places: x must follow
                    put(self.children[child][c], x, e + 1)
        return self._state(at, stem)

    def look(self, word: str) -> int | None:
        """Rank of the best match of a word."""
        if len(self.moves) > STATES:
            self.reset()
        state, moves = self.start, self.moves
        for c in word:
            nxt = moves[state].get(c)
            if nxt is None:
                nxt = moves[state][c] = self._move(state, c)
            if nxt < 0:
                return None
            state = nxt
        return self.verdicts[state]


FEATURES = 4  # by rank


class Scorer:
    def __init__(self, terms: list[tuple[str, bool]]):
        self.lexicon, self.clean, self.hits = Lexicon(terms), set(), {}

    def fuzzy(self, text: str) -> set[str]:
        """Words of a text that match a term with edits only."""
        ws = {t.strip(STRIP) for t in text.lower().split()}
        return {w for w in ws if (self.lexicon.look(w) or 0) > 1}

    def features(self, text: str) -> list[float]:
        tokens = text.lower().split()
        for raw in set(tokens) - self.clean:
            if raw not in self.hits:
                if (found := self.lexicon.look(raw.strip(STRIP))) is None:
                    if len(self.clean) >= CACHE:
                        self.clean.clear()
                    self.clean.add(raw)
                else:
                    if len(self.hits) >= CACHE:
                        self.hits.clear()
                    self.hits[raw] = found
        out = [0.0] * FEATURES
        at = [i for i, t in enumerate(tokens) if t in self.hits] if self.hits and not self.hits.keys().isdisjoint(tokens) else []
        for i in at:
            out[self.hits[tokens[i]]] += MENTION if mention(tokens, i) else 1.0
        return [math.log1p(x) if k & 1 else x / (x + 0.5) for k, x in enumerate(out)]  # of mixed terms, the number tells


def mention(tokens: list[str], i: int) -> bool:
    """Whether the term at i is quoted or named: a quotation opens within REACH words before it and closes within REACH
    words after it, or a word of saying or naming stands within REACH words before it."""
    before, after, own = tokens[max(0, i - REACH) : i], tokens[i + 1 : i + 1 + REACH], tokens[i]
    opens = own[0] in OPEN_QUOTES + BOTH_QUOTES + "'" or any(t[0] in OPEN_QUOTES + BOTH_QUOTES + "'" for t in before)
    ends = lambda t: t.rstrip(".,;:!?")[-1:] in (*CLOSE_QUOTES, *BOTH_QUOTES, "'")
    return opens and (ends(own) or any(map(ends, after))) or any(t.strip(STRIP) in SAYING for t in before)


def _texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, stem, label, n): documents of the batch, one for each family, that have the term."""
    for b in batches:
        texts = _texts(b.column(1))
        counts: dict[tuple[str, bool, int], int] = Counter()
        for text, label in zip(texts, b.column(0).to_pylist(), strict=True):
            ws = {t.strip(STRIP) for t in text.lower().split()}
            ws = {w for w in ws if len(w) >= 4 and w.isalpha()}
            counts.update((w, False, label) for w in ws)
            counts.update((p, True, label) for p in {w[:k] for w in ws for k in range(MIN_STEM, min(MAX_STEM, len(w)) + 1)})
        yield pa.RecordBatch.from_arrays([pa.array([k[j] for k in counts], ty) for j, ty in enumerate((pa.string(), pa.bool_(), pa.int32()))] + [pa.array(list(counts.values()), pa.int64())], names=["term", "stem", "label", "n"])


def _families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = shingle_sets([(x or "").encode() for x in b.column(2).to_pylist()])
        family = [int.from_bytes(hashlib.blake2b(s[:KIN].tobytes(), digest_size=8).digest(), "little", signed=True) for s in sets]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(family, pa.int64())], names=["doc_id", "label", "text", "family"])


def ratio(a, b, na, nb) -> float:
    """Log-likelihood ratio of a of na against b of nb, 0 if the first share is the smaller."""
    if a * nb <= b * na:
        return 0.0
    p, part = (a + b) / (na + nb), lambda k, n, q: (k * math.log(q) if k else 0) + ((n - k) * math.log(1 - q) if n - k else 0)
    return 2 * (part(a, na, a / na) + part(b, nb, b / nb) - part(a, na, p) - part(b, nb, p)) if 0 < p < 1 else 0.0


def _ratio(a, b, na: int, nb: int):
    """The same as a Column."""
    part = lambda k, n, q: F.when(k > 0, k * F.log(q)).otherwise(0.0) + F.when(n - k > 0, (n - k) * F.log(1 - q)).otherwise(0.0)
    p = (a + b) / (na + nb)
    told = 2 * (part(a, F.lit(na), a / na) + part(b, F.lit(nb), b / nb) - part(a, F.lit(na), p) - part(b, F.lit(nb), p))
    return F.when((a * nb <= b * na) | (p <= 0) | (p >= 1), 0.0).otherwise(told)


def choose(counts: list[tuple[str, bool, int, int]], n1: int, n0: int) -> list[tuple[str, bool, int, bool]]:
    """Terms (term, stem, edits, mixed) from (term, stem, documents of label 1, of label 0), strongest first; none is a
    prefix of another."""
    scored = [(round(ratio(a, b, n1, n0), 6), len(t), not stem, t, stem, b > 0 or a < 0.05 * n1) for t, stem, a, b in counts if a + b >= LEAST_DOCS and a >= PURE * (a + b)]
    out: list[tuple[str, bool, int, bool]] = []
    chosen, begun = set(), set()  # terms, and all their beginnings
    for r, _, _, t, stem, mixed in sorted(scored, key=lambda x: (-x[0], -x[1], not x[2], x[3])):  # of equal ones the longest
        if r >= RATIO and t not in begun and not any(t[:k] in chosen for k in range(1, len(t))):
            chosen.add(t)
            begun.update(t[:k] for k in range(1, len(t) + 1))
            out.append((t, stem, edits(t, stem), mixed))
    return out


def _fuzzy_words(said):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer([tuple(t) for t in json.loads(said.value)])
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([w for t in _texts(b.column(1)) for w in scorer.fuzzy(t)], pa.string())], names=["word"])

    return run


def restrain(terms: list[tuple], near: list[tuple[str, int]], most: float) -> list[tuple]:
    """terms with as many edits as catch words of at most `most` training documents without label 1; near: such words."""
    out = []
    for term, stem, k, mixed in terms:
        at = Counter()
        for word, n in near:
            if k and abs(len(word) - len(term)) <= k or k and stem and len(word) > len(term):
                d = apart(term, word, stem)
                at[d] += n if d <= k else 0
        while k and sum(at[d] for d in range(1, k + 1)) > most:
            k -= 1
        out.append((term, stem, k, mixed))
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.2, steps: int = 50) -> np.ndarray:
    """Weights (bias first) by Newton steps; the ridge leaves the bias free."""
    x = np.column_stack([np.ones(len(x)), x])
    w, r = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    r[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(r), x.T @ (y - p) - r * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT, key: str = "doc_id", text: str = "text", label: str = "toxic") -> dict:
    """Model {terms, weights} from at most `rows` labelled training rows."""
    spark = docs.sparkSession
    chosen = labels.where(F.col(label).isin(0, 1)).where(~held_out(key)).select(F.col(key).alias("_id"), F.col(label).cast("int").alias("label"))
    chosen = chosen.dropDuplicates(["_id"]).orderBy(F.xxhash64("_id"), "_id").limit(rows)
    train = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "label", "text")
    families = train.mapInArrow(_families, "doc_id bigint, label int, text string, family bigint").groupBy("family", "label").agg(F.min_by("text", "doc_id").alias("text")).select("label", "text").repartition(24).persist()
    try:
        n = {r["label"]: r["n"] for r in families.groupBy("label").agg(F.count("*").alias("n")).collect()}
        n1, n0 = n.get(1, 0), n.get(0, 0)
        if not n1 or not n0:
            return {"terms": [], "weights": None, "share": float(n1 > 0)}
        one = lambda k: F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0))
        counts = families.mapInArrow(_terms, "term string, stem boolean, label int, n bigint").groupBy("term", "stem").agg(one(1).alias("a"), one(0).alias("b"))
        counts = counts.where((F.col("a") + F.col("b") >= LEAST_DOCS) & (F.col("a") >= PURE * (F.col("a") + F.col("b"))))
        counts = counts.where(_ratio(F.col("a"), F.col("b"), n1, n0) >= RATIO - 1e-6)
        terms = choose([tuple(r) for r in counts.collect()], n1, n0)
        near = families.where("label = 0").mapInArrow(_fuzzy_words(spark.sparkContext.broadcast(json.dumps(terms))), "word string").groupBy("word").agg(F.count("*").alias("n"))
        terms = restrain(terms, [tuple(r) for r in near.collect()], TOLERATED * n0)
        said = spark.sparkContext.broadcast(json.dumps(terms))

        def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = Scorer([tuple(t) for t in json.loads(said.value)])
            for b in batches:
                x = np.array([scorer.features(t) for t in _texts(b.column(1))], dtype=np.float64).reshape(-1, FEATURES)
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x[:, j]) for j in range(FEATURES))], names=["label", *(f"f{j}" for j in range(FEATURES))])

        got = families.mapInArrow(features, "label int, " + ", ".join(f"f{j} double" for j in range(FEATURES))).groupBy("label", *(f"f{j}" for j in range(FEATURES))).agg(F.count("*").alias("n")).collect()
    finally:
        families.unpersist()
    got = sorted(map(tuple, got))
    x = np.repeat(np.array([r[1:-1] for r in got]), [r[-1] for r in got], axis=0)
    y = np.repeat(np.array([r[0] for r in got], dtype=float), [r[-1] for r in got])
    return {"terms": terms, "weights": tame(logistic(x, y)), "share": n1 / (n1 + n0)}


def tame(w: np.ndarray) -> list[float]:
    """A hit never speaks against toxicity, and a hit with edits, rare in training, weighs most of an exact one of a pure term,
    a quarter of one of a mixed term, where training says less."""
    w = w.copy()
    w[1:] = np.maximum(w[1:], 0)
    w[3] = max(w[3], 0.8 * w[1])
    w[4] = max(w[4], 0.25 * w[2])
    return [float(v) for v in w]


def held_out(key: str):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2


_SCORERS: dict[str, Scorer] = {}


def score(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """docs with the column score (0 to 1)."""
    said = docs.sparkSession.sparkContext.broadcast(json.dumps(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = json.loads(said.value)
        if said.value not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[said.value] = Scorer([tuple(t) for t in m["terms"]])
        scorer, w = _SCORERS[said.value], m["weights"] and np.array(m["weights"])
        for b in batches:
            x = np.array([scorer.features(t) for t in _texts(b.column(1))], dtype=np.float64).reshape(-1, FEATURES)
            s = np.full(len(x), m["share"]) if w is None else 1 / (1 + np.exp(-(w[0] + x @ w[1:])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], names=["row", "score"])

    rows = docs.select(packed(docs, (text, "score")).alias("row"), F.col(text).alias("text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())])).select("row.*", "score")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= AT).cast("int").alias("predicted"))


QUERIES = {"op9_toxicity": op9_toxicity}
ORACLES: dict[str, str] = {}
