"""Operator 11: licence notices and licence expressions.

Words are runs of letters and digits (the contract's class, A-Z lower-cased). An Aho-Corasick automaton over words finds every
place of every phrase at once: notice phrases, which name a licence, and tags, which announce an expression. Words of
the automaton are known by their first and last eight bytes and their length, which tell words of up to 16 bytes exactly;
any other word sends the automaton back to its root, so only runs of known words are walked, all runs of a batch in step.
Behind a tag and a colon (or =) a shunting-yard parser reads identifiers, parentheses and the operators with, and, or
(binding in this order) and evaluates what it reads: `or` is as free as its freer side, `and` as its stricter side, `with` an
exception goes half of the way to full freedom. FREEDOM gives a known licence's own value. A notice phrase is an operand by itself.

score = 1 - the freedom of all notices and expressions of a text together (`and`): 0 with none or free ones, 1 where all rights are
reserved. Labels are the phrases' labels and the expressions' known identifiers.

Scale: one narrow pass over Arrow batches, no shuffle, nothing broadcast but the fixed tables. A text over PIECE bytes is
scanned in pieces that overlap by as many words as the longest phrase can need, so memory follows the piece, not the text.

Defined results: null is as empty: no words, no labels, score 0; places may overlap and all count; an operator without operand, a
closing parenthesis too many or a second identifier in a row ends an expression before it; an open parenthesis closes
at the end; an expression without a known licence is none; unknown operands beside known ones have UNKNOWN freedom and no
label; repeated rows are rows of their own; an empty table gives an empty result. Clashing names don't matter: what is kept
of the row is packed in a struct.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import by_bytes, mix, packed, raw, spread, table

PIECE, UNKNOWN = 1 << 20, 0.2

#: Fixed by the contract.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Further notice phrases.
NOTICES = {
    "apache license version 2 0": "apache-2.0",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "isc license": "isc",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "dedicated to the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
#: What announces an expression, if a colon or = follows.
TAGS = ["spdx license identifier", "license expression", "license", "licence"]
#: How freely a work may be used under each licence: by its conditions, not by opinion of its worth.
FREEDOM = {
    1.0: "mit mit-0 apache apache-2.0 bsd bsd-2-clause bsd-3-clause 0bsd isc zlib bsl-1.0 python-2.0 unlicense cc0-1.0 public-domain cc-by cc-by-3.0 cc-by-4.0 ncsa postgresql x11 wtfpl",
    0.7: "mpl mpl-1.1 mpl-2.0 lgpl lgpl-2.1 lgpl-3.0 epl epl-1.0 epl-2.0 cddl-1.0 eupl-1.2 cc-by-sa cc-by-sa-3.0 cc-by-sa-4.0 odbl-1.0",
    0.4: "gpl gpl-2.0 gpl-3.0",
    0.3: "agpl agpl-3.0 sspl-1.0",
    0.1: "cc-by-nc cc-by-nc-4.0 cc-by-nc-sa cc-by-nc-sa-4.0 cc-by-nd cc-by-nd-4.0 cc-by-nc-nd cc-by-nc-nd-4.0",
    0.0: "all-rights-reserved proprietary unlicensed",
}
_FREE = {name: value for value, names in FREEDOM.items() for name in names.split()}


def freedom(name: str) -> float | None:
    """A licence's freedom, later versions allowed or not; None for one that isn't known."""
    return _FREE.get(name, _FREE.get(re.sub(r"(-only|-or-later|\+)$", "", name)))


class Automaton:
    """Aho-Corasick over words: goto as a dense table of states and word numbers (0: any other word), outputs by state."""

    def __init__(self, phrases: list[str]):
        split = [p.split() for p in phrases]
        self.sizes = [len(p) for p in split]
        self.longest = max(self.sizes)
        words = sorted({w for p in split for w in p})
        if any(len(w.encode()) > 16 for w in words):
            raise ValueError("words of phrases may have 16 bytes at most")
        number = {w: k for k, w in enumerate(words, 1)}
        tree: list[dict[int, int]] = [{}]
        own: list[list[int]] = [[]]
        for k, p in enumerate(split):
            at = 0
            for w in p:
                if number[w] not in tree[at]:
                    tree[at][number[w]] = len(tree)
                    tree.append({})
                    own.append([])
                at = tree[at][number[w]]
            own[at].append(k)
        self.goto = np.zeros((len(tree), len(words) + 1), dtype=np.int32)
        fail, queue = [0] * len(tree), deque([0])
        while queue:  # breadth first: what a state fails to is complete before it
            at = queue.popleft()
            own[at] = own[at] + (own[fail[at]] if at else [])
            self.goto[at] = self.goto[fail[at]] if at else 0
            for w, to in tree[at].items():
                fail[to] = int(self.goto[fail[at], w]) if at else 0
                queue.append(to)
            for w, to in tree[at].items():
                self.goto[at, w] = to
        self.out = own
        self.tells = np.array([bool(o) for o in own])
        self.rows = self.goto.tolist()
        first, last, size = (np.array(x, dtype=np.uint64) for x in zip(*(_ends(w.encode()) for w in words), strict=True))
        code = _code(first, last, size)
        order = np.argsort(code)
        self.codes, self.ends, self.number = code[order], (first[order], last[order], size[order]), order.astype(np.int32) + 1

    def numbers(self, first: np.ndarray, last: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The number of each word, 0 for those that are in no phrase."""
        at = np.minimum(np.searchsorted(self.codes, _code(first, last, size)), len(self.codes) - 1)
        same = (self.ends[0][at] == first) & (self.ends[1][at] == last) & (self.ends[2][at] == size)
        return np.where(same, self.number[at], 0)

    def walk(self, words: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, state) wherever a phrase ends; `begins` marks words that open a text."""
        if not len(words):
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        known = words > 0
        before = np.concatenate(([False], known[:-1]))
        start = np.flatnonzero(known & (~before | begins))
        stop = np.concatenate((known[1:] & ~begins[1:], [False]))
        length = np.flatnonzero(known & ~stop) - start + 1
        state, step = np.zeros(len(start), dtype=np.int32), 0
        at, states = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        while len(start) > 32:
            state = self.goto[state, words[start + step]]
            told = self.tells[state]
            at.append((start + step)[told])
            states.append(state[told])
            step += 1
            more = length > step
            start, length, state = start[more], length[more], state[more]
        for s, n, x in zip(start.tolist(), length.tolist(), state.tolist(), strict=True):
            hits = []
            for k, w in enumerate(words[s + step : s + n].tolist(), s + step):
                x = self.rows[x][w]
                if self.out[x]:
                    hits.append((k, x))
            if hits:
                a, b = zip(*hits, strict=True)
                at.append(np.array(a, np.int64))
                states.append(np.array(b, np.int32))
        return np.concatenate(at), np.concatenate(states)


def _ends(word: bytes) -> tuple[int, int, int]:
    first, last = word[:8], word[max(0, len(word) - 8) :]
    return int.from_bytes(first, "little"), int.from_bytes(last, "little"), len(word)


def _code(first: np.ndarray, last: np.ndarray, size: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(first * np.uint64(0x9E3779B97F4A7C15) + mix(last + size * np.uint64(0xC2B2AE3D27D4EB4F)))


#: Fixed by the contract: what is no part of a word.
_WORD = np.ones(256, dtype=bool)
for _low, _high in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    _WORD[_low : _high + 1] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INSIDE = _WORD[_LOWER].tolist()  # of a text as it stands
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def scan(automaton: Automaton, texts: list[bytes]) -> tuple[list[int], list[list[tuple[int, int, int]]]]:
    """The number of words of each text, and its places (first word, phrase, byte where the phrase ends)."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n" * 9, dtype=np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], _WORD[data]))))
    begin, end = edge[0::2], edge[1::2]
    size = end - begin
    block = np.ndarray((len(data) - 8,), dtype="<u8", buffer=data, strides=(1,))
    mask = _MASK[np.minimum(size, 8)]
    words = automaton.numbers(block[begin] & mask, block[begin + np.maximum(size - 8, 0)] & mask, size.astype(np.uint64))
    offset = np.cumsum(sizes + 1) - (sizes + 1)
    upto = np.searchsorted(begin, offset + sizes + 1)
    first = np.concatenate(([0], upto[:-1]))
    begins = np.zeros(len(words) + 1, dtype=bool)
    begins[first] = True
    at, states = automaton.walk(words, begins[:-1])
    order = np.argsort(at, kind="stable")
    at, states = at[order], states[order]
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    of = np.searchsorted(upto, at, side="right")
    for k, t, e, s in zip((at - first[of]).tolist(), of.tolist(), (end[at] - offset[of]).tolist(), states.tolist(), strict=True):
        found[t].extend((k - automaton.sizes[p] + 1, p, e) for p in automaton.out[s])
    return (upto - first).tolist(), found


def scan_long(automaton: Automaton, text: bytes, piece: int = PIECE) -> tuple[int, list[tuple[int, int, int]]]:
    """The same of one text of any length, piece by piece."""
    total, found, at = 0, [], 0
    while at < len(text):
        to = min(len(text), at + piece)
        while to < len(text) and _INSIDE[text[to]]:
            to += 1
        back, over = at, 0
        while over < automaton.longest - 1 and back > 0:
            while back > 0 and not _INSIDE[text[back - 1]]:
                back -= 1
            over += back > 0
            while back > 0 and _INSIDE[text[back - 1]]:
                back -= 1
        (n,), (some,) = scan(automaton, [text[back:to]])
        found += [(total - over + w, p, back + e) for w, p, e in some if w + automaton.sizes[p] > over]
        total, at = total + n - over, to
    return total, found


# ---- expressions ----

_BEFORE = re.compile(rb"[\x20\t\"']*[:=][\x20\t\"']*")
_TOKEN = re.compile(rb"[\x20\t]*([()]|[0-9A-Za-z][0-9A-Za-z.+-]*)")
_BINDS = {"or": 1, "and": 2, "with": 3}


def _tokens(text: bytes, at: int) -> Iterator[str]:
    while m := _TOKEN.match(text, at):
        at = m.end()
        yield m[1].decode().lower().rstrip(".-") or "-"


def parse(tokens: Iterator[str]) -> list[str]:
    """The longest expression that the tokens begin with, in postfix order (shunting-yard); empty if there is none."""
    out: list[str] = []
    held: list[str] = []
    operand, closed = True, 0  # what may come next; parentheses that are open
    for t in tokens:
        if operand:
            if t == "(":
                held.append(t)
                closed += 1
            elif t == ")" or t in _BINDS:
                break
            else:
                out.append(t)
                operand = False
        elif t == ")" and closed:
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
            closed -= 1
        elif t in _BINDS:
            while held and held[-1] != "(" and _BINDS[held[-1]] >= _BINDS[t]:
                out.append(held.pop())
            held.append(t)
            operand = True
        else:
            break
    while operand and held:  # an operator or parenthesis without an operand behind it
        operand = held.pop() == "("
    return out + [t for t in reversed(held) if t != "("]


def evaluate(postfix: list[str]) -> tuple[float, list[str]] | None:
    """(freedom, known licences) of an expression; None if it knows no licence."""
    stack: list[float] = []
    known: list[str] = []
    exceptions: set[int] = {k - 1 for k, t in enumerate(postfix) if t == "with"}
    for k, t in enumerate(postfix):
        if t in _BINDS:
            b, a = stack.pop(), stack.pop()
            stack.append({"or": max(a, b), "and": min(a, b), "with": (1 + a) / 2}[t])
        else:
            f = freedom(t)
            if f is not None and k not in exceptions:
                known.append(t)
            stack.append(UNKNOWN if f is None else f)
    return (stack[0], known) if known else None


PHRASES = [*BASE, *NOTICES, *TAGS]
_LABELS = [*BASE.values(), *NOTICES.values()]
_KIND = "n_words bigint, places array<struct<word:bigint,phrase:string,label:string,base:boolean>>, expressions array<struct<word:bigint,postfix:string,labels:array<string>,freedom:double>>"
_PLACES = pa.list_(pa.struct([("word", pa.int64()), ("phrase", pa.string()), ("label", pa.string()), ("base", pa.bool_())]))
_EXPRESSIONS = pa.list_(pa.struct([("word", pa.int64()), ("postfix", pa.string()), ("labels", pa.list_(pa.string())), ("freedom", pa.float64())]))


def _told(text: bytes, found: list[tuple[int, int, int]]) -> tuple[list[dict], list[dict]]:
    places, expressions, read = [], [], {}
    for word, p, end in sorted(found):
        if p < len(_LABELS):
            places.append({"word": word, "phrase": PHRASES[p], "label": _LABELS[p], "base": p < len(BASE)})
        elif (m := _BEFORE.match(text, end)) and end not in read:  # one tag may end within another
            read[end] = word
            postfix = parse(_tokens(text, m.end()))
            if value := evaluate(postfix):
                expressions.append({"word": word, "postfix": " ".join(postfix), "labels": value[1], "freedom": value[0]})
    return places, expressions


def notices(docs: DataFrame, text: str = "text", keep: list[str] | None = None, piece: int = PIECE) -> DataFrame:
    """(row, n_words, places, expressions) of every row: `keep` names what of the row is kept, all by default.

    places: array of (word, phrase, label, base) of notice phrases by their first word; expressions: array of (word of the tag, postfix, labels,
    freedom).
    """
    kept = packed(docs) if keep is None else F.struct(*(F.col(f"`{c}`") for c in keep))
    source = docs.select(kept.alias("row"), F.col(f"`{text}`").alias("text"))
    kind = f"row {source.schema['row'].dataType.simpleString()}, {_KIND}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(PHRASES)
        for whole in batches:
            for b in by_bytes(whole, [1], piece):
                texts = raw(b.column(1))
                short = [t if len(t) <= piece else b"" for t in texts]
                many, found = scan(automaton, short)
                for k, t in enumerate(texts):
                    if len(t) > piece:
                        many[k], found[k] = scan_long(automaton, t, piece)
                places, expressions = zip(*(_told(t, f) for t, f in zip(texts, found, strict=True)), strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(many, pa.int64()), pa.array(places, _PLACES), pa.array(expressions, _EXPRESSIONS)], names=["row", "n_words", "places", "expressions"])

    return source.mapInArrow(run, kind)


def score(places: Column, expressions: Column) -> Column:
    """1 - the freedom of all notices and expressions together."""
    by_label = {n: v for v, names in FREEDOM.items() for n in names.split() if n in _LABELS}
    table_ = F.create_map(*(F.lit(x) for kv in sorted(by_label.items()) for x in kv))
    least = lambda a, x: F.least(a, x)
    said = F.aggregate(F.transform(places, lambda p: F.coalesce(F.try_element_at(table_, p["label"]), F.lit(UNKNOWN))), F.lit(1.0), least)
    return 1 - F.aggregate(F.transform(expressions, lambda e: e["freedom"]), said, least)


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def license_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns of docs(doc_id, text)."""
    out = notices(docs, keep=["doc_id"])
    base = F.filter("places", lambda p: p["base"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    named = lambda places: F.transform(places, lambda p: p["label"])
    words = F.transform(base, lambda p: p["word"])
    return out.select(
        "row.doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(words).alias("first_word"),
        F.array_max(words).alias("last_word"),
        joined(named(base)).alias("base_labels"),
        joined(F.concat(named(F.col("places")), F.flatten(F.transform("expressions", lambda e: e["labels"])))).alias("labels"),
        score(F.col("places"), F.col("expressions")).alias("score"),
        F.size("expressions").cast("long").alias("n_expressions"),
    )


QUERIES = {"op11_licenses": op11_licenses}
#: The parser has no SQL; tests/llm compare the query with a brute-force version.
ORACLES: dict[str, str] = {}
