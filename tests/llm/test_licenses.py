import os
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import licenses as L

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id bigint, text string, row string, n_words int, places int, word string"


def climb(tokens, least=1):
    """(freedom, known names, tokens used) of the longest expression, by precedence climbing; None if there is none."""
    binds = {"or": 1, "and": 2, "with": 3}
    if not tokens:
        return None
    if tokens[0] == "(":
        inner = climb(tokens[1:])
        if not inner:
            return None
        value, names, n = inner
        n += 1
        if n < len(tokens) and tokens[n] == ")":
            n += 1
        elif n < len(tokens):
            return value, names, -n  # broken off: what is read so far, and no more
    elif tokens[0] in (")", *binds):
        return None
    else:
        f = L.freedom(tokens[0])
        value, names, n = (L.UNKNOWN, [], 1) if f is None else (f, [tokens[0]], 1)
    while n < len(tokens) and tokens[n] in binds and binds[tokens[n]] >= least:
        op = tokens[n]
        right = climb(tokens[n + 1 :], binds[op] + 1)
        if not right:
            return value, names, -n
        b, more, used = right
        simple = sum(t not in "()" for t in tokens[n + 1 : n + 1 + abs(used)]) == 1
        value = {"or": max(value, b), "and": min(value, b), "with": (1 + value) / 2}[op]
        names = names + ([] if op == "with" and simple else more)
        if used < 0:
            return value, names, -(n + 1 - used)
        n += 1 + used
    return value, names, n


def brute(text):
    t = (text or "").translate(LOWER)
    found = [(m[0], m.end()) for m in WORD.finditer(t)]
    words = [w for w, _ in found]
    base, labels, free = [], [], 1.0
    tagged = set()
    for i in range(len(words)):
        for p, label in [*L.BASE.items(), *L.NOTICES.items()]:
            if words[i : i + len(p.split())] == p.split():
                labels.append(label)
                free = min(free, L.freedom(label) if L.freedom(label) is not None else L.UNKNOWN)
                if p in L.BASE:
                    base.append((i, label))
        for tag in L.TAGS:
            if words[i : i + len(tag.split())] == tag.split():
                tagged.add(found[i + len(tag.split()) - 1][1])
    for at in tagged:
        line = t[at:].split("\n")[0]
        m = re.match(r"[\x20\t\"']*[:=][\x20\t\"']*", line)
        if not m:
            continue
        tokens, k = [], m.end()
        while x := re.compile(r"[\x20\t]*([()]|[0-9a-z][0-9a-z.+-]*)").match(line, k):
            tokens.append(x[1].rstrip(".-") or "-")
            k = x.end()
        got = climb(tokens)
        if got and got[1]:
            labels += got[1]
            free = min(free, got[0])
    join = lambda x: ",".join(sorted(set(x)))
    at = [i for i, _ in base]
    return len(words), len(base), min(at, default=None), max(at, default=None), join([x for _, x in base]), join(labels), round(1 - free, 9)


def told(df):
    return [(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], round(r["score"], 9)) for r in df.collect()]


PIECES = [*L.BASE, *L.NOTICES, *L.TAGS, "SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0 */", '"license": "LGPL-3.0+"', "license = foo or mit", "License: see file", "mit", "MIT", "GNU", "gnu general", "public license", "é", "mitä", "-", "\n", "cc by cc by nc", "license: ((gpl-3.0", "license: mit or", "license: mit) and", "license: mit and (or)"]


def make(seed, n):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        text = ""
        for _ in range(r.randrange(14)):
            p = r.choice([*PIECES, "lorem ipsum dolor", "x" * 40])
            text += (p.upper() if r.random() < 0.3 else p.replace(" ", r.choice([" ", "  ", "-", ".\n", "\t"]), 1) if r.random() < 0.3 else p) + r.choice([" ", "\n", ", ", ". "])
        out.append(text)
    return out


def test_against_brute_force(spark):
    texts = [None, "", "   \n", "MIT License", "mit license mit license", "amit license", "mit\x00license", "mit " * 5000 + "license", "cc by " * 3000, "é" * 3000 + " apache license"] + make(3, 400)
    df = spark.createDataFrame([(i, t, "r", 1, 2, "w") for i, t in enumerate(texts)] + [(None, "apache license", "r", 1, 2, "w"), (3, "MIT License", "r", 1, 2, "w")], SCHEMA)
    want = [(i, *brute(t)) for i, t in enumerate(texts)] + [(None, *brute("apache license")), (3, *brute("MIT License"))]
    assert sorted(told(L.license_digest(df)), key=str) == sorted(want, key=str)


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 60))
def test_long_texts_in_pieces(seed, piece):
    text = "\n".join(make(seed, 3)).encode()
    a = L.Automaton(L.PHRASES)
    (n,), (found,) = L.scan(a, [text])
    total, some = L.scan_long(a, text, piece)
    assert total == n and sorted(some) == sorted(found)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["mit", "gpl-2.0", "foo", "and", "or", "with", "(", ")"]), max_size=9))
def test_parser_against_precedence_climbing(tokens):
    got, want = L.evaluate(L.parse(iter(tokens))), climb(tokens)
    if not want or not want[1]:
        assert got is None
    else:
        assert got and abs(got[0] - want[0]) < 1e-12 and sorted(got[1]) == sorted(want[1])


def test_rows_and_spans_are_kept(spark):
    r = L.notices(spark.createDataFrame([(1, "x MIT License\nlicense: MIT OR GPL-3.0", "own", 7, 8, "w")], SCHEMA)).collect()[0]
    assert r["row"]["row"] == "own" and r["row"]["n_words"] == 7 and r["n_words"] == 9
    assert [(p["word"], p["phrase"], p["base"]) for p in r["places"]] == [(1, "mit license", True)]
    assert [(e["word"], e["postfix"], e["freedom"]) for e in r["expressions"]] == [(3, "mit gpl-3.0 or", 1.0)]


def test_empty_table(spark):
    assert told(L.license_digest(spark.createDataFrame([], SCHEMA))) == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(told(L.op11_licenses(spark, SF)), key=str) == sorted([(i, *brute(t)) for i, t in rows], key=str)
