import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, q int, h bigint, _text string, size int, kept boolean, value int, a int, ids string, score string, base int"


def make_rows(seed: int = 3):
    """Documents with nulls everywhere, copies, near copies, shared passages, long texts, personal data, junk."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefgéöñ") for _ in range(r.randint(2, 8))) for _ in range(300)]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    passage = "\n".join(say(14) for _ in range(8))
    texts = [say(r.randint(1, 120)) + r.choice(["", "\n" + say(20)]) for _ in range(60)]
    texts += [texts[0]] * 3 + [texts[5] + " tail", texts[5]]
    base = say(150).split()
    for k in range(14):
        w = list(base)
        for _ in range(k % 5):
            w[r.randrange(len(w))] = r.choice(vocab)
        texts.append(" ".join(w))
    texts += [say(15) + "\n" + passage + "\n" + say(12) for _ in range(8)]
    texts += ["", "   \n\t ", None, "One", "a b c d", "x " * 400, "é" * 5000, "ab" * 3000 + " " + "1" * 3000, "The   THE\tthe\x0bthe " * 30]
    texts += ["mail bob.smith@corp.example.com or 10.0.0.1 now " + say(5), "card 4111 1111 1111 1111 and +49 (30) 123-4567 " + say(4), "a@b a@b.c_d@e.f 1.2.3.4.5 300.1.1.1 4111111111111112 +1"]
    texts += ["bob.smith@corp.example.com lives in Zugspitzdorf near here"] * 2
    rows = []
    for i, t in enumerate(texts):
        rows.append((i * 3 + 1, t, r.choice(["en", None]), r.choice(["s1", "s1", "s1", "s2", "s3", None, ""]), None if t is None else len(t), "x", 1, 2, "t", 3, None, 4, 5, "i", "s", 6))
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def texts(rows):
    return {x[0]: x[1] for x in rows}


@pytest.fixture(scope="session")
def no_key(spark, rows):
    """The same with rows without doc_id and repeated rows."""
    more = [(None, *rows[0][1:]), (None, "another text " * 20, *rows[0][2:]), rows[3], rows[3]]
    return spark.createDataFrame(rows + more, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
