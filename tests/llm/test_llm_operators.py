import base64
import struct

import brute
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tessera.llm import bpe, common, embed_dedup, katz, line_dedup, minhash, mixing, pii, quality, substring_dedup, toxicity
from tessera.llm.suffix import suffix_order


def got(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_quality_counts(docs, texts):
    for i, r in got(quality.judge(docs)).items():
        t, r = texts[i] or "", r["quality"]
        w = brute.WORD.findall(t)
        grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        cover = {p for k, g in enumerate(grams) if grams.count(g) > 1 for p in range(k, k + 8)} if len(grams) < 900 else None
        ls = [x for x in t.split("\n") if brute.WORD.search(x)]
        q = r["q"]
        assert (q["n_words"], q["word_chars"]) == (len(w), sum(map(len, w)))
        assert q["n_symbols"] == sum(c in "#*$%&|<>" for c in t) and q["n_dup_lines"] == len(ls) - len(set(ls))
        if cover is not None:
            assert q["n_repeat_words"] == len(cover)
            assert r["base_failed"] == (len(w) < 20 or 100 * len(cover) > 30 * len(w))


def test_quality_rules_table(spark):
    d = spark.createDataFrame([(1, "### $$$ %%% " * 20), (2, "the cat of the house and the dog is in a garden with trees by the road that goes to town on a hill")], "doc_id bigint, text string")
    r = got(quality.judge(d))
    assert "symbol_ratio" in r[1]["quality"]["failed_rules"] and r[2]["quality"]["kept"]


def test_pii(docs, no_key, texts):
    for i, r in got(pii.spans(docs.select("doc_id", "text"))).items():
        want = brute.pii(texts[i])
        said = ",".join(f"{pii.KINDS[s['kind']]}:{s['start']}:{s['end']}" for s in r["base"])
        assert said == want[4], (i, said, want)
        if not want[4]:
            assert not r["terms"]
    pii.spans(no_key).count()


def test_pii_terms_and_mask(spark):
    rows = [(i, f"Hello from everyone today friends {i}") for i in range(40)]
    rows += [(100 + i, f"call ann@x.org at Zugspitzdorf today {i}") for i in range(3)]
    out = got(pii.sanitise(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert out[100]["sanitised"] == "[REMOVED] [EMAIL] at [REMOVED] today 0" and out[0]["sanitised"] == rows[0][1]


def test_pii_long_runs_do_not_recurse(spark):
    t = ["1 " * 60_000, "a@" + "b." * 60_000 + "c", "x" * 200_000, "+1" * 50_000, "1." * 60_000]
    d = spark.createDataFrame(list(enumerate(t)), "doc_id bigint, text string")
    for r in pii.find(d).collect():
        assert [(pii.KINDS[s["kind"]], s["start"], s["end"]) for s in r["base"]] == [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in brute.pii(t[r["doc_id"]])[4].split(",") if x)]


@pytest.mark.parametrize("short,members", [(32, 256), (1, 3)])
def test_near_duplicates(docs, texts, monkeypatch, short, members):
    monkeypatch.setattr(minhash, "SHORT", short)
    monkeypatch.setattr(minhash, "MEMBERS", members)
    want = brute.near_duplicates(texts)
    for i, r in got(minhash.near_duplicates(docs)).items():
        assert (r["n_shingles"], r["component_id"]) == want[i] and r["kept"] == (i == want[i][1])


def test_near_duplicates_missing_keys(no_key):
    out = minhash.near_duplicates(no_key).collect()
    assert len(out) == no_key.count()


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_of_repeated_keys(spark, seed):
    """Several texts under one doc_id, or under none: each row reaches what its own text reaches, in any row order."""
    import random

    r = random.Random(seed)
    say = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    near = lambda k: say(k) + " tail"
    rows = [(1, say(1)), (1, say(2)), (2, near(2)), (3, near(1)), (None, say(3)), (None, say(4)), (7, near(4)), (8, near(3)), (None, say(5)), (None, near(5)), (9, say(6)), (4, near(6)), (9, say(7)), (9, say(7)), (6, None), (6, say(8))]
    r.shuffle(rows)
    texts = dict(enumerate(t for _, t in rows))
    group, least = {i: c for i, (_, c) in brute.near_duplicates(texts).items()}, {}
    for i, (d, _) in enumerate(rows):
        least[group[i]] = min(least.get(group[i], 1 << 62), 1 << 62 if d is None else d)
    want = sorted((str(d), str(least[group[i]]) if least[group[i]] < 1 << 62 else "None") for i, (d, _) in enumerate(rows))
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(seed)).collect()
    assert sorted((str(x["doc_id"]), str(x["component_id"])) for x in out) == want


def test_word_hashes_tell_words_apart():
    a, b = b"a", b"b"
    for _ in range(12):
        a, b = a + b, b + a  # their power sums modulo 2^64 are equal for every odd base
    ws = [a, b, b"x", b"X", b"x" * 8, b"x" * 9, b"x" * 16, b"x" * 17, b"x" * 7 + b"\0", b"x" * 7, "é".encode(), b"12345678abc", b"abc12345678"]
    h, n = common.word_hashes([b" ".join(ws), b"", b"\t" + a + b"\n"])
    assert n.tolist() == [len(ws), 0, 1] and h[-1] == h[0] and h[2] == h[3]
    assert len(set(h.tolist())) == len(ws) - 1


def test_common_counts():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 60, n).astype(np.uint64)) for n in (5, 40, 40, 3, 50, 33, 60, 60, 60, 60, 44)]
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets]
    got_ = minhash.common_counts(sets, sparse=4, width=7)
    assert all(got_[i, j] == want[i][j] for i in range(len(sets)) for j in range(len(sets)) if i != j)


def test_repeated_substrings(docs, texts):
    want = brute.repeats(texts)
    for i, r in got(substring_dedup.remove_repeats(docs)).items():
        removed = sum(s["end"] - s["start"] for s in r["spans"])
        assert (r["n_bytes"], removed, len(r["spans"]), brute.sha(bytes(r["kept"]))) == want[i]


def test_repeated_substrings_small_batches(docs, texts, no_key, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BATCH", 3000)
    monkeypatch.setattr(substring_dedup, "BUCKET", 2000)
    monkeypatch.setattr(substring_dedup, "ANCHORS", 40)
    monkeypatch.setattr(substring_dedup, "SORTED", 5)
    want = brute.repeats(texts)
    for i, r in got(substring_dedup.remove_repeats(docs)).items():
        assert brute.sha(bytes(r["kept"])) == want[i][3]


def test_repeated_substrings_of_repeated_keys(spark, no_key):
    """Each different text of a key is a document, in the order of its hash; every row gets its text's result."""
    rows = [tuple(r) for r in no_key.select("doc_id", F.coalesce("text", F.lit("")), F.xxhash64(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))).collect()]
    order = sorted({((d is None, d or 0), h, t) for d, t, h in rows})
    want = brute.repeats({i: t for i, (_, _, t) in enumerate(order)})
    number = {(d, t): i for i, (d, _, t) in enumerate(order)}
    out = [(str(r["doc_id"]), r["n_bytes"], brute.sha(bytes(r["kept"]))) for r in substring_dedup.remove_repeats(no_key).collect()]
    assert sorted(out) == sorted((str(d), want[i][0], want[i][3]) for d, t, _ in rows for i in [number[(d is None, d or 0), t]])


@pytest.mark.parametrize("hot", [0, 3])
def test_repeated_substrings_hot_grams(docs, texts, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    want = brute.repeats(texts)
    for i, r in got(substring_dedup.remove_repeats(docs)).items():
        assert brute.sha(bytes(r["kept"])) == want[i][3]


def test_suffix_order_against_sorting():
    r = np.random.default_rng(2)
    rows = [bytes(r.integers(97, 99, r.integers(0, 30)).astype(np.uint8)) for _ in range(200)]
    group = np.sort(r.integers(0, 9, 200))
    lens = np.array(list(map(len, rows)))
    m = np.frombuffer(b"".join(x.ljust(30, b"\0") for x in rows), dtype=np.uint8).reshape(-1, 30)
    order, lcp = suffix_order(m, lens, group)
    assert order.tolist() == sorted(range(200), key=lambda i: (group[i], rows[i], i))
    for k in range(1, 200):
        a, b = rows[order[k - 1]], rows[order[k]]
        want = 0 if group[order[k]] != group[order[k - 1]] else next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert lcp[k] == want


def test_bpe_against_the_library(docs, texts):
    vocab, pattern = bpe.default_vocab()
    with open(vocab, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = got(bpe.decode(bpe.encode(docs, vocab, pattern), vocab, pattern))
    for i, t in texts.items():
        want = lib.encode_ordinary(t or "")
        assert bytes(out[i]["ids"]) == struct.pack(f"<{len(want)}I", *want) and bytes(out[i]["decoded"]).decode() == (t or "")
    for i, r in got(bpe.round_trip(docs, vocab, pattern)).items():
        assert bytes(r["ids"]) == bytes(out[i]["ids"]) and r["n_tokens"] == len(r["ids"]) // 4
        assert r["ids_sha256"] == brute.sha(bytes(r["ids"])) and r["decoded_sha256"] == brute.sha(texts[i] or "")
    assert sorted(bytes(r["ids"]) for r in bpe.encode(docs.select("text"), vocab, pattern).collect()) == sorted(bytes(r["ids"]) for r in out.values())


def test_bpe_odd_texts():
    vocab, pattern = bpe.default_vocab()
    with open(vocab, "rb") as f:
        raw = f.read()
    codec = bpe.Codec(raw, pattern)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    r = np.random.default_rng(4)
    for t in ["".join(chr(c) for c in r.choice([32, 9, 10, 13, 0x85, 0xA0, 0x1C, 0x2028, 0x3000, 39, 115, 0x301, 0x663, 0x4E2D, 0x1F600, 65, 55, 46], 40)) for _ in range(300)] + ["a" * 30_000, " " * 20_000, "abc" * 9000]:
        want = lib.encode_ordinary(t)
        assert codec.encode(t) == struct.pack(f"<{len(want)}I", *want)


def test_mixing(docs, no_key):
    rows = mixing.mix(docs.select("doc_id", "text", "source")).collect()
    size = {s: 0 for s in {r["source"] for r in rows}}
    for r in rows:
        size[r["source"]] += r["size"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    want = brute.targets(size)
    for s in size:
        own = [r for r in rows if r["source"] == s]
        assert all(abs(r["target"] - want[s]) < 1e-6 and r["source_size"] == size[s] for r in own)
        assert abs(sum(r["taken"] for r in own) - want[s]) <= max(2, 0.01 * want[s])
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(docs.select("doc_id", "text", "source").repartition(7)).collect()), key=str)
    assert mixing.mix(no_key).count() == no_key.count()


def test_mixing_quotients(spark):
    d = spark.createDataFrame([(1, 53.0), (2, 24.0), (3, 23.0)], "rank int, target double")
    seats = {r["rank"]: r["seats"] for r in mixing.apportion(d, F.lit(7).cast("long"), "target", ["rank"]).collect()}
    assert seats == {1: 3, 2: 2, 3: 2}


@pytest.mark.parametrize("seed", range(6))
def test_mixing_seats_against_all_quotients(spark, seed):
    import heapq
    import random

    r = random.Random(seed)
    share = [float(r.choice([0, 1, 7, r.randint(1, 10**r.randint(1, 7))])) for _ in range(r.choice([1, 5, 60]))]
    n, want = r.choice([1, 3, 50, 700]), [0] * len(share)
    queue = [(-s, i) for i, s in enumerate(share) if s]
    heapq.heapify(queue)
    for _ in range(n if queue else 0):
        _, i = heapq.heappop(queue)
        want[i] += 1
        heapq.heappush(queue, (-share[i] / (2 * want[i] + 1), i))
    d = spark.createDataFrame(list(enumerate(share)), "rank int, target double")
    assert [x["seats"] for x in mixing.apportion(d, F.lit(n).cast("long"), "target", ["rank"]).orderBy("rank").collect()] == want


def test_line_chunks(docs, texts, no_key):
    out = {r["row"]["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    assert {i: r["kept_text"] for i, r in out.items()} == brute.line_chunks(texts) and any(r["n_removed_lines"] for r in out.values())
    assert line_dedup.dedup_lines(no_key).count() == no_key.count()


@pytest.mark.parametrize("order", [2, 3])
@pytest.mark.parametrize("vocabulary,share", [(12_000_000, 1_500_000), (12_000_000, 300), (0, 300)])
def test_katz(docs, texts, vocabulary, share, order):
    want, _, _, _ = brute.katz(texts, katz.discounts, order)
    out = got(katz.train_and_score(docs.select("doc_id", "text"), ~katz.held_out("doc_id"), vocabulary=vocabulary, share=share, order=order))
    for i, w in want.items():
        r = out[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:3]
        assert r["base_score"] == pytest.approx(w[3], abs=1e-6) and r["score"] == pytest.approx(w[4], abs=1e-6)


@pytest.mark.parametrize("order", [2, 3])
def test_katz_is_normalised(texts, order):
    _, uni, cond, histories = brute.katz(texts, katz.discounts, order)
    for h in histories[:25]:
        assert sum(cond(h, w) for w in uni) + cond(h, "no such word") == pytest.approx(1)


def test_katz_missing_keys(no_key, empty):
    out = katz.train_and_score(no_key, ~katz.held_out("doc_id")).collect()
    assert len(out) == no_key.select("doc_id").distinct().count()
    assert katz.train_and_score(empty, ~katz.held_out("doc_id")).count() == 0


def test_lexicon_against_edit_distances():
    import random

    r = random.Random(5)
    terms = [("idiot", False, 1, False), ("disgusting", False, 2, True), ("scum", False, 0, False), ("worthless", False, 2, False), ("achlich", True, 1, True), ("bomente", True, 0, False), ("clown", False, 1, True)]
    lexicon = toxicity.Lexicon(terms)
    for _ in range(4000):
        w = list(r.choice(terms)[0])
        for _ in range(r.randint(0, 3)):
            i = r.randrange(len(w) + 1)
            w[i : i + r.randint(0, 1)] = r.choice([[], [r.choice("idotscumwrhl")], w[i : i + 2][::-1]])
        w = "".join(w)
        rows = [(min(brute.distance(t, w)[-1]) if s else brute.distance(t, w)[-1][-1], k, mixed) for t, s, k, mixed in terms]
        assert lexicon.look(w) == min((2 * (e > 0) + mixed for e, k, mixed in rows if e <= k), default=None), w
        assert all(toxicity.apart(t, w, s) == e for (t, s, *_), (e, *_) in zip(terms, rows, strict=True))


def test_toxicity_learns_and_tells_mentions(spark):
    import random

    r = random.Random(6)
    vocab = ["".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(2000)]
    rows, labels = [], []
    for i in range(600):
        bad = i % 6 == 0
        w = [r.choice(vocab) for _ in range(40)]
        if bad:
            w.insert(10, r.choice(["blockhead", "nitwit"]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    d, l = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([*labels, (9999, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(d, l)
    assert {t[0] for t in model["terms"]} >= {"blockhead", "nitwit"}
    probe = spark.createDataFrame([(1, "you blokhead go away"), (2, "you nitwitt"), (3, 'he said "blockhead" once'), (4, "kind words"), (5, None)], "doc_id bigint, text string")
    s = {r["doc_id"]: r["score"] for r in toxicity.score(probe, model).collect()}
    assert s[1] >= 0.3 and s[2] >= 0.3 and s[4] < 0.3 and s[5] == s[4] and s[3] < s[1]


def test_toxicity_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r["score"] for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0.0}


def _vectors():
    r = np.random.default_rng(7)
    base = r.standard_normal((150, 16))
    near = [base[k % 10] + 0.12 * r.standard_normal(16) for k in range(60)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate([*base, *near, base[3], base[3], 2 * base[4]])]
    return [*rows, (900, None), (901, []), (902, [0.0] * 16), (903, [1.0, None]), (904, [float("nan")] + [1.0] * 15), (905, [float("inf")] * 16), (906, [1.0, 2.0])]


@pytest.mark.parametrize("block", [512, 4])
def test_embeddings(spark, monkeypatch, block):
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    rows = _vectors()
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<float>, label int")
    good = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if i < 900]
    x = np.array([v for _, v in good])
    x /= np.linalg.norm(x, axis=1)[:, None]
    link = x @ x.T >= 0.95
    np.fill_diagonal(link, False)
    out = got(embed_dedup.near_vectors(df), "vec_id")
    found, there = sum(out[i]["n_links"] for i, _ in good), int(link.sum())
    assert there > 300 and 0.9 * there <= found <= there
    assert all(out[i]["n_links"] <= link[k].sum() for k, (i, _) in enumerate(good))
    assert all(out[i]["n_links"] == 0 and out[i]["kept"] for i in range(900, 907))
    assert len({out[i]["component_id"] for i in (3, 210, 211)}) == 1


def test_empty_tables(spark, empty):
    assert quality.judge(empty).count() == 0
    assert pii.spans(empty).count() == 0 and minhash.near_duplicates(empty).count() == 0
    assert substring_dedup.remove_repeats(empty).count() == 0 and line_dedup.dedup_lines(empty).count() == 0
    assert mixing.mix(empty).count() == 0 and bpe.round_trip(empty, *bpe.default_vocab()).count() == 0
    assert embed_dedup.near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0
