"""Plain versions of the operators, one document at a time."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def luhn(d: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(d)):
        x = int(c) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def pii(text):
    t, spans = text or "", []
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    for kind, pattern, ok in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ):
        spans += [(kind, m.start(), m.end()) for m in re.finditer(pattern, t) if ok(m)]
    n = Counter(k for k, _, _ in spans)
    return n["email"], n["ip"], n["card"], n["phone"], ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def near_duplicates(docs: dict, percent=85):
    """{id: (set size, component)}"""
    sets = {}
    for i, t in docs.items():
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = set(zip(*[w[j:] for j in range(5)], strict=False)) if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


def repeats(docs: dict, length=100):
    """{id: (bytes, removed, spans, sha of the rest)}"""
    seen, out = set(), {}
    for i in sorted(docs):
        b = (docs[i] or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        out[i] = len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return out


def line_chunks(docs: dict, every=2, least_words=12, span=16, look=32, context=16):
    """{id: kept text}: chunks between boundary pairs, repeated ones extended to both sides."""
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    lines = {i: t.split("\n") for i, t in docs.items() if t is not None}
    count = {i: [len(WORD.findall(x)) for x in ls] for i, ls in lines.items()}
    places = defaultdict(list)
    for i, ls in lines.items():
        own = [k for k, n in enumerate(count[i]) if n]
        r = [md5(md5(ls[a]) + md5(ls[b])) for a, b in zip(own, own[1:], strict=False)]
        cut = [int(x[:8], 16) < 2**32 // every or x == min(r[max(0, k - span + 1) : k + 1]) for k, x in enumerate(r)]
        for k in range(len(own)):
            if k and not (k < len(cut) and cut[k]):
                continue
            least = next((j for j in range(k + 1, min(len(own), k + max(2, least_words))) if sum(count[i][own[x]] for x in range(k, j + 1)) >= least_words), None)
            if least is not None:
                last = next((j for j in range(least, min(least + look, len(own))) if cut[j - 1]), min(least + look - 1, len(own) - 1))
                places["\n".join(ls[own[k] : own[last] + 1])].append((i, own[k], own[last]))
    gone = defaultdict(set)
    for at in places.values():
        d, lo, hi = min(at)
        for i, a, z in at:
            if i == d and a <= hi:
                continue
            for step, mine, first in ((-1, a, lo), (1, z, hi)):
                far = 0
                for n in range(1, context + 1):
                    x, y = mine + step * n, first + step * n
                    if not (0 <= x < len(lines[i]) and 0 <= y < len(lines[d]) and lines[i][x] == lines[d][y]):
                        break
                    far = n if count[i][x] else far
                a, z = (a - far, z) if step < 0 else (a, z + far)
            gone[i].update(range(a, z + 1))
    return {i: t if i not in gone else "\n".join(x for k, x in enumerate(lines[i]) if k not in gone[i]) for i, t in docs.items()}


def katz(docs: dict, discounts, order=3, cut=5):
    """{id: (tokens, known, N, base, score)} and the model's parts for a test of its sums."""
    toks = {i: WORD.findall((t or "").translate(LOWER)) + ["</s>"] for i, t in docs.items()}
    train = [i for i in toks if zlib.crc32(str(i).encode()) % 7 != 2]
    uni, seen = Counter(w for i in train for w in toks[i]), [defaultdict(Counter) for _ in range(order + 1)]
    grams = lambda t, k: (((*["<s>"] * (k - 1), *t)[j : j + k - 1], w) for j, w in enumerate(t))
    for k in range(2, order + 1):
        for i in train:
            for h, w in grams(toks[i], k):
                seen[k][h][w] += 1
    total, size = sum(uni.values()), len(uni)
    of = lambda counts: [0] + [sum(v == k for v in counts) for k in range(1, cut + 2)]
    du, ds = discounts(of(uni.values())), [discounts(of([c for v in s.values() for c in v.values()])) for s in seen]
    d = lambda t, c: 1.0 if c > cut else t[c]
    left = sum((1 - du[c]) * c * of(uni.values())[c] for c in range(1, cut + 1)) / total if total else 1.0
    scale, p0 = (1.0, left) if left > 0 else (total / (total + 1), 1 / (total + 1))
    weights = {}

    def cond(h, w):
        k = len(h) + 1
        if k == 1:
            return scale * d(du, uni[w]) * uni[w] / total if w in uni else p0
        after = seen[k].get(h)
        if not after:
            return cond(h[1:], w)
        full = sum(after.values()) + (min(after.values()) > cut)
        if w in after:
            return d(ds[k], after[w]) * after[w] / full
        if h not in weights:
            weights[h] = (1 - sum(d(ds[k], c) * c for c in after.values()) / full) / (1 - sum(cond(h[1:], x) for x in after))
        return weights[h] * cond(h[1:], w)

    out = {}
    for i, t in toks.items():
        base = sum(math.log10((uni.get(w, 0) + 1) / (total + size + 1)) for w in t)
        out[i] = len(t), sum(w in uni for w in t), total, base, sum(math.log10(cond(h, w)) for h, w in grams(t, order))
    return out, uni, cond, list(seen[order])


def targets(sizes: dict, most=3):
    """Water-filling by sharing what is over again and again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > most * sizes[s] + 1e-9]
        if not over:
            return fixed | share
        fixed |= {s: float(most * sizes[s]) for s in over}


def distance(a: str, b: str) -> int:
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d
