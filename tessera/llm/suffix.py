"""Text algorithms of operator 3 on numpy arrays: anchors of windows, and suffix order by hash comparison."""

from __future__ import annotations

import numpy as np

from tessera.llm.common import Powers, byte_codes, mix, prefix_hash

LENGTH, GRAM = 100, 28
_CODES, _PW = byte_codes(3), Powers(0xD6E8FEB86659FD93)
_CODES2, _PW2 = byte_codes(4), Powers(0xA24BAED4963EE407)  # a second base for contexts


def anchors(data: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Anchors of all windows of `length` bytes in the texts data[begin:end].

    A window's anchor is its gram (of `gram` bytes) with the smallest hash, the leftmost of equal ones: equal windows
    have it at the same place. Windows with one anchor stand side by side. For each anchor: text (index), at (place of
    the gram), lo and hi (first and last window start), h (hash of the gram), c (hash of the context: the bytes of all
    its windows, by two bases, and where the gram stands in them). Places count from the text's begin.
    """
    none = np.empty(0, dtype=np.int64)
    n, w = len(data), length - gram + 1
    if n < length:
        return {"text": none, "at": none, "lo": none, "hi": none, "h": none.view(np.uint64), "c": none.view(np.uint64)}
    h = prefix_hash(data, _CODES, _PW)
    _, down = _PW.get(n + 1)
    grams = mix((h[gram:] - h[:-gram]) * down[: n - gram + 1])
    key = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    rows = -(-len(key) // w)
    block = np.full(rows * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    block[: len(key)] = key
    block = block.reshape(rows, w)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    back = np.ascontiguousarray(np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1]).ravel()
    starts = n - length + 1
    low = np.minimum(back[:starts], ahead[w - 1 : w - 1 + starts]) & np.uint64(0xFFFFFFFF)
    del block, ahead, back, key
    ok = np.zeros(starts + 1, dtype=np.int32)  # window starts inside one text
    has = end - begin >= length
    np.add.at(ok, begin[has], 1)
    np.add.at(ok, end[has] - length + 1, -1)
    place = np.flatnonzero(np.cumsum(ok[:-1]) > 0)
    at = low[place].astype(np.int64)
    cut = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (place[1:] != place[:-1] + 1)))) if len(at) else none
    last = np.concatenate((cut[1:], [len(at)])) - 1 if len(at) else none
    at, lo, hi = at[cut], place[cut], place[last]
    text = np.searchsorted(begin, lo, side="right") - 1
    one = mix((h[hi + length] - h[lo]) * down[lo])
    del h
    h = prefix_hash(data, _CODES2, _PW2)
    two = mix((h[hi + length] - h[lo]) * _PW2.get(n + 1)[1][lo])
    c = mix(mix(one * np.uint64(3) + two) + (at - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (hi - lo).astype(np.uint64))
    b = begin[text]
    return {"text": text, "at": at - b, "lo": lo - b, "hi": hi - b, "h": grams[at], "c": c}


def lce(h: np.ndarray, lens: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Longest common extension of rows i and j: binary search over prefix hashes, both cut at the shorter row."""
    low, high = np.zeros(len(i), dtype=np.int64), np.minimum(lens[i], lens[j])
    while (open_ := low < high).any():
        mid = (low + high + 1) >> 1
        same = h[i, mid] == h[j, mid]
        low = np.where(open_ & same, mid, low)
        high = np.where(open_ & ~same, mid - 1, high)
    return low


def less(m: np.ndarray, h: np.ndarray, lens: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether row i comes before row j; equal rows by number, and a row before its extensions."""
    d = lce(h, lens, i, j)
    short = np.minimum(lens[i], lens[j])
    at = np.minimum(d, m.shape[1] - 1)
    a, b = m[i, at], m[j, at]
    return np.where(d < short, a < b, np.where(lens[i] != lens[j], lens[i] < lens[j], i < j))


def suffix_order(m: np.ndarray, lens: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): rows of the padded byte matrix m sorted inside each group, groups as they stand (contiguous).

    Bottom-up mergesort of all groups at once. In a merge each row's place is its own rank plus its rank in the other
    run, found by binary search; each comparison is an LCE by hashes. lcp[k] is the common prefix of order[k - 1] and
    order[k], 0 where a group begins. Neighbours are compared byte by byte in the end; if a hash has lied, the order is
    made by bytes.
    """
    n, width = m.shape
    codes, pw = byte_codes(5), Powers(0xA0761D6478BD642F)
    up, _ = pw.get(width)
    h = np.zeros((n, width + 1), dtype=np.uint64)
    np.cumsum(codes[m] * up, axis=1, out=h[:, 1:])
    h = mix(h)
    begin = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if n else np.empty(0, dtype=np.int64)
    size = np.diff(np.concatenate((begin, [n])))
    first, count = np.repeat(begin, size), np.repeat(size, size)
    order = np.arange(n)
    step = 1
    while step < (size.max() if n else 0):
        at = np.flatnonzero(count > step)  # places in groups that this pass still merges
        local = at - first[at]
        run = local // (2 * step) * (2 * step)
        left = local - run < step
        lo = np.where(left, np.minimum(run + step, count[at]), run)
        hi = np.where(left, np.minimum(run + 2 * step, count[at]), run + step)
        own = order[at]
        a, b = lo.copy(), hi.copy()
        while (open_ := a < b).any():
            live = np.flatnonzero(open_)
            mid = (a[live] + b[live]) >> 1
            before = less(m, h, lens, order[first[at[live]] + mid], own[live])
            a[live] = np.where(before, mid + 1, a[live])
            b[live] = np.where(before, b[live], mid)
        rank = local - np.where(left, run, run + step) + (a - lo)
        new = order.copy()
        new[first[at] + run + rank] = own
        order, step = new, 2 * step
    lcp = np.zeros(n, dtype=np.int64)
    inner = np.ones(n, dtype=bool)
    inner[begin] = False
    k = np.flatnonzero(inner)
    i, j = order[k - 1], order[k]
    lcp[k] = lce(h, lens, i, j)
    differ = (m[i] != m[j]) | (np.arange(width) >= np.minimum(lens[i], lens[j])[:, None])
    true = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    if not np.array_equal(true, lcp[k]):
        rows = [bytes(r[:x]) for r, x in zip(m, lens, strict=True)]
        order = np.array(sorted(range(n), key=lambda r: (first[r], rows[r], r)), dtype=np.int64)
        i, j = order[k - 1], order[k]
        differ = (m[i] != m[j]) | (np.arange(width) >= np.minimum(lens[i], lens[j])[:, None])
        lcp[k] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return order, lcp


def repeated_windows(contexts: list[bytes], at: np.ndarray, lo: np.ndarray, hi: np.ndarray, group: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, lo, hi): runs of window starts whose windows occur in an earlier row of the same group.

    Rows are contexts (bytes from lo to hi + length) in the order of the texts, groups contiguous. A window that begins r
    bytes before the gram is r bytes to the left and length - r to the right; it equals another if it shares both with
    it. Suffix orders of the right sides and of the reversed left sides turn either into class numbers for each r.
    """
    n = len(contexts)
    right, left = [c[a - s :] for c, a, s in zip(contexts, at, lo, strict=True)], [c[: a - s][::-1] for c, a, s in zip(contexts, at, lo, strict=True)]

    def ordered(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lens = np.fromiter(map(len, rows), dtype=np.int64, count=n)
        width = max(1, int(lens.max()))
        m = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), dtype=np.uint8).reshape(n, width)
        return *suffix_order(m, lens, group), lens

    (ro, rl, _), (lo_, ll, _) = ordered(right), ordered(left)
    r_lo, r_hi = at - hi, at - lo
    out = []
    for r in range(int(r_lo.min()), int(r_hi.max()) + 1):
        rc, lc = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
        rc[ro], lc[lo_] = np.cumsum(rl < length - r), np.cumsum(ll < r) if r else np.cumsum(np.concatenate(([True], group[1:] != group[:-1])))
        rows = np.flatnonzero((r_lo <= r) & (r <= r_hi))
        _, kept = np.unique(rc[rows] * (n + 1) + lc[rows], return_index=True)
        again = np.ones(len(rows), dtype=bool)
        again[kept] = False
        out.append((rows[again], (at - r)[rows[again]]))
    row, start = np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])
    o = np.lexsort((start, row))
    row, start = row[o], start[o]
    if not len(row):
        return row, start, start
    cut = np.concatenate(([True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)))
    first = np.flatnonzero(cut)
    last = np.concatenate((first[1:], [len(row)])) - 1
    return row[first], start[first], start[last]
