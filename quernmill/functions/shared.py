"""Pairs of keys that share items, counted in arrays: the search within one pair of key blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_MOST = 1 << 22  # pairs held at a time


class _Side:
    """Rows (key, item, value) of one block by key and item; items are numbered from the most frequent."""

    def __init__(self, x: np.ndarray, y: np.ndarray, v: np.ndarray | None, drop: int):
        order = np.lexsort((y, x))
        self.y, self.v = y[order], None if v is None else v[order]
        self.keys, first, self.n = np.unique(x[order], return_index=True, return_counts=True)
        self.first = first
        self.key = np.repeat(np.arange(len(self.keys)), self.n)
        self.used = np.flatnonzero(np.arange(len(order)) - first[self.key] >= drop)
        self.by_item = self.used[np.argsort(self.y[self.used], kind="stable")]


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, .. (n[0] numbers), start[1], ..: all ranges one after the other."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _candidates(left: _Side, right: _Side, need: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of keys that share at least `need` used items, and how many; within one block each pair once."""
    items = right.y[right.by_item]
    mine = left.y[left.used]
    to = np.searchsorted(items, mine, "right")
    if left is right:  # partners after the key itself
        at = np.empty(len(left.y), np.int64)
        at[left.by_item] = np.arange(len(left.by_item))
        since = at[left.used] + 1
    else:
        since = np.searchsorted(items, mine, "left")
    n, key, other = to - since, left.key[left.used], right.key[right.by_item]
    rows = np.searchsorted(key, np.arange(len(left.keys) + 1))
    ends = np.concatenate([[0], np.cumsum(n)])[rows]
    k = 0
    while k < len(left.keys):
        stop = max(int(np.searchsorted(ends, ends[k] + _MOST, "right")) - 1, k + 1)
        own = slice(rows[k], rows[stop])
        if ends[stop] - ends[k] > _MOST:  # one key with many partners: a counter for each
            counts = np.zeros(len(right.keys), np.int64)
            for r in range(rows[k], rows[stop]):
                counts[other[since[r] : to[r]]] += 1
            b = np.flatnonzero(counts >= need)
            yield np.full(len(b), k), b, counts[b]
        elif ends[stop] > ends[k]:
            code = np.repeat(key[own], n[own]) * len(right.keys) + other[_ranges(since[own], n[own])]
            code.sort()
            first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            times = np.diff(first, append=len(code))
            first, times = first[times >= need], times[times >= need]
            yield code[first] // len(right.keys), code[first] % len(right.keys), times
        k = stop


def _count(small: _Side, large: _Side, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """a, b, n and with values the sums of x, y, xy, xx, yy over the common items: the items of `a` are looked up under `b`."""
    width = int(max(small.y.max(), large.y.max())) + 1
    held = large.key * width + large.y
    ends = np.concatenate([[0], np.cumsum(small.n[a])])
    k = 0
    while k < len(a):
        stop = max(int(np.searchsorted(ends, ends[k] + _MOST, "right")) - 1, k + 1)
        ca, cb = a[k:stop], b[k:stop]
        rows = _ranges(small.first[ca], small.n[ca])
        code = np.repeat(cb, small.n[ca]) * width + small.y[rows]
        at = np.minimum(np.searchsorted(held, code), len(held) - 1)
        hit = held[at] == code
        pair = np.repeat(np.arange(len(ca)), small.n[ca])[hit]
        n = np.bincount(pair, minlength=len(ca))
        sums = []
        if small.v is not None:
            x, y = small.v[rows[hit]], large.v[at[hit]]
            sums = [np.bincount(pair, w, len(ca)) for w in (x, y, x * y, x * x, y * y)]
        yield ca, cb, n, *sums
        k = stop


def shared_items(one: tuple, two: tuple | None, least: int, threshold: float = 0.0) -> Iterator[tuple[np.ndarray, ...]]:
    """a < b, n (and with values sx, sy, sxy, sxx, syy) of the keys of two blocks, or of one, that share at least `least` items; all rows are distinct in (key, item).

    With a threshold only those whose Jaccard similarity reaches it; the rows must be all of
    each key then. Each key leaves out its most frequent items, all but one or two of the `least`: of the
    items that two keys share, they leave out only as many of the most frequent, so that one
    (two, from a `least` of 3) remains of a pair wanted. An item that most keys hold makes no
    candidates by itself. What is met is counted exactly, by the key with fewer items; where
    nothing is left out it is counted already.
    """
    need = 2 if least > 2 else 1
    left = _Side(*one, least - need)
    right = left if two is None else _Side(*two, least - need)
    if not len(left.y) or not len(right.y):
        return
    for a, b, times in _candidates(left, right, need):
        if least == need and left.v is None:
            parts = [(left, right, (a, b, times))]
        else:
            fewer = left.n[a] <= right.n[b]
            parts = [(left, right, c) for c in _count(left, right, a[fewer], b[fewer])] + [(right, left, c) for c in _count(right, left, b[~fewer], a[~fewer])]
        for x, y, (p, q, n, *sums) in parts:
            good = (n >= least) & (n / (x.n[p] + y.n[q] - n) >= threshold)
            p, q, n, *sums = x.keys[p[good]], y.keys[q[good]], n[good], *[s[good] for s in sums]
            if sums:
                turn, (sx, sy, sxy, sxx, syy) = p > q, sums
                sums = [np.where(turn, sy, sx), np.where(turn, sx, sy), sxy, np.where(turn, syy, sxx), np.where(turn, sxx, syy)]
            yield np.minimum(p, q), np.maximum(p, q), n, *sums


class LeastHashes:
    """The min-hash signatures of the keys of rows (key, rank of the item): the least (a * r + b) % prime of each key."""

    def __init__(self, x: np.ndarray, r: np.ndarray, parameters: list[tuple[int, int]], prime: int):
        order = np.argsort(x, kind="stable")
        self.keys, first = np.unique(x[order], return_index=True)
        r = r[order]
        self.h = [np.minimum.reduceat((a * r + b) % prime, first).astype(np.int32) for a, b in parameters] if len(r) else []

    def agree(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of keys, whether they have a hash in common."""
        a, b = np.searchsorted(self.keys, a), np.searchsorted(self.keys, b)
        rest = np.arange(len(a))
        for h in self.h:
            rest = rest[h[a[rest]] != h[b[rest]]]
        out = np.ones(len(a), bool)
        out[rest] = False
        return out


def distinct_words(u: np.ndarray, d: np.ndarray, docs: np.ndarray, n_words: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each user of the rows (u, d) and the number of distinct codes in all documents of the user; docs[k] has the next n_words[k] codes."""
    by_doc, order = np.argsort(docs), np.argsort(u, kind="stable")
    u, d = u[order], d[order]
    at = by_doc[np.minimum(np.searchsorted(docs[by_doc], d), len(docs) - 1)]
    start, n = (np.cumsum(n_words) - n_words)[at], np.where(docs[at] == d, n_words[at], 0)
    users, rows = np.unique(u, return_index=True)
    rows, width = np.append(rows, len(u)), int(codes.max(initial=0)) + 1
    ends, out = np.concatenate([[0], np.cumsum(n)])[rows], np.zeros(len(users), np.int64)
    k = 0
    while k < len(users):
        stop = max(int(np.searchsorted(ends, ends[k] + _MOST, "right")) - 1, k + 1)
        own = slice(rows[k], rows[stop])
        if stop == k + 1:
            held = np.zeros(width, bool)
            for r in range(rows[k], rows[stop]):
                held[codes[start[r] : start[r] + n[r]]] = True
            out[k] = held.sum()
        else:
            code = np.repeat(np.repeat(np.arange(stop - k), np.diff(rows[k : stop + 1])), n[own]) * width + codes[_ranges(start[own], n[own])]
            code.sort()
            out[k:stop] = np.bincount(code[np.concatenate([[True], code[1:] != code[:-1]])[: len(code)]] // width, minlength=stop - k)
        k = stop
    return users, out
