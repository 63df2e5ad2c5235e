"""Suffix arrays by induced sorting, in array operations, and permuted common prefixes.

Suffixes are smaller (S) or larger (L) than their successor; a leftmost-smaller (LMS) suffix is
an S one after an L one. Sorted LMS suffixes induce the order of all others in two sweeps over
the symbol buckets. A sweep moves whole stretches of a bucket at once: what a stretch induces in
its own bucket forms the next stretch. Sorting LMS substrings is the same sweep with LMS suffixes in
text order; their names form a shorter text, which is sorted by recursion while its alphabet
is small and by doubling ranks otherwise.
"""

from __future__ import annotations

import numpy as np

from .anchored import Roller, mixed

SMALL_ALPHABET = 600


def _larger_or_smaller(t: np.ndarray) -> np.ndarray:
    """True for S. The last symbol is a unique smallest one."""
    n = len(t)
    change = np.where(t[:-1] != t[1:], np.arange(n - 1), n - 1)
    nearest = np.minimum.accumulate(change[::-1])[::-1]  # the next place where neighbours differ
    return np.append(t[nearest] < t[np.minimum(nearest + 1, n - 1)], True)


class _Buckets:
    def __init__(self, t: np.ndarray) -> None:
        self.t = t.astype(np.uint16)
        self.small = _larger_or_smaller(t)
        self.count = np.bincount(t)
        self.end = np.cumsum(self.count)
        self.start = self.end - self.count
        self.lms = np.flatnonzero(self.small[1:] & ~self.small[:-1]) + 1
        self.used = np.flatnonzero(self.count)

    def _grouped(self, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        c = self.t[j]
        order = np.argsort(c, kind="stable")
        c, j = c[order], j[order]
        many = np.bincount(c, minlength=len(self.count))
        return c, j, np.arange(len(j)) - (np.cumsum(many) - many)[c], many

    def induce(self, lms: np.ndarray) -> np.ndarray:
        """All suffixes, induced by the LMS suffixes in the order given."""
        sa, small = np.full(len(self.t), -1, np.int64), self.small
        c, j, rank, many = self._grouped(lms)
        low = self.end - many
        sa[low[c] + rank] = j
        head = self.start.copy()

        def put_larger(j: np.ndarray) -> None:
            j = j[j >= 0]
            j = j[~small[j]]
            if len(j):
                c, j, rank, many = self._grouped(j)
                sa[head[c] + rank] = j
                np.add(head, many, out=head)

        for k in self.used:
            at = self.start[k]
            while at < head[k]:
                stretch, at = sa[at : head[k]], head[k]
                put_larger(stretch - 1)
            put_larger(sa[low[k] : self.end[k]] - 1)
        tail = self.end.copy()

        def put_smaller(j: np.ndarray) -> None:
            j = j[j >= 0]
            j = j[small[j]]
            if len(j):
                c, j, rank, many = self._grouped(j)
                sa[tail[c] - 1 - rank] = j
                np.subtract(tail, many, out=tail)

        for k in self.used[::-1]:
            at = self.end[k]
            while tail[k] < at:
                stretch, at = sa[tail[k] : at][::-1], tail[k]
                put_smaller(stretch - 1)
            put_smaller(sa[self.start[k] : head[k]][::-1] - 1)
        sa[0] = len(self.t) - 1
        return sa


def _by_doubling(t: np.ndarray, depth: int) -> np.ndarray:
    rank, n, step = t.astype(np.int64), len(t), 1
    while True:
        key = rank * (n + 2)
        key[: max(n - step, 0)] += rank[step:] + 1
        sa = np.argsort(key)
        new = np.concatenate([[0], np.cumsum(key[sa][1:] != key[sa][:-1])])
        rank = np.empty(n, np.int64)
        rank[sa] = new
        step *= 2
        if new[-1] == n - 1 or step >= depth:
            return sa


def _sorted(t: np.ndarray, depth: int) -> np.ndarray:
    buckets = _Buckets(t)
    lms = buckets.lms
    if len(lms) > 1:
        order = buckets.induce(lms)
        index = np.full(len(t), -1, np.int64)
        index[lms] = np.arange(len(lms))
        order = order[index[order] >= 0]
        size = np.append(np.diff(lms) + 1, 1)
        same = Roller(mixed(t.astype(np.uint64) + np.uint64(1))).stretch(lms, size)[index[order]]
        size = size[index[order]]
        name = np.concatenate([[0], np.cumsum((same[1:] != same[:-1]) | (size[1:] != size[:-1]))])
        if name[-1] < len(lms) - 1:
            reduced = np.empty(len(lms), np.int64)
            reduced[index[order]] = name  # ends with the sentinel's name, the unique smallest
            half = -(-depth // 2)  # an LMS substring moves on by two symbols at least
            lms = lms[_sorted(reduced, half) if name[-1] < SMALL_ALPHABET else _by_doubling(reduced, half)]
        else:
            lms = order
    return buckets.induce(lms)


def suffix_array(t: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Sorted suffixes of ``t`` (non-negative symbols below about 65,000). With ``depth``,
    suffixes that agree in so many symbols may stand in any order."""
    if not len(t):
        return np.zeros(0, np.int64)
    full = np.append(t.astype(np.int64) + 1, 0)
    return _sorted(full, len(full) if depth is None else depth)[1:]


def permuted_lcp(t: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(plcp, before): for each suffix in text order, the common prefix with the suffix before it
    in the array; and that suffix (-1 for the first).

    Only irreducible values (the preceding symbols differ) are searched for; any other is its
    left neighbour's less one."""
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    i = np.arange(n)
    loose = (i == 0) | (before <= 0)
    loose[~loose] = t[i[~loose] - 1] != t[before[~loose] - 1]
    loose[1:] |= before[1:] != before[:-1] + 1  # ties beyond the sorted depth
    at = np.flatnonzero(loose & (before >= 0))
    roll = Roller(mixed(t.astype(np.uint64) + np.uint64(1)))
    value, most = np.zeros(n, np.int64), 64
    while len(at):  # longer prefixes, which are fewer, are searched for again with more room
        room = n - np.maximum(at, before[at])
        low, high = np.zeros(len(at), np.int64), np.minimum(room, most)
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = roll.stretch(at, mid) == roll.stretch(before[at], mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        value[at] = low
        at, most = at[(low == most) & (low < room)], most * 8
    last = np.maximum.accumulate(np.where(loose, i, 0))
    return np.maximum(value[last] - (i - last), 0), before


def repeated_starts(parts: list[np.ndarray], room: list[int], lengths: tuple[int, ...]) -> list[list[np.ndarray]]:
    """For each of ``lengths``, and each byte array, the starts of strings of that many bytes that
    start anywhere else too. Only the first ``room`` places of an array count as starts."""
    size = np.array([len(p) for p in parts])
    text = np.zeros(size.sum() + len(parts), np.int64)
    start = np.cumsum(size + 1) - size - 1
    left = np.zeros(len(text), np.int64)
    for p, s, m in zip(parts, start, room, strict=True):
        text[s : s + len(p)] = p.astype(np.int64) + 1
        left[s : s + min(m, len(p))] = np.arange(len(p), max(len(p) - m, 0), -1)
    sa = suffix_array(text, max(lengths))
    plcp, _ = permuted_lcp(text, sa)
    out = []
    for length in lengths:
        alike = np.empty(len(text), np.int64)
        alike[sa] = np.cumsum(plcp[sa] < length)  # suffixes with a common prefix of that length
        fits = left >= length
        again = fits & (np.bincount(alike[fits], minlength=len(text) + 1)[alike] > 1)
        out.append([np.flatnonzero(again[s : s + n]) for s, n in zip(start, size, strict=True)])
    return out
