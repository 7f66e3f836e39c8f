"""Two-dimensional range reporting over words: which of them start and end alike.

A ``Words`` holds words of one length twice: sorted forwards, and sorted by their
letters in reverse. Words with a given prefix are an interval of the first order,
those with a given suffix an interval of the second, and a wavelet tree over the
permutation between the two reports what lies in both.
"""

from __future__ import annotations

import numpy as np


class Wavelet:
    """A wavelet tree over a permutation, a level being one array of bits with the
    counts of zeros before each place; zeros of a level come first in the next."""

    def __init__(self, values: np.ndarray) -> None:
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.zeros: list[np.ndarray] = []
        for level in range(self.bits):
            right = (values >> (self.bits - 1 - level)) & 1 == 1
            self.zeros.append(np.concatenate(([0], np.cumsum(~right))).astype(np.int32))
            values = np.concatenate((values[~right], values[right]))

    def report(self, lo: np.ndarray, hi: np.ndarray, least: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) for all values in [least, below) at places [lo, hi); the
        four arrays hold one query each. All queries go down a level together, and
        only into nodes that their places and their values reach."""
        q, base = np.arange(len(lo)), np.zeros(len(lo), np.int64)
        for level, zeros in enumerate(self.zeros):
            width = 1 << (self.bits - 1 - level)
            a, b = zeros[lo].astype(np.int64), zeros[hi].astype(np.int64)
            left = (a < b) & (base + width > least[q])
            right = (hi - b > lo - a) & (base + width < below[q]) & (base + 2 * width > least[q])
            left &= base < below[q]
            q, lo, hi, base = (
                np.concatenate(x) for x in (
                    (q[left], q[right]), (a[left], zeros[-1] + (lo - a)[right]), (b[left], zeros[-1] + (hi - b)[right]), (base[left], base[right] + width)
                )
            )
        return q, base


def letters(words: np.ndarray) -> np.ndarray:
    """A row of code points for each of some words of one length."""
    return np.ascontiguousarray(words).view(np.uint32).reshape(len(words), -1)


def _narrow(table: np.ndarray, column: int, lo: np.ndarray, hi: np.ndarray, char: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted rows [lo, hi), which agree up to ``column``, those with ``char`` there."""

    def first(char: np.ndarray) -> np.ndarray:
        a, b = lo.copy(), hi.copy()
        while (open_ := a < b).any():
            mid = (a + b) >> 1
            less = open_ & (table[np.minimum(mid, len(table) - 1), column] < char)
            a, b = np.where(less, mid + 1, a), np.where(open_ & ~less, mid, b)
        return a

    return first(char), first(char + 1)


class Words:
    """Words of one length, all different, with their counts."""

    def __init__(self, words: list[str], counts: list[int]) -> None:
        order = sorted(range(len(words)), key=words.__getitem__)
        self.words = np.array([words[k] for k in order])
        self.counts = np.array([counts[k] for k in order], np.int64)
        self.forward = letters(self.words)
        turned = np.ascontiguousarray(self.forward[:, ::-1])
        self.by_end = np.argsort(turned.view(self.words.dtype).ravel(), kind="stable")
        self.reverse = turned[self.by_end]
        place = np.empty(len(order), np.int64)
        place[self.by_end] = np.arange(len(order))
        self.tree = Wavelet(place)

    def near(self, asked: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) by number: words that come from a query by one code point put
        in or replaced at a position from ``first`` to before ``last``. Queries
        have one length: that of the words (replaced) or one less (put in). Each
        pair comes once, an insertion under its last possible position."""
        chars = letters(asked).astype(np.int64)
        n, length, m = len(asked), self.forward.shape[1], len(self.words)
        grows = length - chars.shape[1]
        own = np.full(n, -1)
        if not grows:
            at = np.minimum(np.searchsorted(self.words, asked), m - 1)
            own = np.where(self.words[at] == asked, at, -1)
        fewest = (own >= 0).astype(np.int64)  # a query's own word is in all of its intervals

        def walk(table: np.ndarray, column, upto: int):
            """Intervals after 0, 1, ... characters, while any holds another word."""
            q, lo, hi = np.arange(n), np.zeros(n, np.int64), np.full(n, m, np.int64)
            for k in range(upto + 1):
                live = hi - lo > fewest[q]
                q, lo, hi = q[live], lo[live], hi[live]
                if not len(q):
                    return
                yield k, q, lo, hi
                if k < upto:
                    lo, hi = _narrow(table, k, lo, hi, chars[q, column(k)])

        wide = chars.shape[1]
        starts = {}
        for i, q, lo, hi in walk(self.forward, lambda k: k, int(last.max()) - 1 if n else 0):
            if (use := (first[q] <= i) & (i < last[q])).any():
                starts[i] = (q[use], lo[use], hi[use])
        met = []
        for k, q, lo, hi in walk(self.reverse, lambda k: wide - 1 - k, length - 1 - (int(first.min()) if n else 0)):
            if (i := length - 1 - k) in starts:
                s, a, b = starts[i]
                _, x, y = np.intersect1d(s, q, assume_unique=True, return_indices=True)
                met.append((s[x], np.full(len(x), i), a[x], b[x], lo[y], hi[y]))
        if not met:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        q, i, lo, hi, least, below = (np.concatenate(x) for x in zip(*met, strict=True))
        r, value = self.tree.report(lo, hi, least, below)
        q, i, word = q[r], i[r], self.by_end[value]
        fresh = word != own[q]
        if grows:
            fresh = (i == wide) | (self.forward[word, i] != chars[q, np.minimum(i, wide - 1)])
        return q[fresh], word[fresh]
