"""An FM-index over an integer sequence in numpy: wavelet-matrix ranks,
backward search of many phrases at once, locating by sampled suffix positions."""

from __future__ import annotations

import numpy as np

SAMPLE = 8                     # every so many text positions are kept


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Prefix doubling; ``t`` ends with its unique smallest symbol."""
    _, rank = np.unique(t, return_inverse=True)
    rank = rank.astype(np.int64)
    h, n = 1, len(t)
    while True:
        second = np.zeros(n, np.int64)
        second[:-h] = rank[h:] + 1 if h < n else 0
        key = rank * (n + 1) + second
        by = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[by] = np.concatenate([[0], np.cumsum(key[by][1:] != key[by][:-1])])
        rank = new
        if rank[by[-1]] == n - 1 or h >= n:
            return by
        h *= 2


class FMIndex:
    def __init__(self, t: np.ndarray):
        """``t``: symbols >= 0, the last one a unique smallest symbol."""
        sa = suffix_array(t)
        bwt = t[sa - 1]
        self.n, self.sigma = len(t), int(t.max()) + 1
        self.below = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=self.sigma))])
        self.levels: list[tuple[int, np.ndarray, int]] = []        # shift, ones before each place, zeros
        rest = bwt
        for shift in range(max(1, (self.sigma - 1).bit_length()) - 1, -1, -1):
            bit = (rest >> shift) & 1
            ones = np.concatenate([[0], np.cumsum(bit)]).astype(np.int64)
            self.levels.append((shift, ones, len(rest) - int(ones[-1])))
            rest = np.concatenate([rest[bit == 0], rest[bit == 1]])
        self.sampled = sa % SAMPLE == 0
        self.sample_rank = np.concatenate([[0], np.cumsum(self.sampled)])
        self.sample = sa[self.sampled]

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c before place i of the transform."""
        lo = np.zeros_like(i)
        for shift, ones, zeros in self.levels:
            bit = ((c >> shift) & 1).astype(bool)
            i, lo = (np.where(bit, zeros + ones[x], x - ones[x]) for x in (i, lo))
        return i - lo

    def symbol(self, i: np.ndarray) -> np.ndarray:
        c = np.zeros_like(i)
        for shift, ones, zeros in self.levels:
            bit = ones[i + 1] - ones[i]
            c |= bit << shift
            i = np.where(bit == 1, zeros + ones[i], i - ones[i])
        return c

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of the rows of a matrix of phrases."""
        lo = np.zeros(len(phrases), np.int64)
        known = (phrases < self.sigma).all(axis=1)         # a symbol that the text lacks ends a search
        hi = np.full(len(phrases), self.n, np.int64)
        for c in np.minimum(phrases, self.sigma - 1).T[::-1]:
            lo, hi = self.below[c] + self.rank(c, lo), self.below[c] + self.rank(c, hi)
        return lo, np.where(known, hi, lo)

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text positions of suffix ranks, by walking back to a sampled one."""
        row, at, steps = row.copy(), np.zeros(len(row), np.int64), 0
        left = np.arange(len(row))
        while len(left):
            hit = self.sampled[row[left]]
            done = left[hit]
            at[done] = self.sample[self.sample_rank[row[done]]] + steps
            left = left[~hit]
            c = self.symbol(row[left])
            row[left] = self.below[c] + self.rank(c, row[left])
            steps += 1
        return at
