"""An FM-index over a sequence of small integers: suffix order, wavelet-matrix ranks, sampled suffix positions."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray, bits: int) -> np.ndarray:
    """Starts of all suffixes in order. ``text`` ends in a 0 that stands nowhere else; values are below 2**bits.

    As many symbols as fit a 64-bit key are sorted at once; after that only suffixes that still tie are sorted again,
    by the order of what follows, over twice the length each time.
    """
    n = len(text)
    reach = max(1, 63 // bits)
    key = np.zeros(n, dtype=np.uint64)
    for j in range(reach):
        key <<= np.uint64(bits)
        if j < n:
            key[: n - j] |= text[j:].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    fresh = np.empty(n, dtype=bool)
    fresh[0] = True
    np.not_equal(ordered[1:], ordered[:-1], out=fresh[1:])
    del key, ordered
    slots = np.arange(n)
    group = np.maximum.accumulate(np.where(fresh, slots, 0))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = group
    while True:
        alone = fresh & np.append(fresh[1:], True)
        tied = np.flatnonzero(~alone)
        if not len(tied):
            return order
        suffix = order[tied]
        follow = suffix + reach
        later = np.where(follow < n, rank[np.minimum(follow, n - 1)], -1)
        home = rank[suffix]
        by = np.lexsort((later, home))
        order[tied] = suffix[by]
        home, later = home[by], later[by]
        new = np.empty(len(tied), dtype=bool)
        new[0] = True
        new[1:] = (home[1:] != home[:-1]) | (later[1:] != later[:-1])
        fresh[tied] = new
        rank[order[tied]] = np.maximum.accumulate(np.where(new, tied, 0))
        reach *= 2


class FMIndex:
    """Counts and locates patterns in ``text`` (values from 1 to 2**bits - 1)."""

    def __init__(self, text: np.ndarray, bits: int, sample: int = 8):
        text = np.append(text, 0).astype(np.int64)
        self.n, self.bits = len(text), bits
        order = suffix_array(text, bits)
        bwt = text[order - 1]
        self.before = np.zeros((1 << bits) + 1, dtype=np.int64)
        np.cumsum(np.bincount(bwt, minlength=1 << bits), out=self.before[1:])
        # wavelet matrix: per bit, from the highest, how many ones stand before each place
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        level = bwt
        for b in range(bits - 1, -1, -1):
            bit = (level >> b) & 1
            upto = np.zeros(self.n + 1, dtype=np.int32)
            np.cumsum(bit, out=upto[1:], dtype=np.int32)
            self.ones.append(upto)
            self.zeros.append(self.n - int(upto[-1]))
            level = np.concatenate([level[bit == 0], level[bit == 1]])
        self.bwt = bwt
        self.first = self._walk(np.arange(1 << bits), np.zeros(1 << bits, dtype=np.int64))
        marked = order % sample == 0
        self.marked_before = np.zeros(self.n + 1, dtype=np.int32)
        np.cumsum(marked, out=self.marked_before[1:], dtype=np.int32)
        self.marked = marked
        self.sampled = order[marked]

    def _walk(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Where a place of the sequence comes out of the wavelet matrix on the way of a symbol."""
        place = place.copy()
        for k in range(self.bits):
            one = (symbol >> (self.bits - 1 - k)) & 1
            ones = self.ones[k][place]
            place = np.where(one == 1, self.zeros[k] + ones, place - ones)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place of the transformed text."""
        return self._walk(symbol, place) - self.first[symbol]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the suffixes that begin with each pattern (all of one length, one per row)."""
        low = np.zeros(len(patterns), dtype=np.int64)
        high = np.full(len(patterns), self.n, dtype=np.int64)
        alive = np.arange(len(patterns))
        for j in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[alive, j]
            low[alive] = self.before[symbol] + self.rank(symbol, low[alive])
            high[alive] = self.before[symbol] + self.rank(symbol, high[alive])
            empty = low[alive] >= high[alive]
            high[alive[empty]] = low[alive[empty]]
            alive = alive[~empty]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step back through the text until a sampled position."""
        out = np.empty(len(rows), dtype=np.int64)
        at, steps, open_ = rows.copy(), 0, np.arange(len(rows))
        while len(open_):
            here = at[open_]
            done = self.marked[here]
            out[open_[done]] = self.sampled[self.marked_before[here[done]]] + steps
            open_, here = open_[~done], here[~done]
            symbol = self.bwt[here]
            at[open_] = self.before[symbol] + self.rank(symbol, here)
            steps += 1
        return out
