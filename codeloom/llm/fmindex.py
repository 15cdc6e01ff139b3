"""A compressed FM-index over a bounded text, in numpy.

The Burrows-Wheeler transform lies in a wavelet matrix: one packed bit vector a
level with a count per 64-bit word. Backward search runs for many patterns in
lockstep. A further bit vector marks the borders between suffixes that do not share
their first ``depth`` characters. With it a search interval can be shortened on the
right back to ``depth`` characters, so one backward step per character of a streamed
text gives its matching statistics cut at ``depth``.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, class): equal classes are suffixes equal in their first ``depth`` symbols.

    Prefix doubling; the class at ``depth`` joins the ranks of two powers of two that overlap.
    """
    n = len(text)
    rank = text.astype(np.int64)
    span, keep = 1, None
    half = 1 << (depth.bit_length() - 1)
    while True:
        if span == half:
            keep = rank.copy()
        shifted = np.zeros(n, np.int64)
        shifted[: n - span] = rank[span:] + 1
        key = (rank << 32) | shifted
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        rank, span = new, span * 2
        if rank.max(initial=0) == n - 1 or span >= 2 * n:
            break
    if keep is None:  # all suffixes differ within fewer symbols
        keep, half = rank, depth
    other = np.full(n, -1, np.int64)
    if depth > half:
        other[: n - (depth - half)] = keep[depth - half :]
    sa = np.argsort(rank, kind="stable")
    new_class = (keep[sa][1:] != keep[sa][:-1]) | (other[sa][1:] != other[sa][:-1])
    return sa, np.concatenate(([0], np.cumsum(new_class)))


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits, self.counts, self.zeros = [], [], []
        s, n = symbols.astype(np.uint32), len(symbols)
        for level in range(self.levels - 1, -1, -1):
            bit = ((s >> level) & 1).astype(bool)
            packed = np.zeros((n // 64 + 1) * 64, bool)
            packed[:n] = bit
            words = np.packbits(packed, bitorder="little").view(np.uint64)
            ones = np.bitwise_count(words).astype(np.int64)
            self.bits.append(words)
            self.counts.append(np.concatenate(([0], np.cumsum(ones)))[:-1])
            self.zeros.append(int(n - ones.sum()))
            s = np.concatenate((s[~bit], s[bit]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Position of each symbol's block start plus its occurrences before ``at``, at the last level."""
        for k in range(self.levels):
            word, off = at >> 6, (at & 63).astype(np.uint64)
            below = self.bits[k][word] & ((np.uint64(1) << off) - np.uint64(1))
            ones = self.counts[k][word] + np.bitwise_count(below)
            one = (symbol >> (self.levels - 1 - k)) & 1 == 1
            at = np.where(one, self.zeros[k] + ones, at - ones)
        return at


class FMIndex:
    """Over the concatenation of ``texts`` (arrays of symbols >= 2), each closed by the symbol 1."""

    def __init__(self, texts: list[np.ndarray], depth: int):
        ends = np.cumsum([len(t) + 1 for t in texts])
        text = np.ones(int(ends[-1]) + 1, np.int64)
        owner = np.empty(len(text), np.int64)
        start = 0
        for i, t in enumerate(texts):
            text[start : start + len(t)] = t
            owner[start : ends[i]] = i
            start = int(ends[i])
        text[-1], owner[-1] = 0, -1
        self.depth, n = depth, len(text)
        sa, self.classes = suffix_array(text, depth)
        self.owner = owner[sa]  # whose suffix stands at each place of the suffix array
        first = np.flatnonzero(np.concatenate(([True], self.classes[1:] != self.classes[:-1])))
        self.class_start = first
        self.class_end = np.concatenate((first[1:], [n]))
        bwt = text[sa - 1]
        sigma = int(text.max()) + 1
        self.tree = WaveletMatrix(bwt, sigma)
        counts = np.bincount(text, minlength=sigma)
        self.before = np.concatenate(([0], np.cumsum(counts)))[:-1]
        self.base = self.tree.rank(np.arange(sigma), np.zeros(sigma, np.int64))
        self.n = n

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Extends each interval by one symbol on the left."""
        both = self.tree.rank(np.concatenate((symbol, symbol)), np.concatenate((lo, hi)))
        shift = self.before[symbol] - self.base[symbol]
        m = len(symbol)
        return both[:m] + shift, both[m:] + shift

    def windows(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """For each indexed text the class of each of its windows of ``depth`` symbols, by position."""
        order = np.argsort([-len(t) for t in texts], kind="stable")
        sizes = np.array([len(texts[i]) for i in order], np.int64)
        live = int((sizes >= self.depth).sum())
        out = [np.empty(max(0, len(t) - self.depth + 1), np.int64) for t in texts]
        if not live:
            return out
        # Text j's k-th symbol from its end is table[j, k].
        table = np.zeros((live, int(sizes[0])), np.int64)
        for j in range(live):
            table[j, : sizes[j]] = texts[order[j]][::-1]
        result = np.zeros((live, int(sizes[0]) - self.depth + 1), np.int64)
        lo, hi = np.zeros(live, np.int64), np.full(live, self.n, np.int64)
        for k in range(int(sizes[0])):
            m = int(np.searchsorted(-sizes[:live], -k, side="left"))  # texts longer than k
            lo, hi = self.step(table[:m, k], lo[:m], hi[:m])
            if k >= self.depth - 1:
                c = self.classes[lo]
                lo, hi = self.class_start[c], self.class_end[c]  # back to ``depth`` symbols
                result[:m, k - self.depth + 1] = c
        for j in range(live):
            i = order[j]
            out[i][:] = result[j, : len(out[i])][::-1]
        return out
