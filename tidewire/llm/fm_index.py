"""A compressed FM-index over word sequences, searched for many patterns at once.

The Burrows-Wheeler transform of the words is kept in a wavelet matrix: one bit
vector for each bit of a word's number, packed, with a 32-bit count for every
512 bits and a 16-bit one inside for every 64.  The text itself is not kept.  Backward search extends a pattern by one word to the left with two ranks in each
bit vector; all patterns of a batch take their steps together.
"""

from __future__ import annotations

import numpy as np


#: Masks of the bits below each place of a 64-bit word.
_BELOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes by their first ``depth`` or more symbols (prefix doubling)."""
    n = len(symbols)
    rank = symbols.astype(np.int64)
    span = 1
    order = np.argsort(rank, kind="stable").astype(np.int32)
    while span < depth:
        key = rank * (rank.max() + 2)
        if span < n:
            key[: n - span] += rank[span:] + 1
        order = np.argsort(key).astype(np.int32)
        key = key[order]
        rank[order] = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]))
        if rank[order[-1]] == n - 1:
            break
        span *= 2
    return order


class FMIndex:
    """``symbols``: numbers from 0 (the separator) up; ``weight``: how often each position counts.

    Patterns of up to ``depth`` symbols are found exactly.  Weights above 2 count as
    2: the question is whether a pattern occurs at least twice.
    """

    def __init__(self, symbols: np.ndarray, weight: np.ndarray, depth: int) -> None:
        n = self.n = len(symbols)
        order = suffix_order(symbols, depth)
        self.weights = np.zeros(n + 1, np.int32)
        np.cumsum(np.minimum(weight[order], 2), out=self.weights[1:])
        left = symbols[order - 1].astype(np.int32)
        del order
        sigma = int(symbols.max()) + 1
        self.levels = max(1, (sigma - 1).bit_length())
        blocks = n // 512 + 1
        self.bits = np.zeros((self.levels, blocks * 8), np.uint64)
        self.large = np.zeros((self.levels, blocks), np.int32)
        self.small = np.zeros((self.levels, blocks * 8), np.uint16)
        self.zeros = np.zeros(self.levels, np.int64)
        for level in range(self.levels):
            bit = (left >> (self.levels - 1 - level)) & 1 > 0
            packed = np.zeros(blocks * 64, np.uint8)
            some = np.packbits(bit, bitorder="little")
            packed[: len(some)] = some
            self.bits[level] = packed.view(np.uint64)
            ones = np.bitwise_count(self.bits[level]).reshape(blocks, 8)
            self.small[level] = (np.cumsum(ones, 1) - ones).ravel()
            self.large[level, 1:] = np.cumsum(ones.sum(1))[:-1]
            self.zeros[level] = n - int(bit.sum())
            left = np.concatenate([left[~bit], left[bit]])
        before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma))])[:-1]
        every = np.arange(sigma)
        self.base = before - self._trace(every, np.zeros(sigma, np.int64))

    def _trace(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level in range(self.levels):
            block = at >> 6
            one = np.bitwise_count(self.bits[level].take(block) & _BELOW.take(at & 63)).astype(np.int64)
            one += self.small[level].take(block)
            one += self.large[level].take(block >> 3)
            at = np.where(symbol & (1 << (self.levels - 1 - level)), one + self.zeros[level], at - one)
        return at

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with ``symbol`` followed by what ``lo:hi`` stands for."""
        both = self._trace(np.concatenate([symbol, symbol]), np.concatenate([lo, hi])) + np.concatenate([self.base[symbol], self.base[symbol]])
        return both[: len(lo)], both[len(lo) :]

    def count(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return self.weights[hi] - self.weights[lo]


def repeated_windows(index: FMIndex, text: np.ndarray, first: np.ndarray, windows: np.ndarray, width: int, probe: int = 3) -> np.ndarray:
    """For texts inside the index, which of their windows occur at least twice.

    Text ``q`` begins at position ``first[q]`` of ``text``, the stream of symbols, and has ``windows[q]`` (at most 64)
    windows of ``width`` symbols; bit ``k`` of the answer stands for window ``k``.

    Matching statistics from right to left: a pattern that ends with a window is
    extended to the left as long as it occurs twice, and every window it covers on
    the way is repeated.  Where the extension at ``u`` occurs once only, short
    patterns from ``u`` on are probed: no window around a pattern that occurs once
    can be repeated, so the search goes on left of all those.
    """
    mask = np.zeros(len(first), np.uint64)
    q = np.flatnonzero(windows > 0)
    x = windows[q] - 1  # the rightmost window not yet decided
    at = x + width - 1
    lo, hi = np.zeros(len(q), np.int64), np.full(len(q), index.n)
    probing, u, length = np.zeros(len(q), bool), np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
    while len(q):
        lo, hi = index.extend(text[first[q] + at], lo, hi)
        twice = index.count(lo, hi) >= 2
        over = np.zeros(len(q), bool)
        restart = np.zeros(len(q), bool)
        go = ~probing & twice
        hit = go & (at <= x)
        mask[q[hit]] |= np.uint64(1) << at[hit].astype(np.uint64)
        over |= go & (at == 0)
        # the extension occurs once: windows up to x are open, and u is where it failed
        fail = ~probing & ~twice
        x = np.where(fail, np.minimum(at, x - 1), x)
        over |= fail & (x < 0)
        u = np.where(fail, at, u)
        # a probe that occurs twice goes on, is made longer, or is given up
        whole = probing & twice & (at == u)
        longer = whole & (length < probe) & (u + length < windows[q] + width - 1)
        restart |= whole & ~longer
        # a probe that occurs once decides all windows around it
        once = probing & ~twice
        x = np.where(once, np.minimum(x, u + length - 1 - width), x)
        over |= once & (x < 0)
        restart |= once
        on = go | (probing & twice & ~whole)
        length = np.where(fail, 1, np.where(longer, length + 1, length))
        at = np.where(on, at - 1, np.where(fail, u, np.where(longer, u + length - 1, np.where(restart, x + width - 1, at))))
        fresh = ~on
        lo, hi = np.where(fresh, 0, lo), np.where(fresh, index.n, hi)
        probing = (probing | fail) & ~restart
        keep = np.flatnonzero(~over)
        if len(keep) < len(q):
            q, x, at, lo, hi, probing, u, length = (v[keep] for v in (q, x, at, lo, hi, probing, u, length))
    return mask
