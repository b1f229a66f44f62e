"""A compressed FM-index over integer symbols: BWT in a wavelet matrix of packed bits."""

from __future__ import annotations

import numpy as np


class FMIndex:
    """Backward search for patterns of at most ``depth`` symbols.

    Suffixes are sorted by their first ``depth`` symbols (rounded up to a power
    of two).  Search only counts symbols before block borders, and blocks of
    patterns no longer than that are contiguous, so this is enough.  Symbol 0
    ends each text and never stands in a pattern.
    """

    def __init__(self, symbols: np.ndarray, depth: int):
        self.n = len(symbols)
        self.sa = self._sorted(symbols, depth)
        last = symbols[self.sa - 1]  # of the first suffix: the last symbol
        size = int(symbols.max()) + 1 if self.n else 1
        first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=size))])
        self.levels = max(1, int(size - 1).bit_length())
        self.bits, self.ones, self.zeros = [], [], []
        current, start, symbol = last, np.zeros(size, np.int64), np.arange(size)
        for level in range(self.levels - 1, -1, -1):
            bit = (current >> level) & 1
            padded = np.zeros(-(-(self.n + 1) // 64) * 64, np.uint8)
            padded[: self.n] = bit
            words = np.packbits(padded, bitorder="little").view("<u8")
            self.bits.append(words)
            self.ones.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])[:-1])
            self.zeros.append(self.n - int(bit.sum()))
            start = self._down(len(self.bits) - 1, start, (symbol >> level) & 1)
            current = np.concatenate([current[bit == 0], current[bit == 1]])
        self.base, self.first = first[:-1] - start, first

    @staticmethod
    def _sorted(symbols: np.ndarray, depth: int) -> np.ndarray:
        rank, span = symbols.astype(np.int64), 1
        order = np.argsort(rank, kind="stable")
        while span < depth:
            ahead = np.zeros_like(rank)
            ahead[:-span] = rank[span:] + 1
            key = rank * (int(rank.max(initial=0)) + 2) + ahead
            order = np.argsort(key, kind="stable")
            new = np.empty_like(rank)
            at = key[order]
            new[order] = np.concatenate([[0], np.cumsum(at[1:] != at[:-1])]) if len(at) else at
            rank, span = new, 2 * span
        return order

    def _down(self, level: int, at: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """Positions ``at`` of one level carried to the next, along ``bit``."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        ones = self.ones[level][word] + np.bitwise_count(self.bits[level][word] & mask)
        return np.where(bit == 1, self.zeros[level] + ones, at - ones)

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """LF: where the block border ``at`` goes when ``symbol`` is put before the pattern."""
        for k in range(self.levels):
            at = self._down(k, at, (symbol >> (self.levels - 1 - k)) & 1)
        return self.base[symbol] + at

    def blocks(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For patterns (rows): block of the longest suffix that occurs twice or more, and its length.

        A row whose block shrinks to one suffix (itself) stops; ``length`` then is
        its matching statistic at that end, less than the row's length.
        """
        m, width = patterns.shape
        low, high = self.first[patterns[:, -1]], self.first[patterns[:, -1] + 1]
        length = np.ones(m, np.int64)
        active = np.flatnonzero(high - low > 1)
        for k in range(width - 2, -1, -1):
            symbol = patterns[active, k]
            a, b = self.step(symbol, low[active]), self.step(symbol, high[active])
            go = b - a > 1
            active, a, b = active[go], a[go], b[go]
            low[active], high[active], length[active] = a, b, width - k
        return low, high, length
