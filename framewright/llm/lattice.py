"""Words as lattices of vocabulary pieces: batched forward, backward and best path in numpy.

Words of equal length advance together.  Rolling 64-bit hashes of all substrings
of a length probe the sorted hashes of the pieces, which are checked to be
distinct when the table is built.  A hit is an equal hash (and first and last
byte) and is not compared byte by byte: a substring that is no piece is taken
for one with a probability of about pieces / 2^64.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """Distinct byte strings with scores.

    Lookups probe an open-addressed table of the sorted keys, which costs about
    one memory access for a string that is no piece.
    """

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.longest = max(map(len, strings), default=0)
        with np.errstate(over="ignore"):
            keys = np.array([self._hash(s) for s in strings], np.uint64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        if len(np.unique(self.keys)) != len(strings):
            raise ValueError("two pieces have one hash or one string")
        #: For each length, which pairs of first and last byte a piece of it has.
        self.ends = np.zeros((self.longest + 1, 65_536), bool)
        for s in strings:
            self.ends[len(s), s[0] * 256 + s[-1]] = True
        bits = max(4, int(4 * len(strings)).bit_length())
        self.shift, size = np.uint64(64 - bits), 1 << bits
        self.slot = np.full(size + 64, -1, np.int32)
        for i, home in enumerate((self._spread(self.keys) >> self.shift).astype(np.int64).tolist()):
            while self.slot[home] >= 0:
                home += 1
            self.slot[home] = i

    @staticmethod
    def _spread(h: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)

    @staticmethod
    def _hash(s: bytes) -> int:
        h = 0
        for b in s:
            h = (h * int(_BASE) + b + 1) & 0xFFFFFFFFFFFFFFFF
        return (h + len(s) * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece index of each hash, -1 where there is none."""
        at = (self._spread(h) >> self.shift).astype(np.int64)
        out = np.full(len(h), -1, np.int32)
        rows = np.arange(len(h))
        while len(rows):
            got = self.slot[at]
            used = got >= 0
            rows, at, got = rows[used], at[used], got[used]
            hit = self.keys[got] == h[rows]
            out[rows[hit]] = self.order[got[hit]]
            rows, at = rows[~hit], at[~hit] + 1
        return out

    def spans(self, words: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(begin, end, piece of each row or -1) of a matrix of words, by end and then length.

        Spans that no row's first and last byte allow are left out.
        """
        n, length = words.shape
        with np.errstate(over="ignore"):
            rolled = np.zeros((length + 1, n), np.uint64)
            for j in range(length):
                rolled[j + 1] = rolled[j] * _BASE + words[:, j] + np.uint64(1)
            power = [np.uint64(1)]
            for _ in range(self.longest):
                power.append(power[-1] * _BASE)
            for end in range(1, length + 1):
                for size in range(1, min(self.longest, end) + 1):
                    begin = end - size
                    rows = np.flatnonzero(self.ends[size][words[:, begin].astype(np.int64) * 256 + words[:, end - 1]])
                    if not len(rows):
                        continue
                    h = rolled[end][rows] - rolled[begin][rows] * power[size] + np.uint64(size * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)
                    got = self.find(h)
                    if (got >= 0).any():
                        piece = np.full(n, -1, np.int32)
                        piece[rows] = got
                        yield begin, end, piece


    def hits(self, word: bytes, stretch: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(begins, ends, pieces) of one long word, by begin and then length, ``stretch`` begins at a time."""
        data, length = np.frombuffer(word, np.uint8), len(word)
        for at in range(0, length, stretch):
            # All substrings of one length advance together, from the first byte of each.
            own = data[at : min(at + stretch + self.longest, length)]
            n = min(stretch, length - at)
            h, begins, sizes, pieces = np.zeros(n, np.uint64), [], [], []
            with np.errstate(over="ignore"):
                for size in range(1, min(self.longest, len(own)) + 1):
                    m = min(n, len(own) - size + 1)
                    h = h[:m] * _BASE + own[size - 1 : size - 1 + m] + np.uint64(1)
                    rows = np.flatnonzero(self.ends[size][own[:m].astype(np.int64) * 256 + own[size - 1 : size - 1 + m]])
                    got = self.find(h[rows] + np.uint64(size * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF))
                    some = got >= 0
                    begins.append(rows[some])
                    sizes.append(np.full(int(some.sum()), size))
                    pieces.append(got[some])
            begin, size, piece = (np.concatenate(x) for x in (begins, sizes, pieces))
            order = np.lexsort((size, begin))
            yield at + begin[order], at + begin[order] + size[order], piece[order]


def by_length(words: list[bytes], most: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix of bytes) of words of one length, about ``most`` bytes at a time."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        if not size:
            continue
        step = max(1, most // size)
        for k in range(0, len(rows), step):
            own = rows[k : k + step]
            yield own, np.frombuffer(b"".join([words[i] for i in own]), np.uint8).reshape(len(own), size)


def forward(pieces: Pieces, logp: np.ndarray, words: np.ndarray, counts: np.ndarray | None = None, weight: np.ndarray | None = None) -> np.ndarray:
    """Log of the summed probability of all segmentations of each word.

    With ``counts`` the expected uses of each piece are added to it, by a
    backward pass over the same spans; a word counts ``weight`` times.
    """
    n, length = words.shape
    alpha = np.full((length + 1, n), -np.inf)
    alpha[0] = 0
    seen, at_end = [], []

    def close(end: int) -> None:
        if at_end:
            best = np.maximum.reduce(at_end)
            safe = np.where(np.isfinite(best), best, 0)
            total = np.zeros(n)
            for s in at_end:
                total += np.exp(s - safe)
            with np.errstate(divide="ignore"):
                alpha[end] = np.log(total) + safe
            at_end.clear()

    last = 1
    for begin, end, piece in pieces.spans(words):
        if end != last:
            close(last)
            last = end
        at_end.append(alpha[begin] + np.where(piece >= 0, logp[piece], -np.inf))
        if counts is not None:
            seen.append((begin, end, piece))
    close(last)
    if counts is not None:
        total = alpha[length]
        ok = np.isfinite(total)
        beta = np.full((length + 1, n), -np.inf)
        beta[length] = 0
        by_begin: dict[int, list] = {}
        for span in seen:
            by_begin.setdefault(span[0], []).append(span)
        for begin in range(length - 1, -1, -1):
            for _, end, piece in by_begin.get(begin, ()):
                rows = np.flatnonzero((piece >= 0) & ok)
                arc = logp[piece[rows]] + beta[end][rows]
                beta[begin][rows] = np.logaddexp(beta[begin][rows], arc)
                share = np.exp(alpha[begin][rows] + arc - total[rows])
                counts += np.bincount(piece[rows], share if weight is None else share * weight[rows], len(counts))
    return alpha[length]


def forward_alone(pieces: Pieces, logp: np.ndarray, word: bytes, counts: np.ndarray | None = None, weight: float = 1.0, stretch: int = 1 << 16) -> float:
    """:func:`forward` for one long word, a stretch of begins at a time; memory is a few dozen bytes a byte."""
    length, score = len(word), logp.tolist()
    alpha, seen = array("d", [-np.inf]) * (length + 1), []
    alpha[0] = 0.0

    def add(to: array, at: int, x: float) -> None:
        have = to[at]
        if x > have:
            x, have = have, x
        to[at] = have + math.log1p(math.exp(x - have)) if x > -math.inf else have

    for begins, ends, found in pieces.hits(word, stretch):
        for b, e, p in zip(begins.tolist(), ends.tolist(), found.tolist()):
            add(alpha, e, alpha[b] + score[p])
        if counts is not None:
            seen.append((begins.astype(np.int32), ends.astype(np.int32), found))
    total = alpha[length]
    if counts is not None and math.isfinite(total):
        beta = array("d", [-np.inf]) * (length + 1)
        beta[length] = 0.0
        a, z = np.frombuffer(alpha), np.frombuffer(beta)
        for begins, ends, found in reversed(seen):
            for b, e, p in zip(begins[::-1].tolist(), ends[::-1].tolist(), found[::-1].tolist()):
                add(beta, b, beta[e] + score[p])
            counts += np.bincount(found, np.exp(a[begins] + logp[found] + z[ends] - total) * weight, len(counts))
    return total


def viterbi(pieces: Pieces, logp: np.ndarray, words: np.ndarray, spans: list | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Best score of each word and, for each word, its best pieces.

    Ties go to the longer last piece, the one that is probed last.  ``spans``
    may hold what ``pieces.spans`` has found for these words.
    """
    n, length = words.shape
    best = np.full((length + 1, n), -np.inf)
    best[0] = 0
    back, used = np.zeros((length + 1, n), np.int32), np.full((length + 1, n), -1, np.int32)
    for begin, end, piece in pieces.spans(words) if spans is None else spans:
        score = best[begin] + np.where(piece >= 0, logp[piece], -np.inf)
        better = (score >= best[end]) & np.isfinite(score)
        np.copyto(best[end], score, where=better)
        np.copyto(back[end], begin, where=better)
        np.copyto(used[end], piece, where=better)
    rows, at, taken, order = np.arange(n), np.full(n, length), [], []
    while len(rows):
        taken.append(used[at, rows])
        order.append(rows)
        at = back[at, rows]
        go = at > 0
        rows, at = rows[go], at[go]
    # Steps were taken from the end: sort them by word, last step first.
    row, piece = np.concatenate(order), np.concatenate(taken)
    step = np.concatenate([np.full(len(o), -k) for k, o in enumerate(order)])
    sorted_ = np.lexsort((step, row))
    return best[length], np.split(piece[sorted_], np.cumsum(np.bincount(row, minlength=n))[:-1])
