"""Gradient-boosted trees for two classes and isotonic calibration, in numpy.

Small on purpose: the training rows are a bounded sample, so one machine is
enough, and a fitted model is a few kilobytes that travel with the task.
"""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic loss, histogram splits, second-order gains, fixed depth.

    Features are cut at quantiles of the training rows, so a split is "code <=
    bin".  With fewer than two classes the model is the constant prior.
    """

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 48, least: int = 10, penalty: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.least, self.penalty = trees, depth, rate, bins, least, penalty
        self.cuts: list[np.ndarray] = []
        self.forest: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.prior = 0.0

    def _codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], axis=1).astype(np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        x, y = np.asarray(x, dtype=np.float64), np.asarray(y, dtype=np.float64)
        rate = (y.sum() + 0.5) / (len(y) + 1.0)
        self.prior = float(np.log(rate / (1 - rate)))
        self.forest = []
        if len(y) == 0 or y.min() == y.max():
            return self
        # Quantiles of the positive part as well: most densities are zero for most rows.
        self.cuts = []
        for j in range(x.shape[1]):
            col = x[:, j]
            some = col[col != 0]
            at = np.linspace(0, 1, self.bins // 2 + 1)[1:-1]
            found = [np.quantile(col, at)] + ([np.quantile(some, at), [0.0, some.min() / 2]] if len(some) else [])
            self.cuts.append(np.unique(np.concatenate(found)))
        codes = self._codes(x)
        width = max(len(c) for c in self.cuts) + 1
        n_features, score = x.shape[1], np.full(len(y), self.prior)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            size = 2 ** (self.depth + 1) - 1
            feature, cut, leaf = np.full(size, -1), np.zeros(size, dtype=np.int64), np.zeros(size)
            node = np.zeros(len(y), dtype=np.int64)
            for level in range(self.depth + 1):
                for k in range(2**level - 1, 2 ** (level + 1) - 1):
                    rows = np.flatnonzero(node == k)
                    if len(rows) == 0:
                        continue
                    gs, hs = g[rows].sum(), h[rows].sum()
                    leaf[k] = gs / (hs + self.penalty)
                    if level == self.depth or len(rows) < 2 * self.least:
                        continue
                    flat = (codes[rows] + np.arange(n_features) * width).ravel()
                    many = np.bincount(flat, minlength=n_features * width).reshape(n_features, width).cumsum(1)
                    gl = np.bincount(flat, np.repeat(g[rows], n_features), n_features * width).reshape(n_features, width).cumsum(1)
                    hl = np.bincount(flat, np.repeat(h[rows], n_features), n_features * width).reshape(n_features, width).cumsum(1)
                    gain = gl**2 / (hl + self.penalty) + (gs - gl) ** 2 / (hs - hl + self.penalty) - gs**2 / (hs + self.penalty)
                    gain[(many < self.least) | (len(rows) - many < self.least)] = -1
                    best = int(gain.argmax())
                    if gain.flat[best] <= 1e-9:
                        continue
                    feature[k], cut[k] = divmod(best, width)
                    node[rows] = 2 * k + 1 + (codes[rows, feature[k]] > cut[k])
            self.forest.append((feature, cut, leaf * self.rate))
            score += self._tree(codes, *self.forest[-1])
        return self

    def _tree(self, codes: np.ndarray, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(codes), dtype=np.int64), np.arange(len(codes))
        for _ in range(self.depth):
            f = feature[node]
            node = np.where(f >= 0, 2 * node + 1 + (codes[rows, np.maximum(f, 0)] > cut[node]), node)
        return leaf[node]

    def decision(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.prior)
        if self.forest and len(x):
            codes = self._codes(np.asarray(x, dtype=np.float64))
            for tree in self.forest:
                score += self._tree(codes, *tree)
        return score


class Isotonic:
    """Monotone calibration by pooling adjacent violators, linear between the blocks' centres."""

    def fit(self, score: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(score, kind="stable")
        blocks: list[list[float]] = []  # sum of y, rows, sum of score
        for s, v in zip(np.asarray(score, float)[order], np.asarray(y, float)[order]):
            blocks.append([v, 1.0, s])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                last = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
        self.at = np.array([b[2] / b[1] for b in blocks] or [0.0])
        # Half a row of each class keeps a pure block off 0 and 1.
        self.value = np.maximum.accumulate(np.array([(b[0] + 0.01) / (b[1] + 0.02) for b in blocks] or [0.0]))
        return self

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(score, self.at, self.value), 0.0, 1.0)
