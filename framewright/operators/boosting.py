"""Boosted trees for several classes under a softmax, in numpy, with early stopping.

Each round fits one tree a class to the gradients of the cross entropy.  A tree
grows level by level from histograms of the features' quantile codes, on a
sample of the rows and features.
"""

from __future__ import annotations

import numpy as np


class SoftmaxTrees:
    def __init__(self, trees: int = 300, rate: float = 0.05, depth: int = 6, rows: float = 0.8, columns: float = 0.8, stop: int = 15, bins: int = 32, classes: int = 3, penalty: float = 1.0, seed: int = 42):
        self.trees, self.rate, self.depth, self.rows, self.columns, self.stop = trees, rate, depth, rows, columns, stop
        self.bins, self.classes, self.penalty, self.seed = bins, classes, penalty, seed
        self.history: list[dict] = []

    def _codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], axis=1)

    def fit(self, x, y, val_x, val_y, **_) -> SoftmaxTrees:
        """``x`` is (rows, ...), flattened; stops when the validation loss has not fallen for ``stop`` rounds and keeps the best."""
        x, val_x = x.reshape(len(x), -1).astype(float), val_x.reshape(len(val_x), -1).astype(float)
        rng, n_features = np.random.default_rng(self.seed), x.shape[1]
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins)[1:-1])) for j in range(n_features)]
        codes, val_codes = self._codes(x), self._codes(val_x)
        self.gains = np.zeros(n_features)
        score, val_score = np.zeros((len(y), self.classes)), np.zeros((len(val_y), self.classes))
        truth, self.forest, best = np.eye(self.classes)[y], [], (np.inf, 0)
        for k in range(self.trees):
            p = self._softmax(score)
            grad, hess = p - truth, 2 * p * (1 - p)
            used = rng.random(len(y)) < self.rows
            columns = np.sort(rng.choice(n_features, max(1, int(self.columns * n_features)), replace=False))
            grown = [self._grow(codes, grad[:, c] * used, hess[:, c] * used, columns) for c in range(self.classes)]
            self.forest.append(grown)
            for c, tree in enumerate(grown):
                score[:, c] += self._leaves(codes, tree)
                val_score[:, c] += self._leaves(val_codes, tree)
            loss, val = self._loss(score, y), self._loss(val_score, val_y)
            self.history.append({"epoch": k + 1, "loss": loss, "accuracy": float((score.argmax(axis=1) == y).mean()), "val_loss": val, "val_accuracy": float((val_score.argmax(axis=1) == val_y).mean())})
            if val < best[0]:
                best = (val, k + 1)
            elif k + 1 - best[1] >= self.stop:
                break
        self.forest = self.forest[: best[1]]
        return self

    @staticmethod
    def _softmax(score: np.ndarray) -> np.ndarray:
        e = np.exp(score - score.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def _loss(self, score: np.ndarray, y: np.ndarray) -> float:
        return float(-np.log(self._softmax(score)[np.arange(len(y)), y] + 1e-15).mean())

    def _grow(self, codes: np.ndarray, g: np.ndarray, h: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature (-1: leaf), cut and value of each node; the children of node i are 2i + 1 and 2i + 2."""
        size = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size, int), np.zeros(size)
        node, own, width = np.zeros(len(codes), int), codes[:, columns], self.bins
        for level in range(self.depth + 1):
            base, many = 2**level - 1, 2**level
            at = node - base
            live = (at >= 0) & (h > 0)
            sums = [np.bincount(at[live], v[live], many) for v in (g, h)]
            value[base : base + many] = -self.rate * sums[0] / (sums[1] + self.penalty)
            if level == self.depth or not live.any():
                break
            flat = ((at[live, None] * len(columns) + np.arange(len(columns))) * width + own[live]).ravel()
            left = [np.bincount(flat, np.repeat(v[live], len(columns)), many * len(columns) * width).reshape(many, len(columns), width).cumsum(axis=2) for v in (g, h)]
            right = [s[:, None, None] - part for s, part in zip(sums, left)]
            gain = left[0] ** 2 / (left[1] + self.penalty) + right[0] ** 2 / (right[1] + self.penalty) - (sums[0] ** 2 / (sums[1] + self.penalty))[:, None, None]
            gain[(left[1] < 1) | (right[1] < 1)] = 0  # a child needs some weight
            best = gain.reshape(many, -1).argmax(axis=1)
            top = gain.reshape(many, -1)[np.arange(many), best]
            goes = np.flatnonzero(top > 1e-6)
            feature[base + goes], cut[base + goes] = columns[best[goes] // width], best[goes] % width
            np.add.at(self.gains, feature[base + goes], top[goes])
            split = (at >= 0) & (feature[node] >= 0)
            node = np.where(split, 2 * node + 1 + (codes[np.arange(len(codes)), np.maximum(feature[node], 0)] > cut[node]), node)
        return feature, cut, value

    def _leaves(self, codes: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        feature, cut, value = tree
        node, rows = np.zeros(len(codes), int), np.arange(len(codes))
        for _ in range(self.depth):
            f = feature[node]
            node = np.where(f >= 0, 2 * node + 1 + (codes[rows, np.maximum(f, 0)] > cut[node]), node)
        return value[node]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        codes, score = self._codes(x.reshape(len(x), -1).astype(float)), np.zeros((len(x), self.classes))
        for grown in self.forest:
            for c, tree in enumerate(grown):
                score[:, c] += self._leaves(codes, tree)
        return self._softmax(score)

    def importances(self) -> np.ndarray:
        """Share of each feature in the gains of all splits."""
        return self.gains / max(self.gains.sum(), 1e-12)

    def save(self, path: str) -> None:
        import json

        state = {k: v for k, v in self.__dict__.items() if k not in ("cuts", "forest", "gains")}
        state |= {"cuts": [c.tolist() for c in self.cuts], "forest": [[[a.tolist() for a in tree] for tree in grown] for grown in self.forest], "gains": self.gains.tolist()}
        with open(path, "w", encoding="utf-8") as f:
            json.dump(state, f)

    @classmethod
    def load(cls, path: str) -> SoftmaxTrees:
        import json

        with open(path, encoding="utf-8") as f:
            state = json.load(f)
        out = cls()
        out.__dict__.update(state)
        out.cuts, out.gains = [np.array(c) for c in state["cuts"]], np.array(state["gains"])
        out.forest = [[(np.array(a, int), np.array(b, int), np.array(v, float)) for a, b, v in grown] for grown in state["forest"]]
        return out
