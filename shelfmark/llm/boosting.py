"""Gradient-boosted trees for two classes over binned dense features, and isotonic calibration, in numpy."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Depth-limited trees of Newton steps on the logistic loss; each node is (feature, bin, left value or node, ...) in heap order."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, penalty: float = 2.0, least: int = 5):
        self.trees, self.depth, self.rate, self.bins, self.penalty, self.least = trees, depth, rate, bins, penalty, least

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        inner = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, f], inner)) if len(x) else np.zeros(0) for f in range(x.shape[1])]
        p = np.clip(y.mean() if len(y) else 0.0, 1e-4, 1 - 1e-4)
        self.start = float(np.log(p / (1 - p)))
        self.forest: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if not 0 < y.sum() < len(y):
            return self
        binned = self._binned(x)
        score = np.full(len(y), self.start)
        for _ in range(self.trees):
            prob = 1 / (1 + np.exp(-score))
            tree = self._tree(binned, prob - y, prob * (1 - prob))
            self.forest.append(tree)
            score += self._apply(tree, binned)
        return self

    def _tree(self, binned: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple:
        inner = (1 << self.depth) - 1
        feature, cutoff, value = np.zeros(inner, np.int64), np.full(inner, self.bins + 1), np.zeros(2 * inner + 1)
        node = np.zeros(len(binned), np.int64)
        for at in range(inner):
            rows = np.flatnonzero(node == at)
            g, h = grad[rows].sum(), hess[rows].sum()
            best = (1e-6, 0, self.bins + 1)
            for f in range(binned.shape[1] if len(rows) >= 2 * self.least else 0):
                b = binned[rows, f]
                size = len(self.edges[f]) + 1
                gl, hl, nl = (np.cumsum(np.bincount(b, w, size))[:-1] for w in (grad[rows], hess[rows], np.ones(len(rows))))
                gain = gl**2 / (hl + self.penalty) + (g - gl) ** 2 / (h - hl + self.penalty) - g**2 / (h + self.penalty)
                gain[(nl < self.least) | (len(rows) - nl < self.least)] = 0
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), f, int(gain.argmax()))
            _, feature[at], cutoff[at] = best
            node[rows] = 2 * at + 1 + (binned[rows, feature[at]] > cutoff[at])
        for leaf in range(inner, 2 * inner + 1):
            rows = node == leaf
            value[leaf] = -self.rate * grad[rows].sum() / (hess[rows].sum() + self.penalty)
        return feature, cutoff, value

    def _apply(self, tree: tuple, binned: np.ndarray) -> np.ndarray:
        feature, cutoff, value = tree
        node, rows = np.zeros(len(binned), np.int64), np.arange(len(binned))
        for _ in range(self.depth):
            node = 2 * node + 1 + (binned[rows, feature[node]] > cutoff[node])
        return value[node]

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of class 1."""
        binned = self._binned(x)
        return self.start + sum((self._apply(t, binned) for t in self.forest), np.zeros(len(x)))


class Isotonic:
    """The increasing step function nearest to the labels, by pooling adjacent violators, made linear between steps."""

    def fit(self, raw: np.ndarray, y: np.ndarray) -> "Isotonic":
        order = np.argsort(raw, kind="stable")
        pools: list[list[float]] = []  # sum of labels, number, sum of raw scores
        for r, v in zip(raw[order].tolist(), y[order].tolist()):
            pools.append([v, 1.0, r])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last)]
        self.x = np.array([p[2] / p[1] for p in pools]) if pools else np.zeros(1)
        self.y = np.array([p[0] / p[1] for p in pools]) if pools else np.zeros(1)
        return self

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(raw, self.x, self.y), 0.0, 1.0)
