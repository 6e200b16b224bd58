"""Gradient-boosted trees for a handful of classes, small enough to train on the driver.

The training sample is bounded by its caller, so training costs the same at every
corpus size; scoring is vectorised over an Arrow batch inside the executors.
"""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Softmax boosting of shallow histogram trees with second-order leaf values."""

    def __init__(self, n_classes: int, rounds: int = 40, depth: int = 3, rate: float = 0.25, bins: int = 32, l2: float = 1.0, least: float = 4.0):
        self.n_classes, self.rounds, self.depth, self.rate, self.bins, self.l2, self.least = n_classes, rounds, depth, rate, bins, l2, least
        self.temperature = 1.0
        self.edges: list[np.ndarray] = []
        self.trees: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = []
        self.base = np.zeros(n_classes)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1).astype(np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> "BoostedTrees":
        w = np.ones(len(y)) if weight is None else weight
        q = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, j], q)) for j in range(x.shape[1])]
        b = self._binned(x)
        share = np.array([w[y == k].sum() for k in range(self.n_classes)]) + 1e-6
        self.base = np.log(share / share.sum())
        score = np.tile(self.base, (len(y), 1))
        onehot = np.eye(self.n_classes)[y]
        for _ in range(self.rounds):
            p = _softmax(score)
            trees = []
            for k in range(self.n_classes):
                g, h = (p[:, k] - onehot[:, k]) * w, np.maximum(p[:, k] * (1 - p[:, k]), 1e-6) * w
                tree, leaf = self._tree(b, g, h)
                score[:, k] += tree[2][leaf]
                trees.append(tree)
            self.trees.append(trees)
        return self

    def _tree(self, b: np.ndarray, g: np.ndarray, h: np.ndarray):
        """A complete tree as arrays: split feature and bin of each inner node (-1: all go left), value of each leaf."""
        inner = 2**self.depth - 1
        feature, cut = np.full(inner, -1), np.zeros(inner, dtype=np.int64)
        at = np.zeros(len(g), dtype=np.int64)
        size = self.bins + 1
        for node in range(inner):
            rows = np.flatnonzero(at == node)
            best = 1e-6
            if len(rows):
                gs, hs = g[rows], h[rows]
                gt, ht = gs.sum(), hs.sum()
                for j in range(b.shape[1]):
                    bj = b[rows, j]
                    gl = np.cumsum(np.bincount(bj, gs, size))[:-1]
                    hl = np.cumsum(np.bincount(bj, hs, size))[:-1]
                    gain = gl**2 / (hl + self.l2) + (gt - gl) ** 2 / (ht - hl + self.l2) - gt**2 / (ht + self.l2)
                    gain[(hl < self.least / 8) | (ht - hl < self.least / 8)] = 0
                    i = int(gain.argmax())
                    if gain[i] > best:
                        best, feature[node], cut[node] = gain[i], j, i
                right = b[rows, feature[node]] > cut[node] if feature[node] >= 0 else np.zeros(len(rows), dtype=bool)
                at[rows] = 2 * node + 1 + right
        leaf = at - inner
        gsum, hsum = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        return (feature, cut, -self.rate * gsum / (hsum + self.l2)), leaf

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        score = np.tile(self.base, (len(x), 1))
        every = np.arange(len(x))
        for trees in self.trees:
            for k, (feature, cut, value) in enumerate(trees):
                at = np.zeros(len(x), dtype=np.int64)
                for _ in range(self.depth):
                    f = feature[at]
                    at = 2 * at + 1 + ((f >= 0) & (b[every, f] > cut[at]))
                score[:, k] += value[at - len(feature)]
        return score

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        """The temperature with the least log loss on a holdout."""
        raw = self.raw(x)
        grid = np.geomspace(0.25, 8, 41)
        loss = [-np.log(np.maximum(_softmax(raw / t)[np.arange(len(y)), y], 1e-9)).mean() for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])
        return self

    def proba(self, x: np.ndarray) -> np.ndarray:
        return _softmax(self.raw(x) / self.temperature)


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)
