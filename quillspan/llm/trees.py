"""Histogram trees on numpy: gradient boosting and random forests, flattened for vectorised traversal.

Values are cut into at most 63 bins at training quantiles; a level of a tree is grown from one histogram
of all its nodes. A model is four arrays of shape (trees, nodes) in heap order (children of ``i`` at
``2 i + 1`` and ``2 i + 2``), so a batch walks through all trees at once, one array step a level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    depth: int
    base: float

    def sums(self, x: np.ndarray) -> np.ndarray:
        """The base value plus the reached leaves of all trees."""
        if not len(self.leaf):
            return np.full(len(x), self.base)
        node = np.zeros((len(x), len(self.leaf)), np.int64)
        tree = np.arange(len(self.leaf))[None, :]
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.cut[tree, node])
        return self.base + self.leaf[tree, node - (2**self.depth - 1)].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.sums(x), -30, 30)))


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]


def _grow(binned: np.ndarray, g: np.ndarray, h: np.ndarray, edges: list[np.ndarray], depth: int, least: float, penalty: float, allowed) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One tree on gradients ``g`` and weights ``h``; returns features, cuts, leaf values and each row's leaf."""
    n, m = binned.shape
    width = max(len(e) for e in edges) + 1
    feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
    node = np.zeros(n, np.int64)
    for level in range(depth):
        k = 2**level
        first, best = k - 1, np.full(k, 1e-9)
        splits = [(0, 0)] * k
        own = [allowed() for _ in range(k)] if allowed else None
        for f in range(m):
            at = node * width + binned[:, f]
            sg = np.bincount(at, g, k * width).reshape(k, width).cumsum(axis=1)
            sh = np.bincount(at, h, k * width).reshape(k, width).cumsum(axis=1)
            tg, th = sg[:, -1:], sh[:, -1:]
            good = (sh >= least) & (th - sh >= least)
            gain = np.where(good, sg**2 / (sh + penalty) + (tg - sg) ** 2 / (th - sh + penalty) - tg**2 / (th + penalty), 0)
            for i in range(k):
                j = int(gain[i, : len(edges[f])].argmax()) if len(edges[f]) else 0
                if len(edges[f]) and gain[i, j] > best[i] and (own is None or f in own[i]):
                    best[i], splits[i] = gain[i, j], (f, j + 1)
        right = np.zeros(n, np.int64)
        for i, (f, j) in enumerate(splits):
            if j:
                feature[first + i], cut[first + i] = f, edges[f][j - 1]
                right = np.where(node == i, binned[:, f] >= j, right)
        node = 2 * node + right
    sg, sh = np.bincount(node, g, 2**depth), np.bincount(node, h, 2**depth)
    return feature, cut, np.where(sh > 0, sg / (sh + penalty), 0), node


def boosted(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 63, least: float = 3.0) -> Forest:
    """Gradient boosting on the logistic loss. No rows, or rows of one class, give a constant model."""
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = float(np.log(mean / (1 - mean)))
    if len(y) == 0 or y.min() == y.max():
        return Forest(np.zeros((0, 1), int), np.zeros((0, 1)), np.zeros((0, 1)), 0, base)
    edges = _edges(x, bins)
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    score, parts = np.full(len(y), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        f, c, leaf, node = _grow(binned, y - p, np.maximum(p * (1 - p), 1e-6), edges, depth, least * 0.05, 1.0, None)
        leaf = rate * np.clip(leaf, -4, 4)
        score += leaf[node]
        parts.append((f, c, leaf))
    return Forest(*(np.stack(a) for a in zip(*parts, strict=True)), depth, base)


def random_forest(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 6, bins: int = 63, seed: int = 3) -> Forest:
    """Trees on bootstrap rows, each split among a random third of the features; ``sums`` is the mean share of class 1."""
    if len(y) == 0 or y.min() == y.max():
        return Forest(np.zeros((0, 1), int), np.zeros((0, 1)), np.zeros((0, 1)), 0, float(y.mean()) if len(y) else 0.0)
    rng = np.random.default_rng(seed)
    edges = _edges(x, bins)
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    some = max(2, x.shape[1] // 3)
    parts = []
    for _ in range(trees):
        times = np.bincount(rng.integers(0, len(y), len(y)), minlength=len(y)).astype(float)
        f, c, leaf, _ = _grow(binned, times * y, times, edges, depth, 2.0, 1e-9, lambda: set(rng.choice(x.shape[1], some, replace=False).tolist()))
        parts.append((f, c, leaf / trees))
    return Forest(*(np.stack(a) for a in zip(*parts, strict=True)), depth, 0.0)
