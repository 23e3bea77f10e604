"""Gradient-boosted trees for two classes over binned features, small enough to send to every executor."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic loss, full trees of one depth, at most 64 bins a feature."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 48, least: float = 2.0) -> None:
        self.n_trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least
        self.edges: list[np.ndarray] = []
        self.features = np.zeros((0, 0), dtype=np.int32)
        self.cuts = np.zeros((0, 0), dtype=np.uint8)
        self.leaves = np.zeros((0, 0))
        self.base = 0.0

    def binned(self, x: np.ndarray) -> np.ndarray:
        """Bin numbers, one row per feature."""
        return np.stack([np.searchsorted(e, x[:, j], side="left").astype(np.uint8) for j, e in enumerate(self.edges)])

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = []
        for j in range(x.shape[1]):
            values = np.unique(x[:, j])
            if len(values) > self.bins:
                values = np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins)))
            self.edges.append((values[1:] + values[:-1]) / 2 if len(values) > 1 else np.zeros(0))
        b = self.binned(x)
        n_bins, inner = self.bins + 1, 2**self.depth - 1
        p = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        score = np.full(len(y), self.base)
        features, cuts, leaves = [], [], []
        for _ in range(self.n_trees):
            q = 1 / (1 + np.exp(-score))
            g, h = q - y, np.maximum(q * (1 - q), 1e-6)
            feature, cut = np.zeros(inner, dtype=np.int32), np.full(inner, 255, dtype=np.uint8)
            node = np.zeros(len(y), dtype=np.int64)
            for level in range(self.depth):
                first, width = 2**level - 1, 2**level
                best = np.zeros(width)
                for j in range(len(b)):
                    if not len(self.edges[j]):
                        continue
                    key = (node - first) * n_bins + b[j]
                    gs = np.bincount(key, g, minlength=width * n_bins).reshape(width, n_bins).cumsum(1)
                    hs = np.bincount(key, h, minlength=width * n_bins).reshape(width, n_bins).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                    gain[(hs < self.least) | (ht - hs < self.least)] = 0
                    at = gain.argmax(1)
                    top = gain[np.arange(width), at]
                    better = top > best + 1e-9
                    best[better] = top[better]
                    feature[first : first + width][better] = j
                    cut[first : first + width][better] = at[better]
                node = 2 * node + 1 + (b[feature[node], np.arange(len(y))] > cut[node])
            leaf = node - inner
            gl, hl = np.bincount(leaf, g, minlength=inner + 1), np.bincount(leaf, h, minlength=inner + 1)
            value = -self.rate * gl / (hl + 1)
            score += value[leaf]
            features.append(feature)
            cuts.append(cut)
            leaves.append(value)
        self.features, self.cuts, self.leaves = np.array(features), np.array(cuts), np.array(leaves)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of the second class."""
        out = np.full(len(x), self.base)
        if not len(x):
            return out
        b = np.ascontiguousarray(self.binned(x).T)
        flat, width = b.ravel(), b.shape[1]
        row = np.arange(len(x)) * width
        inner = 2**self.depth - 1
        for feature, cut, value in zip(self.features, self.cuts, self.leaves, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (flat[row + feature[node]] > cut[node])
            out += value[node - inner]
        return out
