"""Gradient-boosted regression trees for two classes, on binned features."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Trees of a fixed depth, grown level by level on histograms of gradients."""

    def __init__(self, n_trees: int = 30, depth: int = 4, rate: float = 0.3, bins: int = 32, penalty: float = 2.0, least: float = 4.0):
        self.n_trees, self.depth, self.rate, self.bins, self.penalty, self.least = n_trees, depth, rate, bins, penalty, least

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1).astype(np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        z, n_features = self._binned(x), x.shape[1]
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        margin = np.full(len(y), self.base)
        self.feature, self.cut, self.value = [], [], []
        columns = np.arange(n_features) * self.bins
        for _ in range(self.n_trees):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(len(y), np.int64)
            feature, cut = np.zeros((2**self.depth - 1,), np.int64), np.full(2**self.depth - 1, self.bins, np.int64)
            for level in range(self.depth):
                first, n = 2**level - 1, 2**level
                key = ((node - first)[:, None] * (n_features * self.bins) + columns[None] + z).ravel()
                shape = (n, n_features, self.bins)
                g = np.bincount(key, np.repeat(grad, n_features), minlength=np.prod(shape)).reshape(shape)
                h = np.bincount(key, np.repeat(hess, n_features), minlength=np.prod(shape)).reshape(shape)
                gl, hl = g.cumsum(2), h.cumsum(2)
                gt, ht = gl[:, :, -1:], hl[:, :, -1:]
                gain = gl**2 / (hl + self.penalty) + (gt - gl) ** 2 / (ht - hl + self.penalty) - gt**2 / (ht + self.penalty)
                gain[(hl < self.least) | (ht - hl < self.least)] = 0
                best = gain.reshape(n, -1).argmax(1)
                split = gain.reshape(n, -1)[np.arange(n), best] > 1e-6
                feature[first : first + n] = np.where(split, best // self.bins, 0)
                cut[first : first + n] = np.where(split, best % self.bins, self.bins)
                node = 2 * node + 1 + (z[np.arange(len(z)), feature[node]] > cut[node])
            leaf = node - (2**self.depth - 1)
            value = -self.rate * np.bincount(leaf, grad, minlength=2**self.depth) / (np.bincount(leaf, hess, minlength=2**self.depth) + self.penalty)
            margin += value[leaf]
            self.feature.append(feature)
            self.cut.append(cut)
            self.value.append(value)
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = self._binned(x)
        out, rows = np.full(len(x), self.base), np.arange(len(x)) * z.shape[1]
        z = z.ravel()
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (z[rows + feature[node]] > cut[node])
            out += value[node - (2**self.depth - 1)]
        return out
