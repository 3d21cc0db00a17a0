"""Gradient-boosted trees for two classes, in numpy: logistic loss, splits by histograms."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Full binary trees as arrays by tree and node: the children of node i are 2i+1 and 2i+2."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        depth = int(np.log2(self.value.shape[1]))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - (1 << depth) + 1]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 48, depth: int = 5, rate: float = 0.25, bins: int = 32, ridge: float = 1.0, least: float = 2.0) -> Trees:
    """Fit on rows x (n, features) with labels y of 0 and 1. ``least``: sum of second derivatives that each side of a split needs."""
    n, width = x.shape
    edges = np.sort(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], axis=0, method="lower"), axis=0).T
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    flat = binned + np.arange(width) * bins
    start = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    score, rows = np.full(n, start), np.arange(n)
    feature, threshold, value = np.zeros((trees, (1 << depth) - 1), np.int64), np.full((trees, (1 << depth) - 1), np.inf), np.zeros((trees, 1 << depth))
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        slope, curve = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, k = (1 << level) - 1, 1 << level
            at = ((node - first)[:, None] * (width * bins) + flat).ravel()
            g, h = (np.bincount(at, np.repeat(w, width), k * width * bins).reshape(k, width, bins).cumsum(2) for w in (slope, curve))
            sum_g, sum_h = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + ridge) + (sum_g - g) ** 2 / (sum_h - h + ridge) - sum_g**2 / (sum_h + ridge)
            gain = np.where((h >= least) & (sum_h - h >= least), gain, 0)[:, :, : bins - 1].reshape(k, -1)
            best = gain.argmax(1)
            f, b = best // (bins - 1), best % (bins - 1)
            split = gain[np.arange(k), best] > 1e-9
            feature[t, first : first + k] = f
            threshold[t, first : first + k] = np.where(split, edges[f, b], np.inf)
            node = 2 * node + 1 + (x[rows, feature[t, node]] > threshold[t, node])
        leaf = node - (1 << depth) + 1
        value[t] = rate * np.bincount(leaf, slope, 1 << depth) / (np.bincount(leaf, curve, 1 << depth) + ridge)
        score += value[t, leaf]
    return Trees(start, feature, threshold, value)
