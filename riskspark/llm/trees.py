"""Gradient-boosted trees for two classes and isotonic calibration, in numpy."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Complete binary trees on binned features, fitted to the logistic loss."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, smooth: float = 1.0,
                 least: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.smooth, self.least = rounds, depth, rate, bins, smooth, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        shares = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(column, shares)) for column in x.T]
        self.start = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        self.trees = []
        binned = self._binned(x)
        margin = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            tree = self._tree(binned, p - y, p * (1 - p))
            self.trees.append(tree)
            margin += self._leaf_values(tree, binned)
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned = self._binned(x)
        total = np.full(len(x), self.start)
        for tree in self.trees:
            total += self._leaf_values(tree, binned)
        return total

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T)]) \
            if len(x) else np.empty((0, len(self.edges)), np.int64)

    def _tree(self, binned, gradient, curvature):
        n, features = binned.shape
        node = np.zeros(n, np.int64)
        splits = []
        for level in range(self.depth):
            nodes = 1 << level
            cell = (node[:, None] * features + np.arange(features)) * self.bins + binned
            size = nodes * features * self.bins
            g, h = (np.bincount(cell.ravel(), np.repeat(v, features), size).reshape(nodes, features, self.bins)
                    for v in (gradient, curvature))
            left_g, left_h = g.cumsum(2), h.cumsum(2)
            all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
            right_g, right_h = all_g - left_g, all_h - left_h
            gain = (left_g ** 2 / (left_h + self.smooth) + right_g ** 2 / (right_h + self.smooth)
                    - all_g ** 2 / (all_h + self.smooth))
            gain[(left_h < self.least) | (right_h < self.least)] = 0
            best = gain.reshape(nodes, -1).argmax(1)
            feature, threshold = best // self.bins, best % self.bins
            none = gain.reshape(nodes, -1).max(1) <= 1e-9
            threshold = np.where(none, self.bins, threshold)  # everything goes left
            splits.append((feature, threshold))
            node = node * 2 + (binned[np.arange(n), feature[node]] > threshold[node])
        leaves = 1 << self.depth
        g, h = (np.bincount(node, v, leaves) for v in (gradient, curvature))
        return splits, -self.rate * g / (h + self.smooth)

    @staticmethod
    def _leaf_values(tree, binned):
        splits, values = tree
        node, rows = np.zeros(len(binned), np.int64), np.arange(len(binned))
        for feature, threshold in splits:
            node = node * 2 + (binned[rows, feature[node]] > threshold[node])
        return values[node]


class Isotonic:
    """The non-decreasing step function nearest to the labels, by pooling adjacent violators,
    joined by lines; pools are drawn a little towards the mean of all labels."""

    def fit(self, score: np.ndarray, label: np.ndarray, drawn: float = 1.0) -> Isotonic:
        order = np.argsort(score, kind="stable")
        mean = label.mean() if len(label) else 0.5
        pools: list[list[float]] = []  # label sum, count, score sum
        for s, y in zip(score[order].tolist(), label[order].tolist()):
            pools.append([y, 1.0, s])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last)]
        self.x = np.array([s / n for _, n, s in pools] or [0.0])
        self.y = np.array([(y + drawn * mean) / (n + drawn) for y, n, _ in pools] or [mean])
        self.y = np.maximum.accumulate(self.y)
        return self

    def at(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.x, self.y)
