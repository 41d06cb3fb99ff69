"""Gradient-boosted trees for binary labels on a few dozen small features, in numpy."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic loss, complete trees of a fixed depth, histogram splits, Newton leaves."""

    def __init__(self, rounds: int = 50, depth: int = 3, rate: float = 0.3, bins: int = 24, l2: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.l2 = rounds, depth, rate, bins, l2
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.bias = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T)], axis=1)
        mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.bias = float(np.log(mean / (1 - mean)))
        score = np.full(len(y), self.bias)
        inner = 2**self.depth - 1
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, p * (1 - p)
            feature, threshold = np.zeros(inner, int), np.full(inner, np.inf)
            node = np.zeros(len(y), int)
            for at in range(inner):
                rows = np.flatnonzero(node == at)
                best = (1e-6, 0, np.inf, None)
                if len(rows) > 1:
                    g, h = grad[rows], hess[rows]
                    whole = g.sum() ** 2 / (h.sum() + self.l2)
                    for f, c in enumerate(cuts):
                        if not len(c):
                            continue
                        b = binned[rows, f]
                        gl = np.cumsum(np.bincount(b, g, len(c) + 1))[:-1]
                        hl = np.cumsum(np.bincount(b, h, len(c) + 1))[:-1]
                        gain = gl**2 / (hl + self.l2) + (g.sum() - gl) ** 2 / (h.sum() - hl + self.l2) - whole
                        k = int(np.argmax(gain))
                        if gain[k] > best[0]:
                            best = (gain[k], f, c[k], k)
                feature[at], threshold[at] = best[1], best[2]
                right = np.zeros(len(rows), int) if best[3] is None else (binned[rows, best[1]] > best[3]).astype(int)
                node[rows] = 2 * at + 1 + right
            leaf = node - inner
            g = np.bincount(leaf, grad, 2**self.depth)
            h = np.bincount(leaf, hess, 2**self.depth)
            value = self.rate * g / (h + self.l2)
            score += value[leaf]
            self.trees.append((feature, threshold, value))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        out = np.full(len(x), self.bias)
        rows, inner = np.arange(len(x)), 2**self.depth - 1
        for feature, threshold, value in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - inner]
        return out
