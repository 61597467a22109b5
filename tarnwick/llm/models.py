"""Small models fitted on the driver from bounded samples: boosted trees and isotonic regression."""

from __future__ import annotations

import numpy as np


class Isotonic:
    """Pool-adjacent-violators fit of outcomes to scores, linear between the pools' centres."""

    def __init__(self, score: np.ndarray, outcome: np.ndarray):
        order = np.argsort(score, kind="stable")
        pools: list[list[float]] = []
        for x, y in zip(score[order], outcome[order], strict=True):
            pools.append([float(y), 1.0, float(x)])
            while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
                y1, n1, x1 = pools.pop()
                pools[-1] = [pools[-1][0] + y1, pools[-1][1] + n1, pools[-1][2] + x1]
        self.x = np.array([p[2] / p[1] for p in pools])
        # Each pool borrows one observation of doubt, so that no score is called certain.
        self.y = np.array([(p[0] + 0.5) / (p[1] + 1.0) for p in pools])
        self.y = np.maximum.accumulate(self.y) if len(self.y) else self.y

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.x, self.y) if len(self.x) else np.full(np.shape(score), 0.5)


class BoostedTrees:
    """Gradient-boosted regression trees for a 0/1 outcome: Newton steps on histogram bins."""

    def __init__(self, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, ridge: float = 2.0, least: float = 3.0):
        self.settings = (trees, depth, rate, bins, ridge, least)
        self.base = 0.0
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        trees, depth, rate, bins, ridge, least = self.settings
        p = (y.sum() + 0.5) / (len(y) + 1)
        self.base = float(np.log(p / (1 - p)))
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
        raw = np.full(len(y), self.base)
        for _ in range(trees):
            prob = 1 / (1 + np.exp(-raw))
            grad, hess = y - prob, np.maximum(prob * (1 - prob), 1e-6)
            feature = np.zeros(2**depth - 1, dtype=np.int64)
            cut = np.full(2**depth - 1, np.inf)
            node = np.zeros(len(y), dtype=np.int64)
            for level in range(depth):
                for at in range(2**level - 1, 2 ** (level + 1) - 1):
                    mine = np.flatnonzero(node == at)
                    best = 1e-6
                    g, h = grad[mine].sum(), hess[mine].sum()
                    for f, e in enumerate(edges):
                        if not len(e) or not len(mine):
                            continue
                        gl = np.cumsum(np.bincount(binned[mine, f], grad[mine], len(e) + 1))[:-1]
                        hl = np.cumsum(np.bincount(binned[mine, f], hess[mine], len(e) + 1))[:-1]
                        nl = np.cumsum(np.bincount(binned[mine, f], minlength=len(e) + 1))[:-1]
                        gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
                        gain[(nl < least) | (len(mine) - nl < least)] = 0
                        k = int(np.argmax(gain))
                        if gain[k] > best:
                            best, feature[at], cut[at] = gain[k], f, e[k]
                    node[mine] = 2 * at + 1 + (x[mine, feature[at]] > cut[at])
            leaf = node - (2**depth - 1)
            value = rate * np.bincount(leaf, grad, 2**depth) / (np.bincount(leaf, hess, 2**depth) + ridge)
            self.trees.append((feature, cut, value))
            raw += value[leaf]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            while len(node) and node[0] < len(cut):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += value[node - len(cut)] if len(node) else 0
        return out
