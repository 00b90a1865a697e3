"""Gradient-boosted trees for two classes, on binned features."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Bins of a feature at most.
BINS = 32


@dataclass
class Tree:
    """A full tree as arrays: feature and threshold of inner nodes, values of leaves."""

    feature: np.ndarray
    limit: np.ndarray
    value: np.ndarray


@dataclass
class Forest:
    """The prior and the trees; the sum of what they give is the log odds."""

    prior: float
    depth: int
    trees: list[Tree] = field(default_factory=list)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        for tree in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, tree.feature[at]] > tree.limit[at])
            out += tree.value[at - (2**self.depth - 1)]
        return out


def fit_forest(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.3, ridge: float = 1.0) -> Forest:
    """Newton boosting of the logistic loss; the same rows give the same forest."""
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    forest = Forest(float(np.log(share / (1 - share))), depth)
    limits = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(limit, c, "left") for limit, c in zip(limits, x.T, strict=True)], 1)
    total, count = np.full(len(y), forest.prior), x.shape[1]
    offset = np.arange(count) * BINS
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        slope, bend = y - p, p * (1 - p)
        inner = 2**depth - 1
        tree = Tree(np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(inner + 1))
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first = 2**level - 1
            width = 2**level
            key = ((at - first)[:, None] * count * BINS + offset + binned).ravel()
            sums = [np.bincount(key, np.repeat(w, count), width * count * BINS).reshape(width, count, BINS) for w in (slope, bend)]
            left = [s.cumsum(2) for s in sums]
            whole = [s[:, :, -1:] for s in left]
            gain = left[0] ** 2 / (left[1] + ridge) + (whole[0] - left[0]) ** 2 / (whole[1] - left[1] + ridge)
            gain -= whole[0] ** 2 / (whole[1] + ridge)
            for f, limit in enumerate(limits):
                gain[:, f, len(limit):] = 0
            best = gain.reshape(width, -1).argmax(1)
            for k in range(width):
                f, b = divmod(int(best[k]), BINS)
                if gain[k, f, b] > 1e-9:
                    tree.feature[first + k], tree.limit[first + k] = f, limits[f][b]
            at = 2 * at + 1 + (x[np.arange(len(y)), tree.feature[at]] > tree.limit[at])
        leaf = at - inner
        tree.value = rate * np.bincount(leaf, slope, inner + 1) / (np.bincount(leaf, bend, inner + 1) + ridge)
        total += tree.value[leaf]
        forest.trees.append(tree)
    return forest
