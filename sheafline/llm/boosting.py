"""Gradient-boosted trees over small whole-number features, fitted on counted cells and applied as a column expression."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TREES, DEPTH, RATE, RIDGE = 16, 3, 0.4, 1.0


@dataclass
class Node:
    """A leaf with a value, or a split: ``feature <= at`` goes left."""

    value: float = 0.0
    feature: int = -1
    at: int = 0
    left: Node | None = None
    right: Node | None = None

    def apply(self, x: np.ndarray) -> np.ndarray:
        if self.left is None:
            return np.full(len(x), self.value)
        return np.where(x[:, self.feature] <= self.at, self.left.apply(x), self.right.apply(x))

    def column(self, features: list[Column]) -> Column:
        if self.left is None:
            return F.lit(self.value)
        return F.when(features[self.feature] <= self.at, self.left.column(features)).otherwise(self.right.column(features))


def _grow(x: np.ndarray, slope: np.ndarray, bend: np.ndarray, depth: int) -> Node:
    total, weight = slope.sum(), bend.sum() + RIDGE
    best = (1e-6, -1, 0)
    if depth:
        for f in range(x.shape[1]):
            for at in np.unique(x[:, f])[:-1]:
                left = x[:, f] <= at
                s, b = slope[left].sum(), bend[left].sum() + RIDGE
                gain = s * s / b + (total - s) ** 2 / (weight - b + 2 * RIDGE) - total * total / weight
                if gain > best[0]:
                    best = (gain, f, int(at))
    if best[1] < 0:
        return Node(value=float(-RATE * total / weight))
    left = x[:, best[1]] <= best[2]
    return Node(feature=best[1], at=best[2], left=_grow(x[left], slope[left], bend[left], depth - 1),
                right=_grow(x[~left], slope[~left], bend[~left], depth - 1))


@dataclass
class BoostedTrees:
    """Log-odds: a start value and the trees that add to it."""

    start: float
    trees: list[Node]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return sum((t.apply(x) for t in self.trees), np.full(len(x), self.start))

    def column(self, features: list[Column]) -> Column:
        """Log-odds of a row whose features are given as columns."""
        out = F.lit(self.start)
        for tree in self.trees:
            out = out + tree.column(features)
        return out


def fit(x: np.ndarray, positive: np.ndarray, negative: np.ndarray) -> BoostedTrees:
    """Trees for cells ``x`` with their counts of either label."""
    start = math.log((positive.sum() + 0.5) / (negative.sum() + 0.5))
    model = BoostedTrees(start, [])
    z, n = np.full(len(x), start), positive + negative
    for _ in range(TREES if len(x) else 0):
        p = 1 / (1 + np.exp(-z))
        tree = _grow(x, n * p - positive, n * p * (1 - p), DEPTH)
        model.trees.append(tree)
        z = z + tree.apply(x)
    return model
