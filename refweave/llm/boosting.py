"""Small gradient-boosted trees: fitted with numpy on a bounded table, applied as one Column expression over their numbers."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .quality import bound


@dataclass(frozen=True)
class Node:
    """A leaf (feature None) holds a value; else rows with feature <= at go left."""

    value: float = 0.0
    feature: int | None = None
    at: float = 0.0
    left: Node | None = None
    right: Node | None = None

    def of(self, x: np.ndarray) -> np.ndarray:
        if self.feature is None:
            return np.full(len(x), self.value)
        return np.where(x[:, self.feature] <= self.at, self.left.of(x), self.right.of(x))

    def numbers(self, depth: int) -> tuple[list[float], list[float]]:
        """The tree filled up to `depth`, in heap order: feature and threshold of each inner node; values of the leaves."""
        inner, row = [], [self]
        for _ in range(depth):
            inner += [x for n in row for x in ((0, 1e300) if n.feature is None else (n.feature, n.at))]
            row = [child for n in row for child in ((n, n) if n.feature is None else (n.left, n.right))]
        return inner, [n.value for n in row]

    def depth(self) -> int:
        return 0 if self.feature is None else 1 + max(self.left.depth(), self.right.depth())


@dataclass(frozen=True)
class Model:
    start: float
    trees: tuple[Node, ...]
    threshold: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum((t.of(x) for t in self.trees), np.zeros(len(x)))

    def column(self, features: list[Column]) -> Column:
        """The score as an expression of fixed size: the trees are an array literal that it walks down and sums up."""
        depth = max((t.depth() for t in self.trees), default=0)
        below = 2**depth - 1  # inner nodes
        trees = F.from_json(F.lit(json.dumps([[*inner, *leaves] for inner, leaves in (t.numbers(depth) for t in self.trees)])), "array<array<double>>")

        def value(tree: Column, known: Column, node: Column, left: int) -> Column:
            if not left:
                return F.get(tree, node + below)  # node - below among the leaves, which follow 2 x below numbers
            down = lambda i: 2 * i + 1 + (F.get(known, F.get(tree, 2 * i).cast("int")) > F.get(tree, 2 * i + 1)).cast("int")
            return bound(down(node), lambda i: value(tree, known, i, left - 1))

        return bound(F.array(*features), lambda known: F.aggregate(trees, F.lit(self.start), lambda a, t: a + value(t, known, F.lit(0), depth)))


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float) -> Node:
    leaf = Node(rate * float(g.sum() / (h.sum() + 1.0)))
    if depth == 0 or len(x) < 8:
        return leaf
    best, total = (1e-6, None, 0.0), g.sum() ** 2 / (h.sum() + 1)
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        value, gs, hs = x[order, j], np.cumsum(g[order]), np.cumsum(h[order])
        at = np.flatnonzero(value[1:] > value[:-1])  # the last row of each value but the largest
        if not len(at):
            continue
        gain = gs[at] ** 2 / (hs[at] + 1) + (gs[-1] - gs[at]) ** 2 / (hs[-1] - hs[at] + 1) - total
        i = int(np.argmax(gain))
        if gain[i] > best[0]:
            best = (float(gain[i]), j, float(value[at[i]]))
    if best[1] is None:
        return leaf
    low = x[:, best[1]] <= best[2]
    return Node(0.0, best[1], best[2], grow(x[low], g[low], h[low], depth - 1, rate), grow(x[~low], g[~low], h[~low], depth - 1, rate))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 20, depth: int = 2, rate: float = 0.4, precision: float = 0.98) -> Model:
    """Logistic loss. Every third row is held out: the least score whose held-out precision is enough is the threshold."""
    held = np.arange(len(y)) % 3 == 2
    tx, ty = x[~held], y[~held].astype(float)
    start = float(np.log((ty.mean() + 1e-3) / (1 - ty.mean() + 1e-3)))
    score, trees = np.full(len(ty), start), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        tree = grow(tx, ty - p, p * (1 - p), depth, rate)
        trees.append(tree)
        score += tree.of(tx)
    made = Model(start, tuple(trees))
    s, hy = made.score(x[held]), y[held]
    good = [t for t in np.unique(s) if hy[s >= t].mean() >= precision]
    return Model(start, tuple(trees), float(min(good, default=np.inf)) - 1e-9)
