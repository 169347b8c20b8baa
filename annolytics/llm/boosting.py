"""Gradient-boosted trees for a binary target (logistic loss, Newton leaves), fitted on the driver from a bounded sample.

Features are binned at quantiles of the sample; trees are grown depth-wise on histograms of gradients. A fitted model is plain
data, so it can be scored by numpy on executors or written out as a SQL expression.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Documented bound of the labelled rows a fit takes in.
MAX_ROWS = 50_000


@dataclass
class Tree:
    """Node i: rows with x[feature[i]] <= threshold[i] go to left[i], others to right[i]; feature -1 marks a leaf of value[i]."""

    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self) -> int:
        for part, x in ((self.feature, -1), (self.threshold, 0.0), (self.left, -1), (self.right, -1), (self.value, 0.0)):
            part.append(x)
        return len(self.feature) - 1

    def predict(self, x: np.ndarray) -> np.ndarray:
        feature, threshold = np.array(self.feature), np.array(self.threshold)
        left, right, value = np.array(self.left), np.array(self.right), np.array(self.value)
        at = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        while len(rows := rows[feature[at[rows]] >= 0]):
            here = at[rows]
            at[rows] = np.where(x[rows, feature[here]] <= threshold[here], left[here], right[here])
        return value[at]


@dataclass
class Boosted:
    base: float
    trees: list[Tree]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += tree.predict(x)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))

    def sql(self, features: list[str]) -> str:
        """The margin as a SQL expression over the named columns; leaves are rounded to 9 decimals, thresholds to 12."""

        def node(t: Tree, i: int) -> str:
            if t.feature[i] < 0:
                return f"{t.value[i]:.9f}D"
            return f"CASE WHEN {features[t.feature[i]]} <= {t.threshold[i]:.12f}D THEN {node(t, t.left[i])} ELSE {node(t, t.right[i])} END"

        return " + ".join([f"{self.base:.9f}D", *(node(t, 0) for t in self.trees)])


def fit(x: np.ndarray, y: np.ndarray, *, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: float = 2.0) -> Boosted:
    """Fit on at most MAX_ROWS rows. least: smallest sum of second derivatives in a leaf. One class alone gives a constant model."""
    if len(x) > MAX_ROWS:
        raise ValueError(f"{len(x)} labelled rows; sample them to {MAX_ROWS} first")
    x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
    p = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    model = Boosted(float(np.log(p / (1 - p))), [])
    if not len(x) or y.min() == y.max():
        return model
    edges = []
    for j in range(x.shape[1]):
        u = np.unique(x[:, j])
        mids = (u[1:] + u[:-1]) / 2
        edges.append(mids if len(mids) < bins else np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])))
    code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    margin = np.full(len(y), model.base)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-margin))
        g, h = q - y, q * (1 - q)
        tree = Tree()
        grow(tree, tree.add(), np.arange(len(y)), code, edges, g, h, depth, rate, l2, least)
        margin += tree.predict(x)
        model.trees.append(tree)
    return model


def grow(tree: Tree, at: int, rows: np.ndarray, code: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, rate: float, l2: float, least: float) -> None:
    total_g, total_h = g[rows].sum(), h[rows].sum()
    tree.value[at] = float(-rate * total_g / (total_h + l2))
    if depth == 0:
        return
    best = (1e-6, -1, -1)
    for j, e in enumerate(edges):
        if not len(e):
            continue
        sum_g = np.cumsum(np.bincount(code[rows, j], g[rows], len(e) + 1))[:-1]
        sum_h = np.cumsum(np.bincount(code[rows, j], h[rows], len(e) + 1))[:-1]
        gain = sum_g**2 / (sum_h + l2) + (total_g - sum_g) ** 2 / (total_h - sum_h + l2) - total_g**2 / (total_h + l2)
        gain[(sum_h < least) | (total_h - sum_h < least)] = -1
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), j, k)
    _, j, k = best
    if j < 0:
        return
    tree.feature[at], tree.threshold[at] = j, float(edges[j][k])
    low = code[rows, j] <= k
    for side, part in ((tree.left, rows[low]), (tree.right, rows[~low])):
        side[at] = tree.add()
        grow(tree, side[at], part, code, edges, g, h, depth - 1, rate, l2, least)
