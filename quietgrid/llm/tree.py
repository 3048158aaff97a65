"""A small binary decision tree, grown by Gini impurity."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Node:
    share: float  # of label 1 among the rows of the node
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 1) -> Node:
    """Splits while it lowers impurity; ties go to the first feature and the lowest cut."""
    node = Node(float(y.mean()) if len(y) else 0.0)
    if depth == 0 or len(y) < 2 * least or node.share in (0.0, 1.0):
        return node
    best = len(y) * node.share * (1 - node.share) - 1e-9
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        v, ones = x[order, j], np.cumsum(y[order])
        for i in np.flatnonzero(v[1:] > v[:-1]) + 1:
            if least <= i <= len(y) - least:
                a, b = ones[i - 1], ones[-1] - ones[i - 1]
                cost = a * (1 - a / i) + b * (1 - b / (len(y) - i))
                if cost < best:
                    best, node.feature, node.cut = cost, j, float(v[i - 1] + v[i]) / 2
    if node.feature >= 0:
        low = x[:, node.feature] <= node.cut
        node.low, node.high = grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)
    return node


def share(node: Node, row: list[float]) -> float:
    while node.feature >= 0:
        node = node.low if row[node.feature] <= node.cut else node.high
    return node.share
