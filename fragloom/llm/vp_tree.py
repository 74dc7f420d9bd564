"""Vantage-point trees over norm-augmented vectors, for inner products in whole numbers.

Every vector y gets one more component, sqrt(M2 - |y|^2) with M2 the largest squared norm, so all lie on a sphere; a query a gets 0 there.
Then |a - y|^2 = |a|^2 + M2 - 2 * a.y: the larger the product, the nearer, and a window of products is a ring of distances.
A node has a vantage point and two halves, the nearer and the farther vectors, each with the least and largest distance from it. The triangle
inequality bounds the distances of a half from any query. Bounds are floating numbers, widened by SLACK; products are exact.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

#: Vectors of a leaf.
LEAF = 128
#: By which bounds are widened, relative to the diameter of the sphere.
SLACK = 1e-7


def exact_type(most: int, dim: int) -> type:
    """The number type in which products of vectors with components up to ``most`` are exact. Doubles are the faster."""
    bound = most * most * dim
    if bound >= 1 << 62:
        raise ValueError(f"products of {dim} components up to {most} leave the long type")
    return np.float64 if bound < 1 << 52 else np.int64


@dataclass
class Tree:
    """Node k: vantage[k] is a vector, kids[k] the two nodes, or leaves as -1 - number; bounds[k, side] least and largest distance.
    Leaf l holds the vectors order[starts[l]:starts[l + 1]]."""

    vantage: np.ndarray
    lift: np.ndarray
    kids: np.ndarray
    bounds: np.ndarray
    order: np.ndarray
    starts: np.ndarray


def _lift(x: np.ndarray, m2: int) -> np.ndarray:
    return np.sqrt(np.maximum(m2 - (x.astype(np.float64) ** 2).sum(axis=1), 0.0))


def _from(x: np.ndarray, lift: np.ndarray, at: np.ndarray, height: float) -> np.ndarray:
    return np.sqrt(((x - at) ** 2).sum(axis=1) + (lift - height) ** 2)


def build(x: np.ndarray, m2: int, leaf: int = LEAF, open_ended: bool = False) -> Tree:
    """open_ended: bounds that also hold for vectors that are not in x and are put in a half by their distance alone."""
    points, lift = x.astype(np.float64), _lift(x, m2)
    vantage, kids, bounds, order, starts = [], [], [], [], [0]

    def grow(rows: np.ndarray) -> int:
        if len(rows) <= leaf:
            order.append(rows)
            starts.append(starts[-1] + len(rows))
            return 1 - len(starts)
        at = rows[np.argmax(_from(points[rows], lift[rows], points[rows].mean(axis=0), lift[rows].mean()))]
        d = _from(points[rows], lift[rows], points[at], lift[at])
        half = len(rows) // 2
        by = np.argsort(d, kind="stable")
        near, far = by[:half], by[half:]
        cut = d[far[0]]
        if open_ended and cut > d[by[0]]:  # equal distances are of the farther half
            near, far = np.flatnonzero(d < cut), np.flatnonzero(d >= cut)
        k = len(vantage)
        vantage.append(at)
        kids.append(None)
        bounds.append(((0.0, cut), (cut, np.inf)) if open_ended else ((d[near[0]], d[near].max()), (d[far].min(), d[far].max())))
        kids[k] = (grow(rows[near]), grow(rows[far]))
        return k

    grow(np.arange(len(x)))
    at = np.array(vantage, np.int64)
    return Tree(points[at], lift[at], np.array(kids, np.int64).reshape(-1, 2), np.array(bounds, np.float64).reshape(-1, 2, 2), np.concatenate(order) if order else np.zeros(0, np.int64), np.array(starts, np.int64))


def place(tree: Tree, x: np.ndarray, m2: int) -> np.ndarray:
    """The leaf of an open-ended tree that each vector belongs to."""
    points, lift, out = x.astype(np.float64), _lift(x, m2), np.zeros(len(x), np.int64)
    todo = [(0 if len(tree.kids) else -1, np.arange(len(x)))]
    while todo:
        k, rows = todo.pop()
        if k < 0:
            out[rows] = -1 - k
        elif len(rows):
            far = _from(points[rows], lift[rows], tree.vantage[k], tree.lift[k]) >= tree.bounds[k, 1, 0]
            todo += [(tree.kids[k, 0], rows[~far]), (tree.kids[k, 1], rows[far])]
    return out


class Query:
    """A vector a against a tree: distances to its vantage points, at once, and nodes by their bounds."""

    def __init__(self, tree: Tree, a: np.ndarray, m2: int):
        a = a.astype(np.float64)
        self.tree, self.c = tree, float(a @ a) + m2
        self.slack = SLACK * (2 * np.sqrt(self.c) + 1)
        self.from_vantage = np.sqrt(np.maximum(self.c - 2 * (tree.vantage @ a), 0.0)) if len(tree.kids) else np.zeros(0)

    def radius(self, score: float) -> float:
        """The distance at which products are ``score``."""
        return float(np.sqrt(max(self.c - 2 * score, 0.0)))

    def nearest_first(self, inner: float, outer: float):
        """(bound, leaf) of the leaves that a ring may meet, by the least distance that a vector of theirs can have in it. Only nodes that
        are reached are opened."""
        heap = [(inner, 0 if len(self.tree.kids) else -1, 0.0, np.inf)]
        while heap:
            bound, k, least, most = heapq.heappop(heap)
            if k < 0:
                yield bound, -1 - k
                continue
            d = self.from_vantage[k]
            for side in (0, 1):
                low, high = self.tree.bounds[k, side]
                near, far = max(least, d - high, low - d), min(most, d + high)
                if near - self.slack <= outer and far + self.slack >= inner:
                    heapq.heappush(heap, (max(near - self.slack, inner), int(self.tree.kids[k, side]), near, far))
