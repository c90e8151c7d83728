"""Gradient-boosted trees in numpy: second-order logistic boosting, monotonic constraints, flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Complete binary trees, flattened: row t of each array is tree t; node i has the children 2i+1 and 2i+2."""

    feature: np.ndarray  # int16 [trees, 2^depth - 1]
    threshold: np.ndarray  # float64, same shape; a value above it goes to the right
    leaf: np.ndarray  # float64 [trees, 2^depth]
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row of ``x``, all trees at once, one gather per level."""
        n_trees, inner = self.feature.shape
        if n_trees == 0 or len(x) == 0:
            return np.full(len(x), self.bias)
        tree, row = np.arange(n_trees)[None, :], np.arange(len(x))[:, None]
        at = np.zeros((len(x), n_trees), np.int64)
        for _ in range((inner + 1).bit_length() - 1):
            right = x[row, self.feature[tree, at]] > self.threshold[tree, at]
            at = 2 * at + 1 + right
        return self.bias + self.leaf[tree, at - inner].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit(
    x: np.ndarray,
    y: np.ndarray,
    monotone: np.ndarray,
    trees: int = 60,
    depth: int = 3,
    rate: float = 0.2,
    bins: int = 64,
    l2: float = 1.0,
    min_hessian: float = 1.0,
) -> Trees:
    """Fit on rows ``x`` and labels ``y`` (0/1). ``monotone`` has +1, -1 or 0 for each feature.

    A constrained split must have its leaf values in the asked order, and the children's later values stay on their
    side of the middle between them, so that the whole tree is monotonic in the feature. One class only, or no
    rows at all, gives a constant.
    """
    if len(y) == 0 or y.min() == y.max():
        return Trees(np.zeros((0, 2**depth - 1), np.int16), np.zeros((0, 2**depth - 1)), np.zeros((0, 2**depth)), 4.0 if len(y) == 0 or y[0] else -4.0)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    share = y.mean()
    bias = float(np.log(share / (1 - share)))
    margin = np.full(len(y), bias)
    inner = 2**depth - 1
    feature, threshold, leaf = (np.zeros((trees, inner), np.int16), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        # node: (index, rows, lower and upper bound of its values)
        level = [(0, np.arange(len(y)), -np.inf, np.inf)]
        for _ in range(depth):
            below = []
            for node, rows, low, high in level:
                split = _best_split(binned[rows], grad[rows], hess[rows], edges, monotone, low, high, l2, min_hessian)
                if split is None:  # everything goes to the left; the right side repeats the value
                    below += [(2 * node + 1, rows, low, high), (2 * node + 2, rows[:0], low, high)]
                    continue
                f, cut, left_value, right_value = split
                feature[t, node], threshold[t, node] = f, edges[f][cut]
                goes_left = binned[rows, f] <= cut
                middle = (left_value + right_value) / 2
                bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[int(monotone[f])]
                below += [(2 * node + 1, rows[goes_left], *bounds[0]), (2 * node + 2, rows[~goes_left], *bounds[1])]
            level = below
        for node, rows, low, high in level:
            value = rate * np.clip(_value(grad[rows].sum(), hess[rows].sum(), l2), low, high) if len(rows) else 0.0
            leaf[t, node - inner] = value
            margin[rows] += value
    return Trees(feature, threshold, leaf, bias)


def _value(g, h, l2):
    return -g / (h + l2)


def _best_split(binned, grad, hess, edges, monotone, low, high, l2, min_hessian):
    """(feature, bin, left value, right value) of the best allowed split, or None."""
    best, found = 1e-6, None
    g_all, h_all = grad.sum(), hess.sum()
    parent = g_all**2 / (h_all + l2)
    for f, e in enumerate(edges):
        if len(e) == 0:
            continue
        g = np.cumsum(np.bincount(binned[:, f], grad, len(e) + 1))[:-1]
        h = np.cumsum(np.bincount(binned[:, f], hess, len(e) + 1))[:-1]
        left, right = np.clip(_value(g, h, l2), low, high), np.clip(_value(g_all - g, h_all - h, l2), low, high)
        gain = g**2 / (h + l2) + (g_all - g) ** 2 / (h_all - h + l2) - parent
        allowed = (h >= min_hessian) & (h_all - h >= min_hessian) & (monotone[f] * (right - left) >= 0)
        gain = np.where(allowed, gain, 0)
        k = int(gain.argmax())
        if gain[k] > best:
            best, found = gain[k], (f, k, float(left[k]), float(right[k]))
    return found
