"""Histogram gradient-boosted trees for a bounded training sample, and isotonic calibration.

Trees are complete and stored flat: node k has children 2k+1 and 2k+2, so scoring is a few
vectorised steps per level for a whole batch and all trees at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    feature: np.ndarray  # (trees, inner nodes)
    cut: np.ndarray      # (trees, inner nodes); +inf where a node is not split
    leaf: np.ndarray     # (trees, leaves)
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Sum of the leaves each row reaches."""
        trees, inner = self.feature.shape
        tree = np.arange(trees)[None, :]
        row = np.arange(len(x))[:, None]
        node = np.zeros((len(x), trees), dtype=np.int64)
        while len(x) and trees and node[0, 0] < inner:
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.cut[tree, node])
        return self.base + self.leaf[tree, node - inner].sum(axis=1)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.15,
        bins: int = 64, damping: float = 1.0, least: float = 2.0) -> Forest:
    """Logistic loss; a split needs a hessian of ``least`` on either side."""
    n, width = x.shape
    inner, leaves = 2 ** depth - 1, 2 ** depth
    rate_of_ones = float(np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    base = float(np.log(rate_of_ones / (1 - rate_of_ones)))
    if n == 0 or y.min() == y.max():
        return Forest(np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)), base)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    flat = code + np.arange(width) * bins
    forest = Forest(np.zeros((rounds, inner), int), np.full((rounds, inner), np.inf),
                    np.zeros((rounds, leaves)), base)
    z = np.full(n, base)
    for t in range(rounds):
        p = sigmoid(z)
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, many = 2 ** level - 1, 2 ** level
            slot = ((node - first)[:, None] * (width * bins) + flat).ravel()
            shape = (many, width, bins)
            g = np.bincount(slot, np.repeat(grad, width), many * width * bins).reshape(shape).cumsum(2)
            h = np.bincount(slot, np.repeat(hess, width), many * width * bins).reshape(shape).cumsum(2)
            total_g, total_h = g[:, :, -1:], h[:, :, -1:]
            gain = (g ** 2 / (h + damping) + (total_g - g) ** 2 / (total_h - h + damping)
                    - total_g ** 2 / (total_h + damping))
            gain[(h < least) | (total_h - h < least)] = -np.inf
            best = gain.reshape(many, -1).argmax(axis=1)
            for k in range(many):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-6 and b < len(edges[j]):
                    forest.feature[t, first + k] = j
                    forest.cut[t, first + k] = edges[j][b]
            right = x[np.arange(n), forest.feature[t, node]] > forest.cut[t, node]
            node = 2 * node + 1 + right
        at = node - inner
        value = -np.bincount(at, grad, leaves) / (np.bincount(at, hess, leaves) + damping)
        forest.leaf[t] = rate * value
        z += forest.leaf[t][at]
    return forest


@dataclass
class Calibration:
    """Non-decreasing map from margins to probabilities, linear between its points."""
    at: np.ndarray
    value: np.ndarray

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(margin, self.at, self.value), 0.0, 1.0)


def isotonic(margin: np.ndarray, y: np.ndarray) -> Calibration:
    """Pool adjacent violators; equal margins count as one point. Every pool is shrunk by half a
    case towards either side, so that a pool of a few rows is not certain of anything."""
    at, inverse = np.unique(margin, return_inverse=True)
    weight = np.bincount(inverse).astype(float)
    pools: list[list[float]] = []  # ones, rows, first point, last point
    for k, (s, w) in enumerate(zip(np.bincount(inverse, y), weight, strict=True)):
        pools.append([s, w, k, k])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s2, w2, _, last = pools.pop()
            pools[-1][0] += s2
            pools[-1][1] += w2
            pools[-1][3] = last
    value = np.maximum.accumulate([(s + 0.5) / (w + 1) for s, w, *_ in pools])
    points = np.array([at[int(k)] for *_, a, b in pools for k in (a, b)])
    return Calibration(points, np.repeat(value, 2))


def fit_calibrated(x: np.ndarray, y: np.ndarray, folds: int = 3, **settings) -> tuple[Forest, Calibration]:
    """A forest on all rows, calibrated on margins of forests that have not seen the row."""
    forest = fit(x, y, **settings)
    if len(y) < 3 * folds or y.min() == y.max():
        rate = float(y.mean()) if len(y) else 0.0
        return forest, Calibration(np.array([0.0]), np.array([rate]))
    part, out = np.arange(len(y)) % folds, np.zeros(len(y))
    for k in range(folds):
        out[part == k] = fit(x[part != k], y[part != k], **settings).margin(x[part == k])
    return forest, isotonic(out, y)
