"""Gradient-boosted trees for yes/no labels, with monotonic constraints, flattened into node arrays.

Fitting takes a bounded feature matrix (a documented sample of labelled rows); scoring is vectorised over numpy
node arrays and runs inside tasks over all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class Forest:
    """Trees as parallel arrays of shape (trees, nodes); a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Sum of the trees' leaf values; rows are walked level by level, all at once."""
        x = np.nan_to_num(np.asarray(x, dtype="f8"), nan=0.0, posinf=1e300, neginf=-1e300)
        rows, out = np.arange(len(x)), np.full(len(x), self.base)
        for t in range(len(self.feature)):
            node = np.zeros(len(x), dtype="i4")
            for _ in range(self.depth):
                right = x[rows, self.feature[t][node]] > self.threshold[t][node]
                node = np.where(right, self.right[t][node], self.left[t][node])
            out += self.value[t][node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, monotone: dict[int, int] | None = None, trees: int = 40, depth: int = 4,
        rate: float = 0.2, ridge: float = 1.0, least_rows: int = 5) -> Forest:
    """Second-order boosting of the logistic loss over histogram bins.

    ``monotone`` maps a feature to +1 or -1: a split on it must keep the children's values in that order, and the
    middle between them bounds all later values on either side, so the whole forest is monotonic in the feature.
    Without rows, or with one label only, the forest is constant.
    """
    x = np.nan_to_num(np.asarray(x, dtype="f8"), nan=0.0, posinf=1e300, neginf=-1e300)
    y = np.asarray(y, dtype="f8")
    monotone = monotone or {}
    n_nodes = (1 << (depth + 1)) - 1
    rate_1 = (y.sum() + 0.5) / (len(y) + 1.0)
    base = float(np.log(rate_1 / (1 - rate_1)))
    if len(y) == 0 or y.min() == y.max():
        trees = 0
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1], method="lower")) if len(x) else np.zeros(0)
             for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1) if len(x) else x
    forest = Forest(np.zeros((trees, n_nodes), "i4"), np.full((trees, n_nodes), np.inf), np.zeros((trees, n_nodes), "i4"),
                    np.zeros((trees, n_nodes), "i4"), np.zeros((trees, n_nodes)), base, depth)
    margin = np.full(len(y), base)
    for t in range(trees):
        p = 1.0 / (1.0 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        forest.left[t] = forest.right[t] = np.arange(n_nodes)
        value = lambda gs, hs: rate * gs / (hs + ridge)
        stack, used = [(0, np.arange(len(y)), 0, -np.inf, np.inf)], 1
        while stack:
            node, rows, level, low, high = stack.pop()
            forest.value[t, node] = float(np.clip(value(g[rows].sum(), h[rows].sum()), low, high))
            best = _best_split(binned, edges, g, h, rows, monotone, ridge, least_rows, value, low, high) if level < depth else None
            if best is None:
                margin[rows] += forest.value[t, node]
                continue
            j, cut, v_left, v_right = best
            go_right = binned[rows, j] > cut
            forest.feature[t, node], forest.threshold[t, node] = j, edges[j][cut]
            forest.left[t, node], forest.right[t, node] = used, used + 1
            middle, sign = (v_left + v_right) / 2, monotone.get(j, 0)
            bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}.get(sign, ((low, high),) * 2)
            stack.append((used, rows[~go_right], level + 1, *bounds[0]))
            stack.append((used + 1, rows[go_right], level + 1, *bounds[1]))
            used += 2
    return forest


def _best_split(binned, edges, g, h, rows, monotone, ridge, least_rows, value, low, high):
    if len(rows) < 2 * least_rows:
        return None
    best, best_gain = None, 1e-6
    g_all, h_all = g[rows].sum(), h[rows].sum()
    for j, e in enumerate(edges):
        if not len(e):
            continue
        b = binned[rows, j]
        gl = np.cumsum(np.bincount(b, g[rows], len(e) + 1))[:-1]
        hl = np.cumsum(np.bincount(b, h[rows], len(e) + 1))[:-1]
        nl = np.cumsum(np.bincount(b, minlength=len(e) + 1))[:-1]
        gain = gl**2 / (hl + ridge) + (g_all - gl) ** 2 / (h_all - hl + ridge) - g_all**2 / (h_all + ridge)
        v_left, v_right = np.clip(value(gl, hl), low, high), np.clip(value(g_all - gl, h_all - hl), low, high)
        ok = (nl >= least_rows) & (len(rows) - nl >= least_rows)
        if sign := monotone.get(j, 0):
            ok &= sign * (v_right - v_left) >= 0
        gain = np.where(ok, gain, -np.inf)
        c = int(gain.argmax())
        if gain[c] > best_gain:
            best_gain, best = gain[c], (j, c, v_left[c], v_right[c])
    return best
