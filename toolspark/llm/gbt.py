"""Gradient-boosted trees in numpy: histogram training with monotonic constraints, scoring from flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Flat nodes of all trees: a row goes right if x[feature] > threshold (missing values go left); leaves have feature -1."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    bias: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of the rows of x; all rows take one step down a tree at a time."""
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(f, 0)] > self.threshold[at]
                at = np.where(inner, np.where(right, self.right[at], self.left[at]), at)
            out += self.value[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit(x: np.ndarray, y: np.ndarray, monotone: dict[int, int] | None = None, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 1.0) -> Trees:
    """Logistic boosting. monotone: feature -> 1 (score never falls as it grows) or -1. Ties in gain go to the first feature and cut, so refits agree.

    One class only, or no rows: a constant."""
    monotone = monotone or {}
    n, m = x.shape
    rate_y = (y.sum() + 0.5) / (n + 1)
    bias = float(np.log(rate_y / (1 - rate_y)))
    nodes: list[list[float]] = []
    roots = []
    if not n or y.min() == y.max():
        return Trees(np.array([-1]), np.zeros(1), np.zeros(1, int), np.zeros(1, int), np.zeros(1), np.zeros(0, int), bias, 0)
    x = np.nan_to_num(x, nan=-np.inf)
    cuts = []
    for j in range(m):
        v = np.unique(x[:, j][np.isfinite(x[:, j])])
        if len(v) > bins:
            v = np.unique(np.quantile(x[:, j][np.isfinite(x[:, j])], np.linspace(0, 1, bins + 1)))
        cuts.append((v[1:] + v[:-1]) / 2)
    code = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    width = max(len(c) for c in cuts) + 1
    # all features' histograms of a node in one count: feature j has the numbers from j * width on
    code += (np.arange(m) * width)[None, :]
    possible = np.arange(width - 1)[None, :] < np.array([len(c) for c in cuts])[:, None]
    sign = np.array([monotone.get(j, 0) for j in range(m)])[:, None]
    score = np.full(n, bias)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        gs, hs = g[rows].sum(), h[rows].sum()
        at = None
        if level < depth and hs > 2 * least and width > 1:
            c = code[rows].ravel()
            gl, hl = (np.cumsum(np.bincount(c, np.repeat(v[rows], m), m * width).reshape(m, width), 1)[:, :-1] for v in (g, h))
            gr, hr = gs - gl, hs - hl
            gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - gs**2 / (hs + ridge)
            vl, vr = -gl / (hl + ridge), -gr / (hr + ridge)
            ok = possible & (hl >= least) & (hr >= least) & (sign * (np.clip(vr, low, high) - np.clip(vl, low, high)) >= 0)
            gain = np.where(ok, gain, 0)
            j, k = divmod(int(gain.argmax()), width - 1)
            if gain[j, k] > 1e-6:
                at = (j, k, vl[j, k], vr[j, k])
        me = len(nodes)
        value = float(np.clip(-gs / (hs + ridge), low, high))
        nodes.append([-1, 0.0, me, me, rate * value])
        if at is None:
            score[rows] += rate * value
            return me
        j, k, vl, vr = at
        right = code[rows, j] - j * width > k
        bounds = [(low, high), (low, high)]
        if j in monotone:
            mid = float((np.clip(vl, low, high) + np.clip(vr, low, high)) / 2)
            bounds = [(low, mid), (mid, high)] if monotone[j] > 0 else [(mid, high), (low, mid)]
        a = grow(rows[~right], g, h, level + 1, *bounds[0])
        b = grow(rows[right], g, h, level + 1, *bounds[1])
        nodes[me] = [j, float(cuts[j][k]), a, b, 0.0]
        return me

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        roots.append(grow(np.arange(n), p - y, np.maximum(p * (1 - p), 1e-9), 0, -8.0, 8.0))
    a = np.array(nodes)
    return Trees(a[:, 0].astype(np.int64), a[:, 1], a[:, 2].astype(np.int64), a[:, 3].astype(np.int64), a[:, 4], np.array(roots), bias, depth)
