"""Gradient-boosted trees of depth 3 over binned dense features, for the logistic loss, and isotonic calibration; NumPy only."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

DEPTH = 3
BINS = 32


@dataclass
class Boosted:
    base: float
    feature: np.ndarray  # (trees, 2^DEPTH - 1)
    cut: np.ndarray
    leaf: np.ndarray  # (trees, 2^DEPTH)
    knots: np.ndarray  # isotonic: raw score -> probability
    values: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] >= c[node])
            out += leaf[node - (2**DEPTH - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0.0, 1.0)


def isotonic(score: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the nondecreasing function nearest to y (pool adjacent violators)."""
    order = np.lexsort((-y, score))
    blocks: list[list[float]] = []  # [mean, weight, first score, last score]
    for s, v, k in zip(score[order].tolist(), y[order].tolist(), w[order].tolist(), strict=True):
        blocks.append([v, k, s, s])
        while len(blocks) > 1 and (blocks[-2][0] >= blocks[-1][0] or blocks[-2][3] == blocks[-1][2]):
            v2, k2, _, s2 = blocks.pop()
            b = blocks[-1]
            b[0], b[1], b[3] = (b[0] * b[1] + v2 * k2) / (b[1] + k2), b[1] + k2, s2
    knots = np.array([x for b in blocks for x in (b[2], b[3])])
    return knots, np.repeat([b[0] for b in blocks], 2)


def boost(x: np.ndarray, y: np.ndarray, w: np.ndarray, trees: int = 120, rate: float = 0.1, least: float = 5.0, ridge: float = 1.0, seed: int = 11) -> Boosted:
    """Learned on three quarters of the rows; the rest calibrates."""
    rng = np.random.default_rng(seed)
    hold = np.zeros(len(y), bool)
    for c in (0, 1):
        own = rng.permutation(np.flatnonzero(y == c))
        hold[own[: len(own) // 4]] = True
    cx, cy, cw = x[hold], y[hold], w[hold]
    x, y, w = x[~hold], y[~hold], w[~hold]
    cuts = [np.unique(np.quantile(v, np.linspace(0, 1, BINS + 1)[1:-1], method="midpoint")) for v in x.T]
    # rare features are zero nearly everywhere: the smallest value above it is a cut too
    cuts = [np.unique(np.append(c, v[v > 0].min())) if (v > 0).any() else c for c, v in zip(cuts, x.T, strict=True)]
    wide = max(len(c) for c in cuts) + 1
    binned = np.stack([np.searchsorted(c, v, "right") for c, v in zip(cuts, x.T, strict=True)], axis=1)
    mean = float((y * w).sum() / w.sum())
    base = float(np.log(mean / (1 - mean)))
    f = np.full(len(y), base)
    n, d = binned.shape
    flat = binned + np.arange(d) * wide
    size = 2**DEPTH - 1
    out = Boosted(base, np.zeros((trees, size), np.int64), np.full((trees, size), np.inf), np.zeros((trees, size + 1)), np.zeros(0), np.zeros(0))
    for t in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = w * (y - p), w * p * (1 - p)
        node = np.zeros(n, np.int64)
        for k in range(size):
            rows = np.flatnonzero(node == k)
            best = 1e-6
            if len(rows):
                keys = flat[rows].ravel()
                hist = [np.bincount(keys, weights=np.repeat(v[rows], d), minlength=d * wide).reshape(d, wide) for v in (g, h, w)]
                gl, hl, wl = (np.cumsum(v, axis=1)[:, :-1] for v in hist)
                gs, hs, ws = g[rows].sum(), h[rows].sum(), w[rows].sum()
                gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                gain[(wl < least) | (ws - wl < least)] = 0
                i, b = np.unravel_index(gain.argmax(), gain.shape)
                if gain[i, b] > best and b < len(cuts[i]):
                    out.feature[t, k], out.cut[t, k] = i, cuts[i][b]
            node[rows] = 2 * k + 1 + (x[rows, out.feature[t, k]] >= out.cut[t, k])
        leaf = node - size
        gl, hl = np.bincount(leaf, weights=g, minlength=size + 1), np.bincount(leaf, weights=h, minlength=size + 1)
        out.leaf[t] = rate * gl / (hl + ridge)
        f += out.leaf[t][leaf]
    if len(cy) and cy.min() < cy.max():
        out.knots, out.values = isotonic(out.raw(cx), cy.astype(float), cw)
    else:
        out.knots = np.linspace(-8, 8, 65)
        out.values = 1 / (1 + np.exp(-out.knots))
    return out
