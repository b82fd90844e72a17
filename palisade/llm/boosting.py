"""Gradient-boosted trees on binned dense features, and isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class Boosted:
    """Trees of one depth as arrays: feature and split of each inner node, value of each leaf."""

    base: float
    feature: np.ndarray
    split: np.ndarray
    value: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = int(np.log2(self.value.shape[1]))
        for f, s, v in zip(self.feature, self.split, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > s[at])
            out += v[at - (v.size - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.25, ridge: float = 1.0) -> Boosted:
    """Logistic loss, Newton steps, histogram splits."""
    mean = min(max(float(y.mean()) if len(y) else 0.0, 1e-3), 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    n_inner, n_leaf = 2**depth - 1, 2**depth
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    codes = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1) if len(x) else np.zeros(x.shape, np.int64)
    margin = np.full(len(x), base)
    trees = []
    for _ in range(rounds if len(x) else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, split = np.zeros(n_inner, np.int64), np.full(n_inner, np.inf)
        at = np.zeros(len(x), np.int64)
        for node in range(n_inner):
            rows = np.flatnonzero(at == node)
            best = (1e-6, 0, np.inf)
            if len(rows) > 1:
                gs, hs = g[rows].sum(), h[rows].sum()
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    left_g = np.cumsum(np.bincount(codes[rows, j], g[rows], len(c) + 1))[:-1]
                    left_h = np.cumsum(np.bincount(codes[rows, j], h[rows], len(c) + 1))[:-1]
                    gain = left_g**2 / (left_h + ridge) + (gs - left_g) ** 2 / (hs - left_h + ridge) - gs**2 / (hs + ridge)
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (float(gain[k]), j, float(c[k]))
            feature[node], split[node] = best[1], best[2]
            at[rows] = 2 * node + 1 + (x[rows, best[1]] > best[2])
        leaf = at - n_inner
        value = -rate * np.bincount(leaf, g, n_leaf) / (np.bincount(leaf, h, n_leaf) + ridge)
        margin += value[leaf]
        trees.append((feature, split, value))
    parts = [np.array([t[i] for t in trees]) for i in range(3)] if trees else [np.zeros((0, n_inner), np.int64), np.zeros((0, n_inner)), np.zeros((0, n_leaf))]
    return Boosted(base, *parts)


def isotonic(score: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots (score, probability), non-decreasing; read off by ``calibrated``.
    ``weight`` is how many rows each (score, mean of y) stands for, one without it."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum, weight, lowest and highest score
    for s, t, n in zip(score[order], y[order], np.ones(len(y)) if weight is None else weight[order]):
        blocks.append([float(t * n), float(n), float(s), float(s)])
        while len(blocks) > 1 and (blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1] or blocks[-2][3] == blocks[-1][2]):
            b = blocks.pop()
            a = blocks[-1]
            blocks[-1] = [a[0] + b[0], a[1] + b[1], a[2], b[3]]
    xs = [e for b in blocks for e in (b[2], b[3])]
    ps = [b[0] / b[1] for b in blocks for _ in range(2)]
    return np.array(xs), np.array(ps)


def calibrated(knots: tuple[np.ndarray, np.ndarray], score: np.ndarray) -> np.ndarray:
    """Linear between knots, constant beyond; without knots the logistic of the score."""
    return np.interp(score, *knots) if len(knots[0]) else 1 / (1 + np.exp(-score))
