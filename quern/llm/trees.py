"""Gradient-boosted trees for two classes on histograms, in numpy; and Platt calibration."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """Trees as arrays: at node i go left if x[feature[i]] < threshold[i], to 2i+1, else to 2i+2; NaN goes left."""

    depth: int = 5
    trees: int = 60
    rate: float = 0.3
    smoothing: float = 1.0
    bins: int = 64
    base: float = 0.0
    features: list[np.ndarray] = field(default_factory=list)
    thresholds: list[np.ndarray] = field(default_factory=list)
    values: list[np.ndarray] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray, cuts: dict[int, list[float]] | None = None) -> "Boosted":
        """``cuts`` adds bin borders to those at quantiles, by feature."""
        x = np.nan_to_num(x, nan=-np.inf)
        borders = []
        for j in range(x.shape[1]):
            finite = x[np.isfinite(x[:, j]), j]
            q = np.unique(np.quantile(finite, np.linspace(0, 1, self.bins)[1:-1])) if len(finite) else np.zeros(0)
            borders.append(np.unique(np.concatenate([q, (cuts or {}).get(j, [])])))
        binned = np.stack([np.searchsorted(b, x[:, j], side="right") for j, b in enumerate(borders)], axis=1)
        width = max(len(b) for b in borders) + 1
        p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(p / (1 - p)))
        score = np.full(len(y), self.base)
        for _ in range(self.trees):
            prob = 1 / (1 + np.exp(-score))
            g, h = y - prob, prob * (1 - prob)
            nodes = 2 ** (self.depth + 1) - 1
            feature, threshold, value = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
            node = np.zeros(len(y), int)
            for i in range(nodes):
                rows = np.flatnonzero(node == i)
                if not len(rows):
                    continue
                gs, hs = g[rows].sum(), h[rows].sum()
                value[i] = gs / (hs + self.smoothing)
                if i >= 2**self.depth - 1 or len(rows) < 4:
                    continue
                best = (1e-6, -1, 0)
                for j, b in enumerate(borders):
                    if not len(b):
                        continue
                    left_g = np.bincount(binned[rows, j], g[rows], width).cumsum()[: len(b)]
                    left_h = np.bincount(binned[rows, j], h[rows], width).cumsum()[: len(b)]
                    gain = left_g**2 / (left_h + self.smoothing) + (gs - left_g) ** 2 / (hs - left_h + self.smoothing) - gs**2 / (hs + self.smoothing)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], j, k)
                if best[1] >= 0:
                    feature[i], threshold[i] = best[1], borders[best[1]][best[2]]
                    node[rows] = 2 * i + 1 + (binned[rows, best[1]] > best[2])
            leaf = self.rate * value
            self.features.append(feature)
            self.thresholds.append(threshold)
            self.values.append(leaf)
            score += leaf[node]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds."""
        x = np.nan_to_num(x, nan=-np.inf)
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.features, self.thresholds, self.values):
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                f = feature[node]
                node = np.where(f >= 0, 2 * node + 1 + (x[rows, np.maximum(f, 0)] >= threshold[node]), node)
            out += value[node]
        return out


def platt(score: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """(a, b) of the probability 1 / (1 + exp(-(a*score + b))), by Newton steps on smoothed labels; (1, 0) without both classes."""
    if len(set(y.tolist())) < 2:
        return 1.0, 0.0
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    z = np.stack([score, np.ones_like(score)], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (t - p) - 1e-3 * (w - [1.0, 0.0])
        hess = (z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])
