"""Gradient-boosted trees on binned features, and isotonic calibration, for a bounded training sample.

Both run on the driver over a sample whose size is a parameter of the caller; scoring is vectorised and runs anywhere.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Booster:
    """Additive trees of fixed depth under logistic loss; a tree is arrays of feature, cut and leaf value."""

    base: float
    cuts: list[np.ndarray]
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], axis=1).astype(np.int16)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(int(np.log2(len(value)))):
                node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
            out += value[node - (len(value) - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, penalty: float = 1.0) -> Booster:
    """Newton boosting; the split with the largest gain at each node, ties to the earlier feature and cut."""
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    model = Booster(float(np.log(share / (1 - share))), cuts)
    b = model.binned(x).astype(np.int64)
    f = np.full(len(y), model.base)
    inner = (1 << depth) - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, bins, np.int64)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, n = (1 << level) - 1, 1 << level
            place = node - first
            best = np.zeros(n)
            total_g, total_h = np.bincount(place, g, n), np.bincount(place, h, n)
            whole = total_g**2 / (total_h + penalty)
            for j in range(x.shape[1]):
                key = place * bins + b[:, j]
                left_g = np.cumsum(np.bincount(key, g, n * bins).reshape(n, bins), axis=1)[:, :-1]
                left_h = np.cumsum(np.bincount(key, h, n * bins).reshape(n, bins), axis=1)[:, :-1]
                right_g, right_h = total_g[:, None] - left_g, total_h[:, None] - left_h
                gain = left_g**2 / (left_h + penalty) + right_g**2 / (right_h + penalty) - whole[:, None]
                gain[(left_h < 1e-3) | (right_h < 1e-3)] = 0
                at = gain.argmax(axis=1)
                top = gain[np.arange(n), at]
                better = top > best + 1e-9
                best[better] = top[better]
                feature[first:][:n][better], cut[first:][:n][better] = j, at[better]
            node = 2 * node + 1 + (b[np.arange(len(y)), feature[node]] > cut[node])
        leaf = node - inner
        value = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + penalty)
        f += value[leaf]
        model.trees.append((feature, cut, value))
    return model


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators fit of y on margin: knots to interpolate between, increasing in both."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum of y, weight, sum of margins
    for m, t in zip(margin[order].tolist(), y[order].tolist()):
        blocks.append([t, 1.0, m])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            t2, w2, m2 = blocks.pop()
            blocks[-1][0] += t2
            blocks[-1][1] += w2
            blocks[-1][2] += m2
    knots = np.array([m / w for _, w, m in blocks])
    return knots, np.array([t / w for t, w, _ in blocks])
