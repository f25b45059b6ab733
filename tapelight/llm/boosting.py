"""Gradient-boosted trees for binary decisions: trained with numpy histograms, scored as flat node arrays.

Every tree has the same depth, so a forest is three arrays: a feature and a threshold for each inner node and a
value for each leaf. Rows walk down all trees together. A feature can be held monotone: 1 never lowers the score
as the feature grows, -1 never raises it (splits that break this are refused and bounds go down to the leaves).
Null or NaN features count as 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """features, thresholds: (trees, 2 ** depth - 1); leaves: (trees, 2 ** depth); base: the score without trees."""

    features: np.ndarray
    thresholds: np.ndarray
    leaves: np.ndarray
    base: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        rows = np.nan_to_num(np.asarray(rows, float), nan=0.0)
        out = np.full(len(rows), self.base)
        each = np.arange(len(rows))
        for feature, threshold, leaf in zip(self.features, self.thresholds, self.leaves, strict=True):
            node = np.zeros(len(rows), np.int64)
            while len(node) and node[0] < len(feature):
                node = 2 * node + 1 + (rows[each, feature[node]] > threshold[node])
            out += leaf[node - len(feature)] if len(node) else 0
        return out


def train(rows: np.ndarray, labels: np.ndarray, monotone: np.ndarray | None = None, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, penalty: float = 1.0, least: int = 5) -> Forest:
    """Fit log-loss trees to 0/1 labels; the same input always gives the same forest."""
    rows, labels = np.nan_to_num(np.asarray(rows, float), nan=0.0), np.asarray(labels, float)
    n, width = rows.shape
    monotone = np.zeros(width, int) if monotone is None else np.asarray(monotone)
    edges = []
    for j in range(width):
        values = np.unique(rows[:, j])
        middles = (values[1:] + values[:-1]) / 2
        edges.append(middles if len(middles) < bins else np.unique(np.quantile(middles, np.linspace(0, 1, bins - 1))))
    codes = np.stack([np.searchsorted(e, rows[:, j], "left") for j, e in enumerate(edges)], 1)
    share = np.clip(labels.mean() if n else 0.5, 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    score = np.full(n, base)
    inner = 2**depth - 1
    features, thresholds, leaves = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        chance = 1 / (1 + np.exp(-score))
        slope, curve = labels - chance, chance * (1 - chance)
        node = np.zeros(n, np.int64)
        bounds = {0: (-np.inf, np.inf)}
        for k in range(inner):
            own = np.flatnonzero(node == k)
            low, high = bounds[k]
            best = (1e-9, None)
            g, h = slope[own].sum(), curve[own].sum()
            for j in range(width):
                if not len(edges[j]) or len(own) < 2 * least:
                    continue
                size = len(edges[j]) + 1
                c = codes[own, j]
                gl, hl, nl = (np.cumsum(np.bincount(c, w, size))[:-1] for w in (slope[own], curve[own], None))
                left, right = np.clip(gl / (hl + penalty), low, high), np.clip((g - gl) / (h - hl + penalty), low, high)
                gain = gl * left - (hl + penalty) * left**2 / 2 + (g - gl) * right - (h - hl + penalty) * right**2 / 2
                parent = np.clip(g / (h + penalty), low, high)
                gain = gain - (g * parent - (h + penalty) * parent**2 / 2)
                gain[(nl < least) | (len(own) - nl < least) | (monotone[j] * (right - left) < 0)] = -np.inf
                at = int(np.argmax(gain))
                if gain[at] > best[0]:
                    best = (gain[at], (j, edges[j][at], left[at], right[at]))
            if best[1] is None:  # no split: all go left, and both sides have the parent's value
                bounds[2 * k + 1] = bounds[2 * k + 2] = (low, high)
                node[own] = 2 * k + 1
                continue
            j, threshold, left, right = best[1]
            features[t, k], thresholds[t, k] = j, threshold
            middle = (left + right) / 2
            bounds[2 * k + 1] = (low, min(high, middle)) if monotone[j] > 0 else (max(low, middle), high) if monotone[j] < 0 else (low, high)
            bounds[2 * k + 2] = (max(low, middle), high) if monotone[j] > 0 else (low, min(high, middle)) if monotone[j] < 0 else (low, high)
            node[own] = 2 * k + 1 + (rows[own, j] > threshold)
        leaf = node - inner
        g, h = np.bincount(leaf, slope, inner + 1), np.bincount(leaf, curve, inner + 1)
        for k in range(inner + 1):
            leaves[t, k] = rate * np.clip(g[k] / (h[k] + penalty), *bounds[inner + k])
        score += leaves[t, leaf]
    return Forest(features, thresholds, leaves, base)
