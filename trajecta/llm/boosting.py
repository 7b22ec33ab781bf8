"""Gradient-boosted trees of one depth for a binary label, on arrays that fit a task."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

DEPTH, ROUNDS, RATE, BINS, LEAST = 3, 80, 0.3, 24, 5.0


@dataclass
class Trees:
    """Nodes of tree t in heap order: feature and cut of the inner ones (above the cut goes right), values of the leaves."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    start: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += value[at - (2**DEPTH - 1)]
        return out


def boosted(x: np.ndarray, y: np.ndarray) -> Trees:
    """Logistic boosting with Newton leaves; cuts are quantiles of the features."""
    n, m = x.shape
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    score = np.full(n, np.log(share / (1 - share)))
    start = float(score[0])
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(m)]
    codes = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(m)], axis=1)
    inner = 2**DEPTH - 1
    features, limits, values = [], [], []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        at = np.zeros(n, dtype=np.int64)
        feature, cut = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        for node in range(inner):
            here = np.flatnonzero(at == node)
            best = (1e-3, 0, np.inf)
            if len(here):
                total_g, total_h = g[here].sum(), h[here].sum()
                for j in range(m):
                    if not len(cuts[j]):
                        continue
                    left_g = np.cumsum(np.bincount(codes[here, j], g[here], minlength=len(cuts[j]) + 1))[:-1]
                    left_h = np.cumsum(np.bincount(codes[here, j], h[here], minlength=len(cuts[j]) + 1))[:-1]
                    right_g, right_h = total_g - left_g, total_h - left_h
                    gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - total_g**2 / (total_h + 1)
                    gain[(left_h < LEAST * 0.05) | (right_h < LEAST * 0.05)] = 0
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), j, float(cuts[j][k]))
            feature[node], cut[node] = best[1], best[2]
            at[here] = 2 * node + 1 + (x[here, best[1]] > best[2])
        leaf = at - inner
        value = RATE * np.bincount(leaf, g, minlength=inner + 1) / (np.bincount(leaf, h, minlength=inner + 1) + 1)
        score += value[leaf]
        features.append(feature)
        limits.append(cut)
        values.append(value)
    return Trees(np.array(features), np.array(limits), np.array(values), start)
