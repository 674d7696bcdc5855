"""Gradient-boosted decision trees for two classes, on binned features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Boosted:
    """Complete binary trees: node k has children 2k+1 and 2k+2; an unsplit node sends everything left."""

    edges: list[np.ndarray]  # per feature, the upper edges of its bins
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # bin; a row goes right if its bin is larger
    leaf: np.ndarray  # trees x leaves
    base: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1).astype(np.int16)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if not len(x):
            return out
        b = self.bins(x)
        inner = self.feature.shape[1]
        rows = np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(inner + 1))):
                at = 2 * at + 1 + (b[rows, f[at]] > t[at])
            out += leaf[at - inner]
        return out


def train_boosted(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, trees: int = 40, depth: int = 4, rate: float = 0.25, l2: float = 1.0) -> Boosted:
    """Newton boosting of the logistic loss; deterministic, no sampling."""
    n, m = x.shape
    w = np.ones(n) if weight is None else weight.astype(float)
    edges = []
    for j in range(m):
        values = np.unique(x[:, j])
        mids = (values[1:] + values[:-1]) / 2
        edges.append(mids if len(mids) < BINS else np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])))
    model = Boosted(edges, np.zeros((0, 2**depth - 1), np.int64), np.zeros((0, 2**depth - 1), np.int64), np.zeros((0, 2**depth)), 0.0)
    p0 = np.clip((w * y).sum() / w.sum(), 1e-4, 1 - 1e-4)
    model.base = float(np.log(p0 / (1 - p0)))
    b = model.bins(x)
    flat = b + np.arange(m) * BINS
    score = np.full(n, model.base)
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = w * (y - p), w * p * (1 - p) + 1e-9
        f, t = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, BINS, np.int64)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            local = at - first
            key = (local[:, None] * (m * BINS) + flat).ravel()
            size = count * m * BINS
            gs = np.bincount(key, weights=np.repeat(g, m), minlength=size).reshape(count, m, BINS).cumsum(axis=2)
            hs = np.bincount(key, weights=np.repeat(h, m), minlength=size).reshape(count, m, BINS).cumsum(axis=2)
            gt, ht = gs[:, :1, -1:], hs[:, :1, -1:]
            gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
            best = gain.reshape(count, -1).argmax(axis=1)
            good = gain.reshape(count, -1)[np.arange(count), best] > 1e-6
            f[first : first + count] = np.where(good, best // BINS, 0)
            t[first : first + count] = np.where(good, best % BINS, BINS)
            at = 2 * at + 1 + (b[np.arange(n), f[at]] > t[at])
        leaf_at = at - (2**depth - 1)
        leaf = rate * np.bincount(leaf_at, weights=g, minlength=2**depth) / (np.bincount(leaf_at, weights=h, minlength=2**depth) + l2)
        score += leaf[leaf_at]
        features.append(f)
        thresholds.append(t)
        leaves.append(leaf)
    model.feature, model.threshold, model.leaf = np.array(features), np.array(thresholds), np.array(leaves)
    return model
