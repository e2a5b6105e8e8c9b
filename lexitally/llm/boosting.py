"""Gradient-boosted trees for two classes over a bounded table, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Trees:
    """Complete binary trees of one depth: feature and threshold of every inner node."""

    depth: int
    features: np.ndarray
    thresholds: np.ndarray
    leaves: np.ndarray
    base: float

    def scores(self, table: np.ndarray) -> np.ndarray:
        """Log odds of the rows."""
        total = np.full(len(table), self.base)
        rows = np.arange(len(table))
        for feature, threshold, leaves in zip(self.features, self.thresholds, self.leaves):
            node = np.zeros(len(table), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (table[rows, feature[node]] > threshold[node])
            total += leaves[node - (2**self.depth - 1)]
        return total


def fit(
    table: np.ndarray, labels: np.ndarray, trees: int = 60, depth: int = 4,
    rate: float = 0.2, ridge: float = 1.0,
) -> Trees:
    """Trees fitted to the gradients of the log loss, on features cut into ``BINS`` bins."""
    n, width = table.shape
    edges = [
        np.unique(np.quantile(table[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)
    ]
    binned = np.stack(
        [np.searchsorted(edges[f], table[:, f], side="left") for f in range(width)], axis=1
    )
    inner = 2**depth - 1
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    scores = np.full(n, base)
    found = Trees(depth, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf),
                  np.zeros((trees, inner + 1)), base)
    rows = np.arange(n)
    useful = [f for f in range(width) if table[:, f].min() < table[:, f].max()]
    for t in range(trees):
        chance = 1 / (1 + np.exp(-scores))
        slope, curve = labels - chance, chance * (1 - chance)
        node = np.zeros(n, dtype=np.int64)
        cuts = np.full(inner, BINS)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            place = (node - first) * BINS
            best = np.zeros(count)
            for f in useful:
                at = place + binned[:, f]
                g = np.bincount(at, slope, count * BINS).reshape(count, BINS).cumsum(axis=1)
                h = np.bincount(at, curve, count * BINS).reshape(count, BINS).cumsum(axis=1)
                g_all, h_all = g[:, -1:], h[:, -1:]
                gain = (
                    g**2 / (h + ridge) + (g_all - g) ** 2 / (h_all - h + ridge)
                    - g_all**2 / (h_all + ridge)
                )
                gain[(h < 1) | (h_all - h < 1)] = 0
                cut = gain[:, : len(edges[f])].argmax(axis=1)
                value = gain[np.arange(count), cut]
                better = value > best + 1e-9
                best[better] = value[better]
                at_node = first + np.flatnonzero(better)
                found.features[t, at_node] = f
                found.thresholds[t, at_node] = edges[f][cut[better]]
                cuts[at_node] = cut[better]
            node = 2 * node + 1 + (binned[rows, found.features[t, node]] > cuts[node])
        leaf = node - inner
        g = np.bincount(leaf, slope, inner + 1)
        h = np.bincount(leaf, curve, inner + 1)
        found.leaves[t] = rate * g / (h + ridge)
        scores += found.leaves[t, leaf]
    return found
