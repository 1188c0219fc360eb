"""Gradient-boosted trees of a few classes over binned features, in arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Trees:
    """Complete binary trees of equal depth; tree i belongs to class i % classes."""

    edges: list[np.ndarray]
    classes: int
    depth: int
    columns: np.ndarray  # tree, inner node
    cuts: np.ndarray  # tree, inner node: bins up to the cut go left
    leaves: np.ndarray  # tree, leaf

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Log-odds of every row and class."""
        bins = binned(rows, self.edges)
        out = np.zeros((len(rows), self.classes))
        every = np.arange(len(rows))
        for i, (columns, cuts, leaves) in enumerate(zip(self.columns, self.cuts, self.leaves, strict=True)):
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (bins[every, columns[node]] > cuts[node])
            out[:, i % self.classes] += leaves[node - len(columns)]
        return out


def edges_of(rows: np.ndarray) -> list[np.ndarray]:
    return [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in rows.T]


def binned(rows: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, rows.T, strict=True)], axis=1).astype(np.uint8)


def fit(rows: np.ndarray, labels: np.ndarray, classes: int, rounds: int = 20, depth: int = 4, step: float = 0.35,
        ridge: float = 1.0) -> Trees:
    """Newton boosting of softmax losses; every tree is grown level by level to its full depth."""
    edges = edges_of(rows)
    bins = binned(rows, edges).astype(np.int64)
    truth = np.eye(classes)[labels]
    score = np.zeros((len(rows), classes))
    inner = 2 ** depth - 1
    columns, cuts, leaves = [], [], []
    for _ in range(rounds):
        chance = np.exp(score - score.max(axis=1, keepdims=True))
        chance /= chance.sum(axis=1, keepdims=True)
        for c in range(classes):
            slope, bend = chance[:, c] - truth[:, c], np.maximum(chance[:, c] * (1 - chance[:, c]), 1e-6)
            column, cut = np.zeros(inner, np.int64), np.full(inner, BINS, np.int64)
            node = np.zeros(len(rows), np.int64)
            for level in range(depth):
                first, width = 2 ** level - 1, 2 ** level
                best = np.full(width, 1e-6)
                for f in range(bins.shape[1]):
                    if not len(edges[f]):
                        continue
                    cell = (node - first) * (BINS + 1) + bins[:, f]
                    g = np.bincount(cell, slope, width * (BINS + 1)).reshape(width, -1).cumsum(axis=1)
                    h = np.bincount(cell, bend, width * (BINS + 1)).reshape(width, -1).cumsum(axis=1)
                    total_g, total_h = g[:, -1:], h[:, -1:]
                    gain = (g ** 2 / (h + ridge) + (total_g - g) ** 2 / (total_h - h + ridge) - total_g ** 2 / (total_h + ridge))[:, :-1]
                    at = gain.argmax(axis=1)
                    value = gain[np.arange(width), at]
                    better = value > best
                    best = np.where(better, value, best)
                    column[first:first + width][better], cut[first:first + width][better] = f, at[better]
                node = 2 * node + 1 + (bins[np.arange(len(rows)), column[node]] > cut[node])
            leaf = node - inner
            g, h = np.bincount(leaf, slope, inner + 1), np.bincount(leaf, bend, inner + 1)
            leaves.append(-step * g / (h + ridge))
            score[:, c] += leaves[-1][leaf]
            columns.append(column)
            cuts.append(cut)
    return Trees(edges, classes, depth, np.array(columns), np.array(cuts), np.array(leaves))
