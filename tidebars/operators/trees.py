"""Boosted trees as a table of nodes: scores, and what each input adds, from arrays of a row's values.

A table has one row per node: tree, weight, node, feature (-1 at leaves), threshold, left, right, value. A row goes left
where its value is at most the threshold. The long class has probability 1 / (1 + exp(-2 m)), where m adds up the
trees' values times their weights.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars.session import checkpoint_dir

NODES = "tree int, weight double, node int, feature int, threshold double, left int, right int, value double"
_CELLS = 4_000_000  # places of rows in trees that are held at once


def node_rows(model: GBTClassificationModel) -> DataFrame:
    """The nodes of a fitted model, through its stored form."""
    session = SparkSession.active()
    path = f"{checkpoint_dir(session)}/{uuid.uuid4().hex}"
    model.write().save(path)
    nodes, trees = session.read.parquet(f"{path}/data"), session.read.parquet(f"{path}/treesMetadata")
    n = F.col("nodeData")
    leaf = n["leftChild"] < 0
    return nodes.join(trees.select(F.col("_1").alias("treeID"), F.col("_3").alias("weight")), "treeID").select(
        F.col("treeID").alias("tree"), "weight", n["id"].alias("node"),
        F.when(leaf, -1).otherwise(n["split"]["featureIndex"]).alias("feature"),
        F.when(~leaf, F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0))).alias("threshold"),
        n["leftChild"].alias("left"), n["rightChild"].alias("right"), n["prediction"].alias("value"))


@dataclass
class TreeTable:
    """A table of nodes as arrays over all trees; leaves lead to themselves. As large as the model, however many rows it scores."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int

    @classmethod
    def of_rows(cls, nodes: DataFrame) -> TreeTable:
        """From rows of ``NODES``, each tree's root being its node 0."""
        rows = nodes.select(*[c.split()[0] for c in NODES.split(", ")]).toPandas().sort_values(["tree", "node"]).reset_index(drop=True)
        place = {key: i for i, key in enumerate(zip(rows["tree"], rows["node"], strict=True))}
        leaf = (rows["feature"] < 0).to_numpy()
        at = np.arange(len(rows))
        ways = [np.where(leaf, at, [i if stop else place[t, n] for i, t, n, stop in zip(at, rows["tree"], rows[way], leaf, strict=True)])
                for way in ("left", "right")]
        roots = np.flatnonzero(rows["node"] == 0)
        depth, here = 0, roots
        while len(here := here[~leaf[here]]):
            here, depth = np.concatenate([ways[0][here], ways[1][here]]), depth + 1
        return cls(np.where(leaf, 0, rows["feature"]), np.where(leaf, np.inf, rows["threshold"].astype(float)), *ways,
                   (rows["value"] * rows["weight"]).to_numpy(), roots, depth)

    @classmethod
    def of_model(cls, model: GBTClassificationModel) -> TreeTable:
        return cls.of_rows(node_rows(model))

    def values(self, x: np.ndarray, roots: np.ndarray | None = None) -> np.ndarray:
        """(rows, trees): the weighted value of the leaf that each row ends in."""
        roots = self.roots if roots is None else roots
        rows = np.arange(len(x))[:, None]
        at = np.broadcast_to(roots, (len(x), len(roots)))
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.value[at]

    def users(self, inputs: int) -> list[np.ndarray]:
        """For each input the numbers of the trees that ask for it."""
        tree = np.searchsorted(self.roots, np.arange(len(self.feature)), "right") - 1
        asks = np.isfinite(self.threshold)
        return [np.unique(tree[asks & (self.feature == i)]) for i in range(inputs)]

    def effects(self, x: np.ndarray, means: np.ndarray) -> np.ndarray:
        """(rows, inputs): how much the probability falls when an input is set to its mean.

        Only the trees that ask for an input are gone through again for it.
        """
        values = self.values(x)
        margin = values.sum(axis=1)
        out = np.zeros(x.shape)
        for i, trees in enumerate(self.users(x.shape[1])):
            if len(trees):
                changed = x.copy()
                changed[:, i] = means[i]
                moved = (self.values(changed, self.roots[trees]) - values[:, trees]).sum(axis=1)
                out[:, i] = _probability(margin) - _probability(margin + moved)
        return out

    def scores(self, rows: DataFrame, keys: Sequence[str], inputs: str, name: str = "prob_long") -> DataFrame:
        """``keys`` and the probability of the long class, from an array column; null values count as missing and go right."""
        table, kinds = self, ", ".join(f"`{k}` {dict(rows.dtypes)[k]}" for k in keys)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in _parts(batches, len(table.roots)):
                yield part[list(keys)].assign(**{name: _probability(table.values(_matrix(part["_x"])).sum(axis=1))})

        return rows.select(*keys, F.col(inputs).alias("_x")).mapInPandas(run, f"{kinds}, `{name}` double")

    def attributions(self, rows: DataFrame, keys: Sequence[str], inputs: str, names: Sequence[str], means: Sequence[float],
                     top: int = 5) -> DataFrame:
        """``keys`` and ``top_features``: the ``top`` inputs by size of their effect (ties in order of the inputs)."""
        table, kinds = self, ", ".join(f"`{k}` {dict(rows.dtypes)[k]}" for k in keys)
        centre = np.asarray(means, float)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in _parts(batches, len(table.roots)):
                effects = table.effects(_matrix(part["_x"]), centre)
                best = np.argsort(-np.abs(effects).round(12), axis=1, kind="stable")[:, :top]
                yield part[list(keys)].assign(names=[[names[i] for i in row] for row in best], effects=list(np.take_along_axis(effects, best, axis=1)))

        found = rows.select(*keys, F.col(inputs).alias("_x")).mapInPandas(run, f"{kinds}, names array<string>, effects array<double>")
        return found.select(*keys, F.map_from_arrays("names", "effects").alias("top_features"))


def _probability(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-2 * margin))


def _matrix(arrays: pd.Series) -> np.ndarray:
    return np.array(arrays.tolist(), dtype=float)


def _parts(batches: Iterator[pd.DataFrame], trees: int) -> Iterator[pd.DataFrame]:
    step = max(1, _CELLS // max(1, trees))
    for batch in batches:
        for at in range(0, len(batch), step):
            yield batch.iloc[at:at + step]
