"""Scoring by many forests in one pass over the rows.

The trees of all forests become arrays: for every node the feature it asks for,
the threshold, its left child (the right one comes next) and, for a leaf, the
share of class 1. A batch of rows walks all trees level by level.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlift.operators.numbering import use_checkpoint_folder

# Nodes that are sent to every task: about 28 bytes each.
MOST_NODES = 10_000_000
# Rows times trees that a task walks at a time.
WALKED_TOGETHER = 2_000_000


@dataclass
class Trees:
    """Trees of several forests, the shallow ones first."""
    feature: np.ndarray         # leaves ask for a feature that is always 0
    threshold: np.ndarray       # and stay where they are
    left: np.ndarray
    share: np.ndarray
    roots: np.ndarray
    depths: np.ndarray
    member: np.ndarray          # forest of each tree
    members: int

    def of(self, member: int) -> Trees:
        own = self.member == member
        return Trees(self.feature, self.threshold, self.left, self.share, self.roots[own], self.depths[own],
                     np.zeros(own.sum(), np.int32), 1)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Mean share of class 1 per row and forest."""
        of_member = np.zeros((len(self.roots), self.members))
        of_member[np.arange(len(self.roots)), self.member] = 1
        of_member /= of_member.sum(axis=0)
        padded = np.hstack([rows, np.zeros((len(rows), 1))])
        step = max(1, WALKED_TOGETHER // max(1, len(self.roots)))
        found = [self._walk(padded[at:at + step]) @ of_member for at in range(0, len(rows), step)]
        return np.vstack(found) if found else np.zeros((0, self.members))

    def _walk(self, rows: np.ndarray) -> np.ndarray:
        width, flat = rows.shape[1], np.ascontiguousarray(rows).ravel()
        starts = (np.arange(len(rows)) * width)[:, None]
        node = np.broadcast_to(self.roots, (len(rows), len(self.roots))).copy()
        for level in range(int(self.depths.max(initial=0))):
            first = np.searchsorted(self.depths, level, side="right")    # trees as deep as this
            at = node[:, first:]
            value = flat.take(starts + self.feature.take(at))
            node[:, first:] = self.left.take(at) + ~(value <= self.threshold.take(at))
        return self.share.take(node)


def _flattened(nodes: pd.DataFrame, width: int, members: int) -> Trees:
    """``nodes``: member, tree, id, left, right, feature, threshold, share; a leaf's left is -1."""
    nodes = nodes.sort_values(["member", "tree", "id"]).reset_index(drop=True)
    tree = nodes.groupby(["member", "tree"], sort=True).ngroup().to_numpy()
    first = np.searchsorted(tree, np.arange(tree.max() + 1))
    row_of = first[tree] + nodes["id"].to_numpy()        # ids of a tree count from 0
    assert np.array_equal(row_of, np.arange(len(nodes)))
    leaf = nodes["left"].to_numpy() < 0
    left = np.where(leaf, row_of, first[tree] + nodes["left"].to_numpy())
    right = np.where(leaf, row_of, first[tree] + nodes["right"].to_numpy())

    # Level by level, brothers side by side.
    depth, order, depths = np.full(len(nodes), -1), [], []
    level, step = first, 0
    depth[level] = 0
    order.append(level)
    deepest = np.zeros(len(first), np.int64)
    while len(level):
        inner = level[~leaf[level]]
        level = np.column_stack([left[inner], right[inner]]).ravel()
        step += 1
        depth[level] = step
        deepest[tree[level]] = step
        order.append(level)
    order = np.concatenate(order)
    place = np.empty(len(nodes), np.int64)
    place[order] = np.arange(len(nodes))
    feature, threshold = nodes["feature"].to_numpy(), nodes["threshold"].to_numpy(float)
    by_depth = np.argsort(deepest, kind="stable")
    return Trees(
        feature=np.where(leaf, width, feature)[order].astype(np.int32),
        threshold=np.where(leaf, np.inf, threshold)[order],
        left=np.where(leaf, place, place[left])[order],
        share=nodes["share"].to_numpy(float)[order],
        roots=place[first][by_depth], depths=deepest[by_depth],
        member=nodes["member"].to_numpy()[first][by_depth].astype(np.int32), members=members)


def flat_trees(spark: SparkSession, models: list[RandomForestClassificationModel]) -> Trees | None:
    """The trees of two-class forests over the same numeric features.

    None if they have too many nodes to send to every task, or ask for a
    category; then the models themselves must score.
    """
    if not models or sum(m.totalNumNodes for m in models) > MOST_NODES:
        return None
    use_checkpoint_folder(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/forests-{uuid.uuid4().hex}"

    @inheritable_thread_target(spark)
    def read(member: int) -> pd.DataFrame:
        models[member].write().save(f"{folder}/{member}")
        stats = F.col("nodeData.impurityStats")
        return spark.read.parquet(f"{folder}/{member}/data").select(
            F.lit(member).alias("member"), F.col("treeID").alias("tree"), F.col("nodeData.id").alias("id"),
            F.col("nodeData.leftChild").alias("left"), F.col("nodeData.rightChild").alias("right"),
            F.col("nodeData.split.featureIndex").alias("feature"),
            F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
            F.col("nodeData.split.numCategories").alias("categories"),
            (stats[1] / F.aggregate(stats, F.lit(0.0), lambda total, n: total + n)).alias("share")).toPandas()

    with ThreadPool(min(8, len(models))) as pool:
        nodes = pd.concat(pool.map(read, range(len(models))), ignore_index=True)
    inner = nodes["left"] >= 0
    if (nodes.loc[inner, "categories"] >= 0).any() or nodes["share"].isna().any():
        return None
    return _flattened(nodes, models[0].numFeatures, len(models))


def scored_by_all(df: DataFrame, features: Column, trees: Trees, name: str) -> DataFrame:
    """Add ``name``: an array with one raw score per forest. ``features`` is an array of doubles."""
    sent = df.sparkSession.sparkContext.broadcast(trees)     # MOST_NODES bounds its size

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series(list(sent.value.score(_matrix(rows))))

    return df.withColumn(name, score(features))


def scored_by_own(df: DataFrame, features: Column, member: str, trees: Trees, name: str) -> DataFrame:
    """Add ``name``: the raw score by the forest whose number stands in ``member``."""
    sent = df.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        parts = [sent.value.of(k) for k in range(sent.value.members)]
        for rows, own in batches:
            found, matrix, own = np.empty(len(rows)), _matrix(rows), own.to_numpy()
            for k in np.unique(own):
                found[own == k] = parts[k].score(matrix[own == k])[:, 0]
            yield pd.Series(found)

    return df.withColumn(name, score(features, F.col(member)))


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.vstack(rows.to_list()) if len(rows) else np.zeros((0, 1))
