"""Trees of fitted forests and boosted ensembles as arrays, to score many smaller ensembles in one pass.

The first trees of a forest are a smaller forest, and a tree cut at a depth is a shallower one (its inner nodes know the shares of classes
that reached them). So one large, deep forest is scored at all wanted sizes at once; and a boosted ensemble after every round.
A model's nodes are read from what ``pyspark.ml`` saves; they go to tasks as the model itself would.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Model
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelaudit.sources.shared import new_dir


class Tree(NamedTuple):
    """Nodes in order of their number: left child (-1 at a leaf), right child, feature, threshold, and a row of values."""

    left: np.ndarray
    right: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    values: np.ndarray


def read_trees(spark: SparkSession, model: Model, shares: bool) -> list[Tree]:
    """A model's trees. Values are shares of classes (``shares``), or one prediction."""
    path = new_dir(spark, "trees")
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    nodes = nodes.select("treeID", "id", "leftChild", "rightChild", F.col("split.featureIndex").alias("feature"), F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"), "prediction", "impurityStats")
    table = nodes.orderBy("treeID", "id").toArrow()  # a model's nodes: the driver has them already
    column = lambda name, missing: pc.fill_null(table[name].combine_chunks(), missing).to_numpy(zero_copy_only=False)
    left, right, feature, threshold = column("leftChild", -1), column("rightChild", -1), column("feature", -1), column("threshold", 0.0)
    if shares:
        values = table["impurityStats"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        values = values / np.maximum(values.sum(axis=1, keepdims=True), 1e-300)
    else:
        values = column("prediction", 0.0)[:, None]
    tree = column("treeID", 0)
    cuts = np.append(np.flatnonzero(np.append(True, tree[1:] != tree[:-1])), len(tree))
    return [Tree(left[i:j], right[i:j], feature[i:j], threshold[i:j], values[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


def descend(tree: Tree, x: np.ndarray, depths: Sequence[int]) -> list[np.ndarray]:
    """The values each row of ``x`` meets at most so many steps from the root."""
    at, rows, out = np.zeros(len(x), int), np.arange(len(x)), {}
    for depth in range(max(depths) + 1):
        if depth in depths:
            out[depth] = tree.values[at]
        inner = tree.left[at] >= 0
        if not inner.any():
            break
        goes = np.where(x[rows, np.maximum(tree.feature[at], 0)] <= tree.threshold[at], tree.left[at], tree.right[at])
        at = np.where(inner, goes, at)
    return [out.get(d, tree.values[at]) for d in depths]


def forest_cells(spark: SparkSession, model: Model, rows: DataFrame, sizes: Sequence[int], depths: Sequence[int]) -> DataFrame:
    """(trees, depth, y_true, y_pred, n): counts of predictions of every forest made of the first trees, cut at a depth; one pass
    over ``rows`` (features, y_true). What leaves a task is counts."""
    forest = spark.sparkContext.broadcast(read_trees(spark, model, True))
    sizes, depths = sorted(sizes), sorted(depths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = np.stack(batch["features"].to_numpy(zero_copy_only=False)), batch["y_true"].to_numpy()
            votes = [0.0] * len(depths)
            for n, tree in enumerate(forest.value, 1):
                votes = [v + w for v, w in zip(votes, descend(tree, x, depths), strict=True)]
                if n in sizes:
                    for depth, v in zip(depths, votes, strict=True):
                        pairs, found = np.unique(np.stack([y, v.argmax(axis=1)]), axis=1, return_counts=True)
                        for t, p, c in zip(*pairs.tolist(), found.tolist(), strict=True):
                            counts[n, depth, t, p] = counts.get((n, depth, t, p), 0) + c
        if counts:
            columns = list(zip(*[(*k, c) for k, c in counts.items()], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["trees", "depth", "y_true", "y_pred", "n"])

    parts = rows.select("features", "y_true").mapInArrow(run, "trees long, depth long, y_true long, y_pred long, n long")
    return parts.groupBy("trees", "depth", "y_true", "y_pred").agg(F.sum("n").alias("n"))


def boosting_rounds(spark: SparkSession, model: Model, rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, round, label, loss, error): after each round of one-vs-rest boosted trees, each member's mean log loss, its share of wrong
    sides, and (label null) the mean loss over members with the share of rows whose largest margin is another class's. One pass."""
    members = spark.sparkContext.broadcast([(read_trees(spark, m, False), list(m.treeWeights)) for m in model.models])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = np.stack(batch["features"].to_numpy(zero_copy_only=False)), batch["y_true"].to_numpy()
            steps = [np.cumsum([w * descend(t, x, [64])[0][:, 0] for t, w in zip(trees, weights, strict=True)], axis=0) for trees, weights in members.value]
            rounds = max(len(s) for s in steps)
            # a member that stopped early stays as it is
            margin = np.stack([np.concatenate([s, np.repeat(s[-1:], rounds - len(s), axis=0)]) for s in steps], axis=2)
            sign = np.where(y[:, None] == np.arange(len(steps))[None, :], 1.0, -1.0)
            loss, wrong = 2 * np.logaddexp(0, -2 * sign * margin), (sign > 0) != (margin > 0)
            missed = margin.argmax(axis=2) != y
            keys = list(zip(*[batch[c].to_pylist() for c in by], strict=True)) if by else [()] * len(y)
            for key in set(keys):
                here = np.array([k == key for k in keys])
                total = np.concatenate([loss[:, here].sum(axis=1), wrong[:, here].sum(axis=1), missed[:, here].sum(axis=1)[:, None], np.full((rounds, 1), here.sum())], axis=1)
                sums[key] = sums.get(key, 0) + total
        if sums:
            k = len(members.value)
            flat = [(*key, r + 1, label, float(t[r, label]), float(t[r, k + label]), float(t[r, 2 * k]), int(t[r, 2 * k + 1])) for key, t in sums.items() for r in range(len(t)) for label in range(k)]
            columns = list(zip(*flat, strict=True))
            kinds = [*[batch.schema.field(c).type for c in by], pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [*by, "round", "label", "loss", "wrong", "missed", "n"])

    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in by)
    parts = rows.select(*by, "features", "y_true").mapInArrow(run, f"{kinds}round int, label int, loss double, wrong double, missed double, n long")
    each = parts.groupBy(*by, "round", "label").agg((F.sum("loss") / F.sum("n")).alias("loss"), (F.sum("wrong") / F.sum("n")).alias("error"), (F.sum("missed") / F.sum("n")).alias("missed"))
    whole = each.groupBy(*by, "round").agg(F.lit(None).cast("int").alias("label"), F.avg("loss").alias("loss"), F.first("missed").alias("error"))
    return each.drop("missed").unionByName(whole)
