"""Shapley values of tree models, exactly and for every row.

A tree is a table of leaves: a leaf has an interval for every feature on its
path and the share of training rows that stay on the path when the feature is
unknown. A row's Shapley value adds up, leaf by leaf, the subsets of the path's
features that are known, weighted by their size; products over features make
that a polynomial instead of a sum over subsets. The leaves are broadcast (a
model's size, not the table's), and rows are explained in Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows explained at a time.
ROWS = 1 << 16
#: Combinations of intervals whose values a task keeps.
KNOWN = 1 << 17


@dataclass(frozen=True)
class Leaf:
    """``value`` times the tree's weight; of every feature on the path the number, the interval (low, high] and the share."""

    value: float
    features: tuple[int, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]
    share: tuple[float, ...]


def _leaves(node, value, path: dict[int, tuple[float, float, float]], found: list[Leaf]) -> None:
    if node.numDescendants() == 0:
        keys = tuple(path)
        found.append(Leaf(value(node), keys, *(tuple(path[k][i] for k in keys) for i in range(3))))
        return
    split = node.split()
    if not hasattr(split, "threshold") or "Continuous" not in split.getClass().getSimpleName():
        raise ValueError("only splits of numbers can be explained")
    f, at = split.featureIndex(), split.threshold()
    low, high, share = path.get(f, (-math.inf, math.inf, 1.0))
    rows = node.impurityStats().rawCount()
    for child, interval in ((node.leftChild(), (low, min(high, at))), (node.rightChild(), (max(low, at), high))):
        _leaves(child, value, {**path, f: (*interval, share * child.impurityStats().rawCount() / rows)}, found)


def leaves_of(model, label: int = 1) -> list[Leaf]:
    """The leaves of a fitted decision tree, random forest or gradient-boosted model.

    What is explained: the prediction of a regression, the probability of class ``label`` of a tree or forest that
    classifies, the margin of a boosted classifier.
    """
    trees = list(getattr(model, "trees", [model]))
    kind = type(model).__name__
    boosted = kind.startswith("GBT")
    weights = list(model.treeWeights) if boosted else [1 / len(trees)] * len(trees)

    def value(weight: float):
        def of(node) -> float:
            if boosted or "Regression" in kind:
                return weight * node.prediction()
            stats = list(node.impurityStats().stats())
            return weight * stats[label] / sum(stats)

        return of

    found: list[Leaf] = []
    for tree, weight in zip(trees, weights, strict=True):
        _leaves(tree._java_obj.rootNode(), value(weight), {}, found)
    return found


def base_value(leaves: list[Leaf]) -> float:
    """The mean over training rows, what a row is worth when no feature is known."""
    return sum(leaf.value * math.prod(leaf.share) for leaf in leaves)


def shapley(x: np.ndarray, leaves: list[Leaf]) -> np.ndarray:
    """Shapley values (rows x features) of a matrix of rows; NaN takes the right branch, as in the models."""
    out = np.zeros(x.shape)
    for leaf in leaves:
        d = len(leaf.features)
        if not d:
            continue
        own = x[:, leaf.features]
        on = (~(own <= np.array(leaf.low)) & ((own <= np.array(leaf.high)) | np.isinf(leaf.high))).astype(float)
        size = [math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d) for k in range(d)]
        for i in range(d):
            known = np.zeros((len(x), d))  # by number of known features among the others
            known[:, 0] = 1
            for j in range(d):
                if j != i:
                    more = known[:, :-1] * on[:, j : j + 1]
                    known *= leaf.share[j]
                    known[:, 1:] += more
            out[:, leaf.features[i]] += leaf.value * (on[:, i] - leaf.share[i]) * (known @ size)
    return out


class Explainer:
    """Shapley values by the intervals between a model's thresholds: rows with the same intervals are worked out once a task."""

    def __init__(self, leaves: list[Leaf], n_features: int):
        self.leaves = leaves
        found: list[set[float]] = [set() for _ in range(n_features)]
        for leaf in leaves:
            for f, low, high in zip(leaf.features, leaf.low, leaf.high, strict=True):
                found[f] |= {t for t in (low, high) if math.isfinite(t)}
        self.cuts = [np.array(sorted(t)) for t in found]
        self.plain = math.prod(len(t) + 1 for t in self.cuts) >= 1 << 62
        self.known, self.values = np.zeros(0, np.int64), np.zeros((0, n_features))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.plain:  # more combinations than a number tells apart
            return shapley(x, self.leaves)
        code = np.zeros(len(x), np.int64)
        for i, t in enumerate(self.cuts):  # NaN is sorted behind all thresholds: the right branch
            code = code * (len(t) + 1) + np.searchsorted(t, x[:, i])
        own, at = np.unique(code, return_inverse=True)
        new = np.setdiff1d(own, self.known, assume_unique=True)
        if len(new):
            if len(self.known) + len(new) > KNOWN:
                self.known, self.values, new = self.known[:0], self.values[:0], own
            sample, left = np.zeros((len(new), len(self.cuts))), new
            for i, t in reversed(list(enumerate(self.cuts))):
                left, place = np.divmod(left, len(t) + 1)
                sample[:, i] = np.append(t, math.inf)[place]
            known = np.concatenate([self.known, new])
            order = np.argsort(known)
            self.known, self.values = known[order], np.concatenate([self.values, shapley(sample, self.leaves)])[order]
        return self.values[np.searchsorted(self.known, own)][at]


def shap_values(df: DataFrame, id_col: str, features: list[str], model, label: int = 1, keep: list[str] | None = None) -> DataFrame:
    """(id, base, shap_<feature> ..., explained, keep ...): base and the features' values add up to ``explained``, what the model says.

    ``features`` in the order of the model's vector. A NULL counts as NaN. ``keep`` names columns that come along.
    """
    keep = keep or []
    leaves = leaves_of(model, label)
    base = base_value(leaves)
    held = df.sparkSession.sparkContext.broadcast(leaves)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        explain, last = Explainer(held.value, len(features)), 1 + len(features)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[1:last]], axis=1)
                values = explain(x)
                columns = [batch.column(0), pa.array(np.full(len(x), base)), *[pa.array(v) for v in values.T], pa.array(base + values.sum(1)), *batch.columns[last:]]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "base", *[f"shap_{f}" for f in features], "explained", *keep])

    rows = df.select(F.col(id_col).alias("id"), *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)], *keep)
    kept = "".join(f", `{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"id {rows.schema['id'].dataType.simpleString()}, base double, {', '.join(f'`shap_{f}` double' for f in features)}, explained double{kept}"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def shap_importance(values: DataFrame, features: list[str]) -> DataFrame:
    """(feature, importance, mean): the mean absolute and the mean Shapley value over all rows."""
    wide = values.agg(*[a.alias(f"{k}_{i}") for i, f in enumerate(features) for k, a in (("a", F.avg(F.abs(f"shap_{f}"))), ("m", F.avg(f"shap_{f}")))])
    rows = [F.struct(F.lit(f).alias("feature"), F.col(f"a_{i}").alias("importance"), F.col(f"m_{i}").alias("mean")) for i, f in enumerate(features)]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def shap_cohorts(values: DataFrame, cohort: str, features: list[str]) -> DataFrame:
    """(cohort, n, shap_<feature> ...): mean Shapley values of every group of a column of ``values``."""
    return values.groupBy(cohort).agg(F.count("*").alias("n"), *[F.avg(f"shap_{f}").alias(f"shap_{f}") for f in features])
