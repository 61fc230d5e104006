"""Attributions of tree ensembles to their features: path-dependent Shapley values.

A tree is the sum of its leaves. What a leaf gives a row is its value times, for
each feature on its path, 1 or 0 (the row follows the path, or not) where the feature
is known, and the share of training rows that follow it where it isn't. Of such a
product the Shapley values have a closed form, by a polynomial in the number of known
features. Rows that follow a leaf's path in the same features share its values, so
work is done once for each such pattern of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


@dataclass
class Leaf:
    """value; features on the path (each once), the interval (low, high] that the path leaves to each, and the share of rows that stays in it."""

    value: float
    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray


def _walk(node, path: dict[int, tuple[float, float, float]], weight: float, out: list[Leaf]) -> None:
    if node.getClass().getSimpleName() == "LeafNode":
        features = sorted(path)
        columns = np.array([path[f] for f in features], float).reshape(-1, 3)
        out.append(Leaf(weight * node.prediction(), np.array(features, int), columns[:, 0], columns[:, 1], columns[:, 2]))
        return
    split, total = node.split(), node.impurityStats().count()
    f, cut = split.featureIndex(), split.threshold()
    low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
    for child, part in ((node.leftChild(), (low, min(high, cut))), (node.rightChild(), (max(low, cut), high))):
        _walk(child, path | {f: (*part, share * child.impurityStats().count() / total)}, weight, out)


def leaves_of(model) -> list[Leaf]:
    """The leaves of a fitted MLlib ensemble or tree of continuous features, with their values as they add up to its raw margin."""
    trees = getattr(model, "trees", None) or [model]
    weights = list(getattr(model, "treeWeights", [1.0] * len(trees)))
    out: list[Leaf] = []
    for tree, weight in zip(trees, weights, strict=True):
        _walk(tree._java_obj.rootNode(), {}, float(weight), out)
    return out


def base_value(leaves: list[Leaf]) -> float:
    """The mean margin over the training rows."""
    return float(sum(x.value * x.share.prod() for x in leaves))


def _values(met: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Shapley values (pattern, feature) of the product game of one leaf of value 1. met: patterns by feature, 1 or 0."""
    n, m = met.shape
    weights = np.array([factorial(k) * factorial(m - 1 - k) / factorial(m) for k in range(m)])
    out = np.empty((n, m))
    for f in range(m):
        # Coefficients, by number of known features, of the product over the others.
        c = np.zeros((n, m))
        c[:, 0] = 1.0
        for g in range(m):
            if g != f:
                c[:, 1:] = c[:, 1:] * share[g] + c[:, :-1] * met[:, g : g + 1]
                c[:, 0] *= share[g]
        out[:, f] = (met[:, f] - share[f]) * (c @ weights)
    return out


def attribute(leaves: list[Leaf], x: np.ndarray) -> np.ndarray:
    """Attributions (row, feature); a row's sum up to its margin less the base value."""
    out = np.zeros(x.shape)
    for leaf in leaves:
        if not len(leaf.features):
            continue
        at = x[:, leaf.features]
        met = (at > leaf.low) & (at <= leaf.high)
        codes = met @ (1 << np.arange(met.shape[1]))
        _, first, back = np.unique(codes, return_index=True, return_inverse=True)
        values = _values(met[first].astype(float), leaf.share) * leaf.value
        for i, f in enumerate(leaf.features):
            out[:, f] += values[back, i]
    return out


def margin_of(leaves: list[Leaf], x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    for leaf in leaves:
        at = x[:, leaf.features]
        out += leaf.value * ((at > leaf.low) & (at <= leaf.high)).all(axis=1)
    return out


def tree_attributions(df: DataFrame, columns: list[str], model, *, features: str = "features", top: int = 15) -> DataFrame:
    """df with base_value, margin and top_features: the features (name, value) that move a row's margin most, in order.

    features is the vector column the model was fitted on, in order of columns.
    """
    leaves = leaves_of(model)

    @pandas_udf("array<double>")
    def values(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            x = np.array(batch.tolist(), float).reshape(len(batch), len(columns))
            yield pd.Series(list(np.column_stack([attribute(leaves, x), margin_of(leaves, x)])))

    found = df.withColumn("_a", values(vector_to_array(features)))
    named = F.zip_with(F.slice("_a", 1, len(columns)), F.array(*[F.lit(c) for c in columns]), lambda v, c: F.struct((-F.abs(v)).alias("order"), c.alias("feature"), v.alias("value")))
    ranked = F.transform(F.slice(F.array_sort(named), 1, top), lambda x: F.struct(x["feature"].alias("feature"), x["value"].alias("value")))
    return found.select(*df.columns, F.lit(base_value(leaves)).alias("base_value"), F.element_at("_a", -1).alias("margin"), ranked.alias("top_features"))
