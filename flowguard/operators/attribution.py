"""Feature attribution of boosted trees: exact path-dependent Shapley values, over all rows or a bounded sample.

Each leaf is a product of per-feature conditions, so its Shapley values need only the features on its
path. The leaves are a small table (trees x leaves) that is broadcast; rows are scored where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowguard.config import SEED
from flowguard.functions.columns import quoted
from flowguard.operators.boosting import SoftmaxBooster
from flowguard.operators.models import BoostedClassifier
from flowguard.operators.ordering import exact_sample
from flowguard.session import driver_rows, scratch_path

# A leaf of one tree: its weighted value and, for the features on its path, their numbers, lower bounds
# (excluded), upper bounds (included) and cover shares. Plain tuples, because leaves are broadcast.
Leaf = tuple[float, tuple[int, ...], tuple[float, ...], tuple[float, ...], tuple[float, ...]]


def tree_leaves(spark: SparkSession, model: GBTClassificationModel) -> list[Leaf]:
    """Leaves of all trees, read from the model's own stored node table."""
    path = scratch_path(spark, "boosted-model")
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    table: dict[int, dict[int, object]] = {}
    for r in driver_rows(nodes, "tree nodes", limit=2_000_000):
        table.setdefault(r.treeID, {})[r.id] = r
    leaves: list[Leaf] = []
    for tree, weight in enumerate(model.treeWeights):
        found = table[tree]
        pending = [(0, {})]
        while pending:
            at, bounds = pending.pop()
            node = found[at]
            if node.leftChild < 0:
                order = sorted(bounds)
                lows, highs, shares = zip(*(bounds[f] for f in order)) if order else ((), (), ())
                leaves.append((weight * node.prediction, tuple(order), lows, highs, shares))
                continue
            feature, cut = node.split.featureIndex, node.split.leftCategoriesOrThreshold[0]
            low, high, share = bounds.get(feature, (-np.inf, np.inf, 1.0))
            for child, interval in ((node.leftChild, (low, min(high, cut))), (node.rightChild, (max(low, cut), high))):
                part = found[child].rawCount / node.rawCount
                pending.append((child, {**bounds, feature: (*interval, share * part)}))
    return leaves


def expected_value(leaves: Sequence[Leaf]) -> float:
    return sum(value * float(np.prod(share)) for value, _, _, _, share in leaves)


def shapley_values(x: np.ndarray, leaves: Sequence[Leaf], width: int) -> np.ndarray:
    """Shapley value per row and feature of the summed leaf values."""
    phi = np.zeros((len(x), width))
    for value, features, above, upto, share in leaves:
        d = len(features)
        if d == 0:
            continue
        cells = x[:, features]
        inside = ((cells > np.array(above)) & (cells <= np.array(upto))).astype(float)
        size_weight = [factorial(s) * factorial(d - s - 1) / factorial(d) for s in range(d)]
        for i, feature in enumerate(features):
            # Coefficient s sums, over the subsets of size s of the other features, the leaf's reach.
            reach = np.zeros((len(x), d))
            reach[:, 0] = 1.0
            for j in range(d):
                if j != i:
                    shifted = np.zeros_like(reach)
                    shifted[:, 1:] = reach[:, :-1] * inside[:, j : j + 1]
                    reach = reach * share[j] + shifted
            phi[:, feature] += value * (inside[:, i] - share[i]) * (reach @ size_weight)
    return phi


def shap_weights(
    classifier: BoostedClassifier | SoftmaxBooster, rows: DataFrame, key: str, sample_rows: int | None = None, seed: int = SEED
) -> DataFrame:
    """(feature, weight): mean absolute Shapley value over rows and class models.

    All rows count unless ``sample_rows`` bounds them.
    """
    spark = rows.sparkSession
    names = list(classifier.features)
    if isinstance(classifier, SoftmaxBooster):
        found = [classifier.leaves(c) for c in range(len(classifier.classes))]
    else:
        found = [tree_leaves(spark, m) for m in classifier.models]
    forests = spark.sparkContext.broadcast(found)
    narrow = rows.select(key, *map(quoted, names))
    chosen = narrow if sample_rows is None else exact_sample(narrow, key, sample_rows, seed)
    sample = chosen.select(*[F.coalesce(F.col(quoted(n)).cast("double"), F.lit(0.0)).alias(f"x{i}") for i, n in enumerate(names)])

    def attribute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = batch.to_numpy(float)
            total = sum(np.abs(shapley_values(x, leaves, len(names))).sum(axis=0) for leaves in forests.value)
            yield pd.DataFrame({"feature": names, "total": total, "n": len(x) * len(forests.value)})

    parts = sample.mapInPandas(attribute, "feature string, total double, n bigint")
    return parts.groupBy("feature").agg((F.sum("total") / F.sum("n")).alias("weight"))
