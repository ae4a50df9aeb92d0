"""Feature weights: normalise, align, apply."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowguard.functions.columns import quoted
from flowguard.operators.prep import require_columns
from flowguard.session import driver_rows

# Fixed value: smallest normalised weight.
WEIGHT_FLOOR = 0.05


def normalize_weights(raw: DataFrame) -> DataFrame:
    """(feature, weight) min-max scaled with a floor; equal weights all become 1.

    The table has one row per feature, so its range is a single small aggregate.
    """
    low, high = raw.agg(F.min("weight"), F.max("weight")).first()
    if low is None or low == high:
        return raw.select("feature", F.lit(1.0).alias("weight"))
    scaled = (F.col("weight") - F.lit(low)) / F.lit(high - low)
    return raw.select("feature", F.greatest(scaled, F.lit(WEIGHT_FLOOR)).alias("weight"))


def align_weights(features: Sequence[str], weights: DataFrame) -> DataFrame:
    """(ord, feature, weight) in feature order; an absent weight becomes the mean of the given ones."""
    mean = weights.agg(F.avg("weight")).first()[0]
    names = weights.sparkSession.createDataFrame(list(enumerate(features)), "ord int, feature string")
    return names.join(weights, "feature", "left").select(
        "ord", "feature", F.coalesce("weight", F.lit(1.0 if mean is None else mean)).alias("weight")
    )


def weight_map(weights: DataFrame) -> dict[str, float]:
    return {r.feature: float(r.weight) for r in driver_rows(weights.select("feature", "weight"), "feature weights")}


def apply_weights(df: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    require_columns(df, list(weights), "weighted")
    return df.withColumns({f: F.col(quoted(f)) * F.lit(float(w)) for f, w in weights.items()})


def top_features(weights: DataFrame, k: int = 10) -> DataFrame:
    return weights.orderBy(F.desc("weight"), "feature").limit(k)


def mean_magnitude(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, mean absolute value); missing counts as 0."""
    row = df.agg(*[F.avg(F.abs(F.coalesce(quoted(f), F.lit(0.0)))).alias(f) for f in features])
    return row.unpivot([], [quoted(f) for f in features], "feature", "weight")
