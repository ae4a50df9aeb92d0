"""Row scores: min-max signals, dual score, threshold, fusion, requests and responses."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowguard.config import DualConfig
from flowguard.functions.columns import as_column
from flowguard.operators.quantiles import EXACT_ROWS, exact_quantiles

# Request size limit, decision cut, label texts.
MAX_BATCH_ITEMS = 1024
DECISION_THRESHOLD = 0.5
ATTACK_TEXT, BENIGN_TEXT = "attack", "benign"
MISSING_SHOWN = 5


@dataclass(frozen=True)
class SignalRange:
    """Smallest and largest value of the two signals over the rows that define a normalisation."""

    clf: tuple[float, float]
    rec: tuple[float, float]


def signal_range(df: DataFrame, clf: str, rec: str) -> SignalRange:
    row = df.agg(F.min(clf), F.max(clf), F.min(rec), F.max(rec)).first()
    if row[0] is None or row[2] is None:
        return SignalRange((0.0, 0.0), (0.0, 0.0))
    return SignalRange((float(row[0]), float(row[1])), (float(row[2]), float(row[3])))


def normalized(value: Column | str, low: float, high: float, clamp: bool = False) -> Column:
    """Min-max scaled value; 0 for a constant range. ``clamp`` keeps unseen rows inside [0, 1]. Null stays null."""
    known = as_column(value).isNotNull()
    if high <= low:
        return F.when(known, F.lit(0.0))
    scaled = (as_column(value) - F.lit(low)) / F.lit(high - low)
    return F.when(known, F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0))) if clamp else scaled


def dual_score(
    clf: Column | str, rec: Column | str, signals: SignalRange, cfg: DualConfig = DualConfig(), clamp: bool = False
) -> Column:
    mixed = F.lit(cfg.alpha) * normalized(clf, *signals.clf, clamp) + F.lit(cfg.beta) * normalized(
        rec, *signals.rec, clamp
    )
    return mixed / F.lit(cfg.alpha + cfg.beta)


def with_dual_score(
    df: DataFrame,
    clf: str,
    rec: str,
    mode: str = "batch",
    fitted: SignalRange | None = None,
    cfg: DualConfig = DualConfig(),
) -> DataFrame:
    """Adds ``dual_score``.

    ``batch`` normalises over the rows being scored, ``row`` treats each row as a batch of one (always 0),
    ``fitted`` uses a stored range and is the only one with a meaning on a stream.
    """
    if mode == "row":
        return df.withColumn("dual_score", F.lit(0.0))
    if mode == "fitted":
        if fitted is None:
            raise ValueError("fitted normalisation needs a stored signal range")
        return df.withColumn("dual_score", dual_score(clf, rec, fitted, cfg, clamp=True))
    if mode == "batch":
        return df.withColumn("dual_score", dual_score(clf, rec, signal_range(df, clf, rec), cfg))
    raise ValueError(f"unknown normalisation: {mode}")


def fit_threshold(
    reference: DataFrame, clf: str, rec: str, cfg: DualConfig = DualConfig(), exact_rows: int = EXACT_ROWS
) -> float:
    """Quantile of the dual score over the reference rows, normalised within those rows."""
    scored = with_dual_score(reference, clf, rec, "batch", cfg=cfg).select("dual_score")
    found = exact_quantiles(scored, ["dual_score"], [cfg.threshold_quantile], exact_rows)["dual_score"]
    if not found:
        raise ValueError("no reference rows to fit the threshold on")
    return found[0]


def anomaly_flag(score: Column | str, threshold: float | None) -> Column:
    if threshold is None:
        raise RuntimeError("the dual-score threshold is not fitted")
    return (as_column(score) >= F.lit(threshold)).cast("int")


def fusion_probability(signals: Sequence[Column | str], weights: Sequence[float], intercept: float) -> Column:
    linear = F.lit(float(intercept))
    for s, w in zip(signals, weights, strict=True):
        linear = linear + as_column(s) * F.lit(float(w))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-linear))


def prediction_columns(clf: str, rec: str, probability: str, threshold: float = DECISION_THRESHOLD) -> dict[str, Column]:
    attack = F.col(probability) >= F.lit(threshold)
    return {
        "prediction": attack.cast("int"),
        "predicted_label": F.when(attack, ATTACK_TEXT).otherwise(BENIGN_TEXT),
        "confidence": F.col(probability),
        "anomaly_score": F.col("dual_score"),
        "details": F.create_map(
            F.lit("baseline_attack_score"), F.col(clf),
            F.lit("reconstruction_error"), F.col(rec),
            F.lit("dual_score"), F.col("dual_score"),
            F.lit("fusion_probability"), F.col(probability),
        ),
    }


def fuse(
    df: DataFrame,
    weights: Sequence[float],
    intercept: float,
    clf: str = "clf_score",
    rec: str = "rec_error",
    threshold: float = DECISION_THRESHOLD,
) -> DataFrame:
    """Adds fusion_probability, prediction, predicted_label, confidence, anomaly_score and details."""
    scored = df.withColumn("fusion_probability", fusion_probability([clf, rec, "dual_score"], weights, intercept))
    return scored.withColumns(prediction_columns(clf, rec, "fusion_probability", threshold))


def score_summary(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Items, attacks, benign and mean confidence; 0 for an empty batch."""
    return predictions.groupBy(*by).agg(
        F.count("*").alias("total_items"),
        F.count_if(F.col("prediction") == 1).alias("attack_count"),
        F.count_if(F.col("prediction") != 1).alias("benign_count"),
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean_confidence"),
    )


def explode_requests(requests: DataFrame, body: str = "body", limit: int = MAX_BATCH_ITEMS) -> DataFrame:
    """JSON arrays of feature maps to one row per item; a batch outside 1..limit fails the job."""
    items = F.from_json(body, "array<map<string,double>>")
    size = F.coalesce(F.size("items"), F.lit(0))
    checked = F.when((size >= 1) & (size <= limit), F.col("items")).otherwise(
        F.raise_error(F.concat(F.lit("a batch must have 1 to "), F.lit(str(limit)), F.lit(" items")))
        .cast("array<map<string,double>>")
    )
    others = [c for c in requests.columns if c != body]
    parsed = requests.withColumn("items", items).withColumn("items", checked)
    return parsed.select(*others, F.posexplode("items").alias("item_no", "features"))


def missing_features(features: Column | str, names: Sequence[str]) -> Column:
    """The required features that a request does not carry."""
    wanted = F.array(*[F.lit(n) for n in names])
    return F.array_except(wanted, F.map_keys(as_column(features)))


def align_request(df: DataFrame, names: Sequence[str], features: str = "features", strict: bool = True) -> DataFrame:
    """One column per required feature, in order; extra features are ignored, missing ones are an error."""
    missing = missing_features(features, names)
    others = [c for c in df.columns if c != features]
    if strict:
        text = F.concat(F.lit("missing required features: "), F.array_join(F.slice(missing, 1, MISSING_SHOWN), ", "))
        safe = F.when(F.size(missing) == 0, F.col(features)).otherwise(
            F.raise_error(text).cast("map<string,double>")
        )
        return df.withColumn(features, safe).select(*others, *[F.try_element_at(features, F.lit(n)).alias(n) for n in names])
    return df.select(
        *others, *[F.try_element_at(features, F.lit(n)).alias(n) for n in names], missing.alias("missing")
    )


def score_responses(predictions: DataFrame, request: str, version: str) -> DataFrame:
    """One response per request: its items in order (a request has at most the batch limit), version, size."""
    item = F.struct("item_no", "prediction", "predicted_label", "confidence", "anomaly_score")
    return predictions.groupBy(request).agg(
        F.sort_array(F.collect_list(item)).alias("items"),
        F.lit(version).alias("model_version"),
        F.count("*").alias("batch_size"),
    )
