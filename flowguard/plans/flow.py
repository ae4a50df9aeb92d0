"""End-to-end flows: prepare, drift, train, leave-one-attack-out, promote."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowguard.config import METADATA, SOURCE, DriftConfig, PrepConfig, RetrainingPolicy, SplitConfig
from flowguard.functions.columns import quoted
from flowguard.operators import checks, drift, prep
from flowguard.operators.ordering import exact_sample
from flowguard.operators.splits import stratified_split
from flowguard.plans.views import TRAFFIC_FEATURES, view
from flowguard.session import materialize
from flowguard.sources import stores
from flowguard.sources.traffic_csv import device_filter


@dataclass(frozen=True)
class PreparedData:
    """Transformed rows with ``split`` and ``label_id``, and everything that was fitted on the train split."""

    table: DataFrame
    params: prep.PrepParams
    classes: tuple[str, ...]
    quality: DataFrame

    def split(self, name: str) -> DataFrame:
        return self.table.where(F.col("split") == name)

    def stats(self) -> DataFrame:
        return self.table.groupBy("split").agg(F.count("*").alias("rows"))


def prepare(
    labelled: DataFrame,
    key: str,
    device: str | None = None,
    max_total_rows: int | None = None,
    max_feature_columns: int = 0,
    split: SplitConfig = SplitConfig(),
    cfg: PrepConfig = PrepConfig(),
    metadata: Sequence[str] = METADATA,
) -> PreparedData:
    """Device filter, bounded sample, validation, feature cap, split, fit on train, transform all.

    All features stay unless ``max_feature_columns`` is positive.
    """
    rows = device_filter(labelled, SOURCE, device) if device else labelled
    if max_total_rows is not None:
        rows = exact_sample(rows, key, max_total_rows, split.seed)
    features = [c for c in prep.feature_columns(rows, metadata) if c != key]
    keyed = rows if key == "row_key" else rows.withColumnRenamed(key, "row_key")
    checks.require_valid(keyed, features, metadata)
    chosen = features[:max_feature_columns] if max_feature_columns > 0 else features
    narrow = keyed.select("row_key", *map(quoted, chosen), *map(quoted, metadata))
    # Fitting reads the parts four times: they are written once, by split, so that each pass reads only train columns.
    parts = materialize(stratified_split(narrow, metadata[0], "row_key", split), "splits", partition_by="split")
    train = parts.where(F.col("split") == "train")
    params = prep.fit_preprocessor(train, chosen, cfg)
    classes = prep.label_classes(train, metadata[0])
    table = prep.encode_labels(
        prep.transform(parts, params, keep=["row_key", *metadata, "split"]), classes, metadata[0]
    )
    return PreparedData(table, params, tuple(classes), checks.quality_summary(narrow.drop("row_key"), chosen, metadata))


def split_drift(spark: SparkSession, sf_dir: str, cfg: DriftConfig = DriftConfig()) -> DataFrame:
    """Drift of every feature between the training rows and all held-out rows, after preprocessing."""
    labelled = view(spark, sf_dir, "traffic").withColumnRenamed("source_path", SOURCE)
    data = prepare(labelled, key="row_key")
    held_out = data.table.where(F.col("split") != "train")
    return drift.feature_drift(data.split("train"), held_out, TRAFFIC_FEATURES, cfg)


def drift_job(
    reference: DataFrame,
    current: DataFrame,
    metric_pairs: DataFrame,
    features: Sequence[str] | None = None,
    cfg: DriftConfig = DriftConfig(),
    policy: RetrainingPolicy = RetrainingPolicy(),
    report_path: str | None = None,
) -> DataFrame:
    """Feature drift, concept drift, severity and the retraining decision, one row per metric pair."""
    results = drift.feature_drift(reference, current, features, cfg)
    decided = drift.retraining_decision(drift.drift_report(results, metric_pairs, cfg), policy)
    if report_path is not None:
        stores.write_report(decided, report_path)
    return decided
