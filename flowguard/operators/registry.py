"""Promotion: metric extraction, gates, content hashes, decisions. One row per candidate run."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowguard.config import PROMOTION_GATES, GateThresholds
from flowguard.functions.columns import as_column, fixed_text, quoted
from flowguard.sources import stores

# Names used in versions, decisions and manifests.
NAMESPACE = "hybrid"
CHAMPION = "fusion"
VERSION_DIGITS = 12
PROMOTED_FROM = "exp1_ae_vs_baseline + exp2_loao"
PASSED = "passed promotion gates"


def experiment_metrics(experiments: DataFrame) -> DataFrame:
    """Primary metrics of the baseline experiment, 0.0 where absent; the area falls back to one-vs-rest."""

    def value(*names: str) -> Column:
        return F.coalesce(*[F.col(n).cast("double") for n in names if n in experiments.columns], F.lit(0.0))

    return experiments.select(
        "run_name",
        value("baseline_f1_weighted").alias("baseline_f1_weighted"),
        value("hybrid_f1").alias("hybrid_f1"),
        value("fusion_f1").alias("fusion_f1"),
        value("fusion_auroc", "fusion_auroc_ovr_weighted").alias("fusion_auroc"),
    )


def loao_metrics(runs: DataFrame) -> DataFrame:
    """Mean and smallest F1, mean attack rate and run count per experiment."""
    f1, rate = F.coalesce("f1", F.lit(0.0)), F.coalesce("attack_rate_pred", F.lit(0.0))
    return runs.groupBy("run_name").agg(
        F.avg(f1).alias("loao_mean_f1"),
        F.min(f1).alias("loao_min_f1"),
        F.avg(rate).alias("loao_mean_attack_rate_pred"),
        F.count("*").cast("double").alias("loao_run_count"),
    )


def combined_metrics(experiments: DataFrame, runs: DataFrame) -> DataFrame:
    """An experiment without runs gets zeros and no attack rate."""
    joined = experiment_metrics(experiments).join(loao_metrics(runs), "run_name", "left")
    return joined.na.fill(0.0, ["loao_mean_f1", "loao_min_f1", "loao_run_count"])


def _gates(thresholds: GateThresholds) -> list[tuple[str, Column, float, Column]]:
    """(gate, observed value, minimum, failure text) in the order in which they are tried."""
    gap = F.col("fusion_f1") - F.col("baseline_f1_weighted")

    def below(name: str, minimum: float) -> Column:
        return F.format_string(f"{name} below threshold (%s < %s)", fixed_text(name, 4), fixed_text(F.lit(minimum), 4))

    no_gain = F.format_string(
        "fusion_f1 does not improve enough over baseline (%s - %s < %s)",
        fixed_text("fusion_f1", 4),
        fixed_text("baseline_f1_weighted", 4),
        fixed_text(F.lit(float(thresholds.min_fusion_over_baseline_gap)), 4),
    )
    minima = {
        "fusion_f1": thresholds.min_fusion_f1,
        "fusion_auroc": thresholds.min_fusion_auroc,
        "loao_mean_f1": thresholds.min_loao_mean_f1,
        "loao_min_f1": thresholds.min_loao_min_f1,
    }
    gates = [(n, F.col(n), float(m), below(n, float(m))) for n, m in minima.items()]
    return [*gates, ("baseline_gap", gap, float(thresholds.min_fusion_over_baseline_gap), no_gain)]


def promotion_gate(metrics: DataFrame, thresholds: GateThresholds = PROMOTION_GATES) -> DataFrame:
    """Adds approved and reason; the first gate that fails gives the reason."""
    reason = F.lit(PASSED)
    approved = F.lit(True)
    for _, observed, minimum, text in reversed(_gates(thresholds)):
        fails = observed < F.lit(minimum)
        reason = F.when(fails, text).otherwise(reason)
        approved = approved & ~fails
    return metrics.withColumns({"approved": approved, "reason": reason})


def gate_table(metrics: DataFrame, thresholds: GateThresholds = PROMOTION_GATES) -> DataFrame:
    """Every gate of every run: observed value, minimum, pass."""
    cells = [
        F.struct(
            F.lit(i).alias("gate_no"),
            F.lit(name).alias("gate"),
            observed.alias("observed"),
            F.lit(minimum).alias("minimum"),
            (observed >= F.lit(minimum)).alias("passed"),
        )
        for i, (name, observed, minimum, _) in enumerate(_gates(thresholds))
    ]
    return metrics.select("run_name", F.explode(F.array(*cells)).alias("g")).select("run_name", "g.*")


def content_hash(text: Column | str) -> Column:
    return F.sha2(as_column(text), 256)


def version_id(hashes: Sequence[Column | str], namespace: str = NAMESPACE) -> Column:
    digest = F.sha2(F.concat_ws("|", *[as_column(h) for h in hashes]), 256)
    return F.concat(F.lit(f"{namespace}-"), F.substring(digest, 1, VERSION_DIGITS))


def canonical_json(columns: Sequence[str]) -> Column:
    """Compact JSON with sorted keys."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def threshold_hash(thresholds: GateThresholds = PROMOTION_GATES) -> Column:
    return content_hash(F.lit(json.dumps(asdict(thresholds), sort_keys=True, separators=(",", ":"))))


def file_hashes(df_binary: DataFrame) -> DataFrame:
    """(path, hash) of a ``binaryFile`` scan."""
    return df_binary.select("path", F.sha2("content", 256).alias("hash"))


def promotion_decision(
    experiments: DataFrame,
    runs: DataFrame,
    thresholds: GateThresholds = PROMOTION_GATES,
    experiment_text: Column | str | None = None,
    runs_text: Column | str | None = None,
    namespace: str = NAMESPACE,
    reports: DataFrame | None = None,
    promoted_from: str = PROMOTED_FROM,
) -> DataFrame:
    """Metrics, gate outcome, champion and version of every run.

    The version hashes the two reports and the thresholds; by default the combined metrics stand for the reports.
    ``reports`` has a row for each ``run_name`` with the columns that the two texts refer to.
    """
    decided = promotion_gate(combined_metrics(experiments, runs), thresholds)
    names = decided.columns
    if reports is not None:
        decided = decided.join(reports, "run_name", "left")
    own = canonical_json(["run_name", "baseline_f1_weighted", "hybrid_f1", "fusion_f1", "fusion_auroc"])
    folds = canonical_json(["loao_mean_f1", "loao_min_f1", "loao_mean_attack_rate_pred", "loao_run_count"])
    first = own if experiment_text is None else as_column(experiment_text)
    second = folds if runs_text is None else as_column(runs_text)
    gates = threshold_hash(thresholds)
    data = F.struct(F.col("run_name").alias("exp1"), F.col("loao_run_count").cast("bigint").alias("exp2"))
    hashes = [content_hash(first), content_hash(second), gates]
    return decided.select(
        *names,
        F.when(F.col("approved"), F.lit(CHAMPION)).otherwise(F.lit("none")).alias("champion_source"),
        content_hash(F.concat_ws("|", first, second)).alias("experiment_hash"),
        content_hash(F.to_json(data, {"ignoreNullFields": "false"})).alias("data_hash"),
        gates.alias("config_hash"),
        version_id(hashes, namespace).alias("version"),
        F.lit(CHAMPION).alias("model_name"),
        F.lit(promoted_from).alias("promoted_from"),
    )


MANIFEST_METRICS = (
    "baseline_f1_weighted", "hybrid_f1", "fusion_f1", "fusion_auroc", "loao_mean_f1", "loao_min_f1",
    "loao_mean_attack_rate_pred", "loao_run_count",
)
VERSION_INFO = ("version", "model_name", "data_hash", "config_hash", "experiment_hash", "promoted_from")
MANIFEST_SCHEMA = (
    "run_name string, approved boolean, champion_source string, reason string, "
    f"version_info struct<{', '.join(f'{n}: string' for n in VERSION_INFO)}>, "
    f"metrics struct<{', '.join(f'{n}: double' for n in MANIFEST_METRICS)}>, promoted_at bigint"
)


def deployment_summary(decisions: DataFrame) -> DataFrame:
    return decisions.select(
        "run_name", "approved", "reason", "champion_source", "version", F.struct(*MANIFEST_METRICS).alias("metrics")
    )


def manifests(decisions: DataFrame, promoted_at: Column | str) -> DataFrame:
    """One promotion manifest for each decision, with the columns of ``MANIFEST_SCHEMA``."""
    return decisions.select(
        "run_name",
        "approved",
        "champion_source",
        "reason",
        F.struct(*VERSION_INFO).alias("version_info"),
        F.struct(*MANIFEST_METRICS).alias("metrics"),
        as_column(promoted_at).cast("bigint").alias("promoted_at"),
    )


def publish_manifests(decisions: DataFrame, folder: str, promoted_at: Column | str) -> str:
    """Adds the decisions' manifests to the folder as one batch, all or none; returns the batch's name."""
    return stores.publish(manifests(decisions, promoted_at), folder)


def stored_manifests(spark: SparkSession, folder: str, latest: bool = False) -> DataFrame:
    """Manifests of all batches or of the latest, version fields beside the nested ones; no rows where none was published."""
    return stores.read_published(spark, folder, MANIFEST_SCHEMA, latest).select("*", "version_info.*")


def evaluation_summary(experiments: DataFrame, runs: DataFrame) -> DataFrame:
    """Run name, fusion F1 and the fold list (one entry per held-out attack, sorted)."""
    folds = runs.groupBy("run_name").agg(
        F.count("*").alias("exp2_total_runs"), F.sort_array(F.collect_set("held_out_attack")).alias("exp2_attacks")
    )
    return experiments.join(folds, "run_name", "left").select(
        F.coalesce("run_name", F.lit("unknown")).alias("exp1_run_name"),
        F.coalesce("fusion_f1", F.lit(0.0)).alias("exp1_fusion_f1"),
        F.col("exp2_total_runs").isNotNull().alias("exp2_enabled"),
        F.coalesce("exp2_total_runs", F.lit(0)).alias("exp2_total_runs"),
        F.coalesce("exp2_attacks", F.array().cast("array<string>")).alias("exp2_attacks"),
    )


def run_report(evaluations: DataFrame, decisions: DataFrame, deploy: bool = True) -> DataFrame:
    """One report row per run: fusion F1, evaluation block and deployment block or 'skipped'."""
    if deploy:
        block = decisions.select(
            F.col("run_name").alias("exp1_run_name"),
            F.struct("approved", "reason", "champion_source", "version", F.lit(False).alias("skipped")).alias("deployment"),
        )
        joined = evaluations.join(block, "exp1_run_name", "left")
    else:
        joined = evaluations.withColumn(
            "deployment",
            F.struct(
                F.lit(False).alias("approved"),
                F.lit("deployment skipped by profile").alias("reason"),
                F.lit("none").alias("champion_source"),
                F.lit("skipped").alias("version"),
                F.lit(True).alias("skipped"),
            ),
        )
    return joined.select(
        F.col("exp1_run_name").alias("run_name"),
        F.struct(F.col("exp1_fusion_f1").alias("fusion_f1"), F.lit(CHAMPION).alias("model")).alias("training"),
        F.struct("exp1_run_name", "exp1_fusion_f1", "exp2_enabled", "exp2_total_runs", "exp2_attacks").alias("evaluation"),
        "deployment",
    )


def table_fingerprint(df: DataFrame) -> DataFrame:
    """A hash of schema, row count and content that ignores row order and partitioning.

    Content is a sum of row hashes, so a map-side partial sum is all that is shuffled.
    """
    names = "|".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields)
    texts = [F.col(quoted(c)).cast("string") for c in df.columns]
    # Cells carry their length, and a null has none: neither a separator nor a text can pass for another cell.
    cells = [F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    row_hash = F.conv(F.substring(F.md5(F.concat_ws("|", *cells)), 1, 15), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count("*").alias("rows"), F.sum(row_hash).cast("string").alias("content")).select(
        "rows",
        "content",
        F.md5(F.concat_ws("|", F.lit(names), F.col("rows").cast("string"), F.col("content"))).alias(
            "fingerprint"
        ),
    )


def champion_model(manifests: DataFrame, approved_only: bool = False) -> DataFrame:
    """The manifest promoted last; without one, an unversioned model of unknown origin."""
    rows = manifests.where(F.col("approved")) if approved_only else manifests
    # max_by keeps one row per map task, so no manifest is sorted or collected.
    newest = rows.agg(
        F.max_by(F.struct("version", "champion_source"), F.struct("promoted_at", "version")).alias("m")
    )
    return newest.select(
        F.coalesce("m.version", F.lit("unversioned")).alias("model_version"),
        F.coalesce("m.champion_source", F.lit("unknown")).alias("champion_source"),
    )
