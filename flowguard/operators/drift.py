"""Data drift (PSI and Kolmogorov-Smirnov for all features in one job), concept drift, decisions."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from flowguard.config import DriftConfig, RetrainingPolicy
from flowguard.functions.columns import (
    as_column,
    bin_sql,
    coerced_sql,
    double_array,
    finite_sql,
    quoted,
    unpivot_sql,
)
from flowguard.operators.prefix import ROWS_PER_BUCKET, bucket_offsets, value_splits, within_bucket
from flowguard.operators.quantiles import bucketed, exact_quantiles
from flowguard.session import driver_rows

# Features are dealt over at most this many tasks for their exact p-values.
KS_TASKS = 200
# Share used for an empty PSI bin, severity ranks and cuts.
EMPTY_BIN_SHARE = 0.0001
KS_EXACT_ROWS = DriftConfig.ks_exact_rows
KS_TERMS = 100
SEVERITY_RANK = {"low": 0, "medium": 1, "high": 2, "critical": 3}
UNKNOWN_SEVERITY_RANK = 0
UNKNOWN_MINIMUM_RANK = 2
CRITICAL_RATIO = 0.5
HIGH_RATIO = 0.25


def common_columns(reference: DataFrame, current: DataFrame, excluded: Sequence[str] = ()) -> list[str]:
    present = set(current.columns)
    return [c for c in reference.columns if c in present and c not in excluded]


def psi_edges(reference: DataFrame, features: Sequence[str], bins: int = 10) -> dict[str, list[float]]:
    """Distinct reference quantiles at 0, 1/bins, ..., 1 per feature; empty for a feature without values."""
    levels = [i / bins for i in range(bins + 1)]
    table = reference.selectExpr(*[f"{finite_sql(quoted(f))} AS {quoted(f)}" for f in features])
    return {f: sorted(set(q)) if q else [] for f, q in exact_quantiles(table, features, levels).items()}


def share_term(reference: Column, reference_total: Column, current: Column, current_total: Column) -> Column:
    """One bin of the index; a bin that is empty on both sides contributes nothing."""

    def share(n: Column, total: Column) -> Column:
        return F.when(n == 0, F.lit(EMPTY_BIN_SHARE)).otherwise(n.cast("double") / total)

    r, c = share(reference, reference_total), share(current, current_total)
    return (c - r) * F.log(c / r)


def _both_sides(reference: DataFrame, current: DataFrame, cells: Sequence[str]) -> DataFrame:
    return reference.selectExpr("0 AS side", *cells).unionByName(current.selectExpr("1 AS side", *cells))


def population_stability(
    reference: DataFrame,
    current: DataFrame,
    features: Sequence[str],
    edges: dict[str, list[float]],
) -> DataFrame:
    """(feature_id, psi). Values outside the reference range are dropped and not counted.

    Bins are computed in the scan and only (feature, bin) counts are shuffled.
    """
    values = [f"{finite_sql(quoted(f))} AS v{i}" for i, f in enumerate(features)]
    cells = ", ".join(f"{i}, {bin_sql(f'v{i}', edges[f])}, v{i} IS NOT NULL" for i, f in enumerate(features))
    long = _both_sides(reference, current, values).selectExpr(
        "side", f"stack({len(features)}, {cells}) AS (feature_id, bin, present)"
    )
    counts = long.groupBy("feature_id", "bin").agg(
        F.count_if((F.col("side") == 0) & F.col("bin").isNotNull()).alias("n_ref"),
        F.count_if((F.col("side") == 1) & F.col("bin").isNotNull()).alias("n_cur"),
        F.count_if((F.col("side") == 1) & F.col("present")).alias("present_cur"),
    )
    # At most bins + 1 rows per feature from here on.
    whole = Window.partitionBy("feature_id")
    total = {n: F.greatest(F.sum(c).over(whole), F.lit(1)).cast("double") for n, c in (("r", "n_ref"), ("c", "n_cur"))}
    terms = counts.withColumns(
        {
            "term": F.when(
                F.col("bin").isNotNull(),
                share_term(F.col("n_ref"), total["r"], F.col("n_cur"), total["c"]),
            ).otherwise(F.lit(0.0)),
            "both": (F.sum("present_cur").over(whole) > 0) & (F.sum("n_ref").over(whole) > 0),
        }
    )
    return terms.groupBy("feature_id").agg(
        F.when(F.bool_and("both"), F.sum("term")).otherwise(F.lit(0.0)).alias("psi")
    )


def ks_asymptotic_pvalue(statistic: Column, n_ref: Column, n_cur: Column) -> Column:
    """Two-sided asymptotic p-value: alternating series, clamped to [0, 1], 1 for a zero statistic, null for none."""
    n1, n2 = n_ref.cast("double"), n_cur.cast("double")
    lam2 = statistic * statistic * n1 * n2 / (n1 + n2)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(KS_TERMS)),
        F.lit(0.0),
        lambda acc, k: acc
        + F.when(k % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0))
        * F.exp(F.lit(-2.0) * k.cast("double") * k.cast("double") * lam2),
    )
    clamped = F.least(F.greatest(series * 2, F.lit(0.0)), F.lit(1.0))
    return F.when(statistic == 0, F.lit(1.0)).when(statistic.isNotNull(), clamped)


def exact_tail(statistic: float, n_ref: int, n_cur: int) -> float:
    """Probability that two samples of one distribution without ties are at least ``statistic`` apart.

    The merged order of both samples is a random lattice path from (0, 0) to (n_ref, n_cur). Its probability is carried from
    diagonal to diagonal within the band of smaller distances; what leaves the band is the tail, a sum of positive terms.
    """
    divisor = math.gcd(n_ref, n_cur)
    # All distances are multiples of 1 / lcm; here they are integers, multiplied by n_ref * n_cur.
    reach = round(statistic * (n_ref // divisor * n_cur)) * divisor
    if reach <= 0:
        return 1.0
    total, low, inside, tail = n_ref + n_cur, 0, np.ones(1), 0.0
    for k in range(total):
        i = np.arange(low, low + len(inside))
        grown = np.zeros(len(inside) + 1)
        grown[1:] = inside * ((n_ref - i) / (total - k))
        grown[:-1] += inside * ((n_cur - k + i) / (total - k))
        first = max(0, k + 1 - n_cur, ((k + 1) * n_ref - reach) // total + 1)
        last = min(n_ref, k + 1, -((-(k + 1) * n_ref - reach) // total) - 1)
        before, after = first - low, last + 1 - low
        tail += float(grown[:before].sum() + grown[after:].sum())
        low, inside = first, grown[before:after]
        if not len(inside):
            break
    return min(tail, 1.0)


@F.pandas_udf(DoubleType())
def _exact_pvalue(statistic: pd.Series, n_ref: pd.Series, n_cur: pd.Series, most: pd.Series) -> pd.Series:
    rows = zip(statistic, n_ref, n_cur, most)
    return pd.Series([exact_tail(d, int(a), int(b)) if d == d and 0 < max(a, b) <= n else None for d, a, b, n in rows], dtype="float64")


def ks_pvalue(statistic: Column, n_ref: Column, n_cur: Column, exact_rows: int = KS_EXACT_ROWS) -> Column:
    """Two-sided p-value: exact where neither side has more than ``exact_rows`` values, else asymptotic; null without a statistic."""
    series = ks_asymptotic_pvalue(statistic, n_ref, n_cur)
    exact = _exact_pvalue(statistic, n_ref, n_cur, F.lit(exact_rows))
    return F.when(F.greatest(n_ref, n_cur) <= exact_rows, exact).otherwise(series)


def kolmogorov_smirnov(
    reference: DataFrame,
    current: DataFrame,
    features: Sequence[str],
    rows_per_bucket: int = ROWS_PER_BUCKET,
    exact_rows: int = KS_EXACT_ROWS,
) -> DataFrame:
    """(feature_id, n_ref, n_cur, ks_statistic, ks_pvalue) over the non-null values of each side.

    The p-value is exact for features with at most ``exact_rows`` values on each side; these are dealt over the tasks. Beyond, it
    is the asymptotic series, and a table without such small features is never read by Python. Values are counted per (feature, value), then walked in value buckets; a bucket only reports its
    totals and the extremes of its local difference, which the offsets of earlier buckets shift.
    """
    both = _both_sides(reference, current, [f"{coerced_sql(quoted(f))} AS {quoted(f)}" for f in features])
    sizes = both.groupBy("side").agg(F.count("*").alias("rows"), *[F.expr(f"count({quoted(f)}) AS {quoted(f)}") for f in features]).collect()
    n = {(r.side, f): r[f] for r in sizes for f in features}
    n_ref, n_cur = [n.get((0, f), 0) for f in features], [n.get((1, f), 0) for f in features]
    splits = value_splits(both, features, rows_per_bucket, rows=sum(r.rows for r in sizes))
    counts = (
        both.selectExpr("side", unpivot_sql(features))
        .where("value IS NOT NULL")
        .groupBy("feature_id", "value")
        .agg(F.count_if(F.col("side") == 0).alias("ref"), F.count_if(F.col("side") == 1).alias("cur"))
    )
    at = F.col("feature_id") + 1
    ref_size = F.element_at(double_array([max(v, 1) for v in n_ref]), at)
    cur_size = F.element_at(double_array([max(v, 1) for v in n_cur]), at)
    window = within_bucket(["feature_id"], "value", inclusive=True)
    local = bucketed(counts, "value", splits, "bucket").withColumn(
        "gap", F.sum("ref").over(window) / ref_size - F.sum("cur").over(window) / cur_size
    )
    buckets = local.groupBy("feature_id", "bucket").agg(
        F.sum("ref").alias("ref"), F.sum("cur").alias("cur"), F.max("gap").alias("high"), F.min("gap").alias("low")
    )
    offsets = bucket_offsets(buckets, ["feature_id"], {"ref_before": "ref", "cur_before": "cur"})
    shift = F.col("ref_before") / ref_size - F.col("cur_before") / cur_size
    found = offsets.groupBy("feature_id").agg(
        F.max(F.greatest(F.abs(shift + F.col("high")), F.abs(shift + F.col("low")))).alias("distance"),
        F.sum("ref").alias("n_ref"),
        F.sum("cur").alias("n_cur"),
    )
    both_present = (F.col("n_ref") > 0) & (F.col("n_cur") > 0)
    measured = found.withColumn("ks_statistic", F.when(both_present, F.col("distance"))).drop("distance")
    sides = F.col("ks_statistic"), F.col("n_ref"), F.col("n_cur")
    if any(0 < max(r, c) <= exact_rows and r and c for r, c in zip(n_ref, n_cur)):
        spread = measured.repartition(min(len(features), KS_TASKS), "feature_id")
        return spread.withColumn("ks_pvalue", ks_pvalue(*sides, exact_rows))
    return measured.withColumn("ks_pvalue", ks_asymptotic_pvalue(*sides))


def feature_drift(
    reference: DataFrame,
    current: DataFrame,
    features: Sequence[str] | None = None,
    cfg: DriftConfig = DriftConfig(),
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """One row per common feature: psi, ks_statistic, ks_pvalue, drifted."""
    names = list(features) if features else common_columns(reference, current)
    names = [f for f in names if f in reference.columns and f in current.columns]
    if not names:
        raise ValueError("the two tables have no feature in common")
    if cfg.min_reference_rows and reference.count() < cfg.min_reference_rows:
        raise ValueError(f"the reference has fewer than {cfg.min_reference_rows} rows")
    edges = psi_edges(reference, names, cfg.bins)
    psi = population_stability(reference, current, names, edges)
    ks = kolmogorov_smirnov(reference, current, names, rows_per_bucket, cfg.ks_exact_rows)
    name = F.element_at(F.array(*[F.lit(f) for f in names]), F.col("feature_id") + 1)
    joined = psi.join(ks, "feature_id", "left")
    drifted = (F.col("psi") > cfg.psi_threshold) | F.coalesce(F.col("ks_pvalue") < cfg.ks_pvalue_threshold, F.lit(False))
    return joined.select(
        name.alias("feature"), "psi", "ks_statistic", "ks_pvalue", F.coalesce(drifted, F.lit(False)).alias("drifted")
    )


def drift_summary(results: DataFrame) -> DataFrame:
    """Drifted count and ratio, largest and mean psi; an empty table gives zeros and no mean."""
    drifted = F.coalesce(F.sum(F.col("drifted").cast("double")), F.lit(0.0))
    return results.agg(
        drifted.alias("drifted_feature_count"),
        F.coalesce(F.avg(F.col("drifted").cast("double")), F.lit(0.0)).alias("drifted_feature_ratio"),
        F.coalesce(F.max("psi"), F.lit(0.0)).alias("max_psi"),
        F.avg("psi").alias("mean_psi"),
    )


def concept_drift(pairs: DataFrame, cfg: DriftConfig = DriftConfig()) -> DataFrame:
    """Adds f1_drop, auroc_drop, confidence_shift and concept_severity.

    Metric columns are ``ref_`` / ``cur_`` + f1_weighted, f1, auroc, confidence_mean; null means absent.
    """

    def metric(side: str, *names: str) -> Column:
        present = [F.col(f"{side}_{m}") for m in names if f"{side}_{m}" in pairs.columns]
        return F.coalesce(*present, F.lit(0.0))

    f1 = F.greatest(metric("ref", "f1_weighted", "f1") - metric("cur", "f1_weighted", "f1"), F.lit(0.0))
    auroc = F.greatest(metric("ref", "auroc") - metric("cur", "auroc"), F.lit(0.0))
    shift = F.abs(metric("ref", "confidence_mean") - metric("cur", "confidence_mean"))
    hits = (
        (f1 >= cfg.f1_drop).cast("int")
        + (auroc >= cfg.auroc_drop).cast("int")
        + (shift >= cfg.confidence_shift).cast("int")
    )
    levels = F.array(*[F.lit(s) for s in SEVERITY_RANK])
    return pairs.withColumns(
        {
            "f1_drop": f1,
            "auroc_drop": auroc,
            "confidence_shift": shift,
            "concept_severity": F.element_at(levels, hits + 1),
        }
    )


def overall_severity(drifted_ratio: Column | str, concept_severity: Column | str) -> Column:
    share, concept = as_column(drifted_ratio), as_column(concept_severity)
    return (
        F.when((share >= CRITICAL_RATIO) | (concept == "critical"), "critical")
        .when((share >= HIGH_RATIO) | (concept == "high"), "high")
        .when((share > 0) | concept.isin("medium", "high", "critical"), "medium")
        .otherwise("low")
    )


def severity_rank(severity: Column, unknown: int) -> Column:
    rank = F.lit(unknown)
    for name, value in SEVERITY_RANK.items():
        rank = F.when(severity == name, value).otherwise(rank)
    return rank


def retraining_decision(
    reports: DataFrame,
    policy: RetrainingPolicy | None = RetrainingPolicy(),
    severity: str = "severity",
) -> DataFrame:
    """Adds trigger and reason. With ``policy=None`` the policy columns are taken from the rows."""
    if policy is None:
        enabled, auto, minimum = F.col("enabled"), F.col("auto_trigger"), F.col("min_severity")
    else:
        enabled, auto, minimum = F.lit(policy.enabled), F.lit(policy.auto_trigger), F.lit(policy.min_severity)
    level = F.coalesce(F.col(severity), F.lit("low"))
    reached = severity_rank(level, UNKNOWN_SEVERITY_RANK) >= severity_rank(minimum, UNKNOWN_MINIMUM_RANK)
    return reports.withColumns(
        {
            "trigger": enabled & reached & auto,
            "reason": F.when(~enabled, "retraining disabled")
            .when(reached, "severity threshold reached")
            .otherwise("severity below threshold"),
        }
    )


def drift_report(results: DataFrame, metric_pairs: DataFrame, cfg: DriftConfig = DriftConfig()) -> DataFrame:
    """One report row per metric pair: summaries, severity and the drifted features sorted by name.

    The feature table has one row per column, so its list and its summary are one bounded row.
    """
    record = F.struct("feature", "psi", "ks_statistic", "ks_pvalue", "drifted")
    # One row per feature: computed once, used for the list and for the summary.
    results = results.sparkSession.createDataFrame(driver_rows(results, "feature drift"), results.schema)
    row = (
        results.agg(F.sort_array(F.collect_list(F.when(F.col("drifted"), record))).alias("drifted_features"))
        .withColumn("one", F.lit(1))
        .join(drift_summary(results).withColumn("one", F.lit(1)), "one")
    )
    concept = concept_drift(metric_pairs, cfg).withColumn("one", F.lit(1))
    joined = concept.join(F.broadcast(row), "one").drop("one")
    return joined.withColumn("severity", overall_severity("drifted_feature_ratio", "concept_severity"))


def extract_metrics(payload: DataFrame) -> DataFrame:
    """Adds f1, auroc and confidence_mean out of a report's ``fusion_binary``, ``hybrid_binary`` or top level.

    A report with a fusion block uses only that block; one with only a hybrid block gives its f1.
    """
    names = payload.schema

    def field(path: str) -> Column:
        head, _, tail = path.partition(".")
        if head not in payload.columns:
            return F.lit(None).cast("double")
        if tail and tail not in names[head].dataType.fieldNames():
            return F.lit(None).cast("double")
        return F.col(path).cast("double")

    def present(block: str) -> Column:
        return F.col(block).isNotNull() if block in payload.columns else F.lit(False)

    def pick(fusion: Sequence[str], hybrid: Sequence[str], top: str) -> Column:
        zero = F.lit(0.0)
        return (
            F.when(present("fusion_binary"), F.coalesce(*[field(p) for p in fusion], zero))
            .when(present("hybrid_binary"), F.coalesce(*[field(p) for p in hybrid], zero))
            .otherwise(F.coalesce(field(top), zero))
        )

    return payload.withColumns(
        {
            "metric_f1": pick(["fusion_binary.f1"], ["hybrid_binary.f1"], "f1"),
            "metric_auroc": pick(["fusion_binary.auroc", "fusion_binary.auroc_ovr_weighted"], [], "auroc"),
            "metric_confidence_mean": pick(
                ["fusion_binary.confidence_mean", "fusion_binary.attack_rate_pred"], [], "confidence_mean"
            ),
        }
    )
