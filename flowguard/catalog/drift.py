"""Data drift, concept drift, severity and retraining."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowguard.catalog.evaluate import round_doubles
from flowguard.catalog.registration import query, r6
from flowguard.config import DriftConfig, RetrainingPolicy
from flowguard.functions.columns import rounded
from flowguard.operators import drift
from flowguard.plans import flow
from flowguard.plans.views import TRAFFIC_FEATURES, view, with_views

# Reference: before noon. Current: from noon on, with a shifted copy of one feature.
DRIFT_FEATURES = [*TRAFFIC_FEATURES, "f_shift"]
SIDES_SQL = """sides AS (SELECT *, CASE WHEN f_hour < 12 THEN 0 ELSE 1 END AS side,
  CASE WHEN f_hour < 12 THEN f_value ELSE f_value * 1.5 + 10 END AS f_shift FROM traffic)"""


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    traffic = view(spark, sf_dir, "traffic")
    before = traffic.where("f_hour < 12").withColumn("f_shift", F.col("f_value"))
    after = traffic.where("f_hour >= 12").withColumn("f_shift", F.col("f_value") * F.lit(1.5) + F.lit(10))
    return before, after


def psi_sql(source: str, f: str) -> str:
    """One feature: quantile edges of side 0, in-range counts of both sides, the index."""
    levels = ", ".join(str(i / 10) for i in range(11))
    return f"""SELECT '{f}' AS feature, CASE WHEN n_edges < 2 OR empty_side THEN 0E0 ELSE total END AS psi FROM (
  SELECT any_value(n_edges) AS n_edges, any_value(empty_side) AS empty_side, sum((c - r) * ln(c / r)) AS total FROM (
    SELECT n_edges, empty_side, CASE WHEN nr = 0 THEN 0.0001E0 ELSE nr / greatest(sum(nr) OVER (), 1) END AS r,
      CASE WHEN nc = 0 THEN 0.0001E0 ELSE nc / greatest(sum(nc) OVER (), 1) END AS c FROM (
      SELECT b.i, any_value(len(e.edges)) AS n_edges,
        any_value((SELECT count(DISTINCT side) < 2 FROM {source} WHERE {f} IS NOT NULL)) AS empty_side,
        CAST(count(s.side) FILTER (WHERE s.side = 0) AS DOUBLE) AS nr, CAST(count(s.side) FILTER (WHERE s.side = 1) AS DOUBLE) AS nc
      FROM (SELECT list_sort(list_distinct(quantile_cont({f}, [{levels}]))) AS edges FROM {source} WHERE side = 0) AS e
      CROSS JOIN (SELECT unnest(range(1, 11)) AS i) AS b
      LEFT JOIN {source} AS s ON b.i < len(e.edges) AND s.{f} >= e.edges[b.i]
        AND (s.{f} < e.edges[b.i + 1] OR (b.i = len(e.edges) - 1 AND s.{f} = e.edges[b.i + 1]))
      WHERE b.i < greatest(len(e.edges), 2) GROUP BY b.i)))"""


def ks_distance_sql(source: str, f: str) -> str:
    return f"""SELECT '{f}' AS feature, any_value(CAST(n0 AS BIGINT)) AS n, any_value(CAST(n1 AS BIGINT)) AS m, max(abs(c0 / n0 - c1 / n1)) AS d FROM (
    SELECT CAST(sum(a0) OVER w AS DOUBLE) AS c0, CAST(sum(a1) OVER w AS DOUBLE) AS c1,
      CAST(sum(a0) OVER () AS DOUBLE) AS n0, CAST(sum(a1) OVER () AS DOUBLE) AS n1
    FROM (SELECT {f} AS v, count(*) FILTER (WHERE side = 0) AS a0, count(*) FILTER (WHERE side = 1) AS a1
      FROM {source} WHERE {f} IS NOT NULL GROUP BY {f}) WINDOW w AS (ORDER BY v))"""


# Up to 10,000 values a side: the share of merged orders that stay nearer than d, carried from diagonal to diagonal. Beyond, and where the
# tail is below 1e-12, the limiting series.
KS_SQL = """apart AS (SELECT *, d * d * n * m / (n + m) AS lam2, CAST(round(d * n * m / gcd(n, m)) AS BIGINT) * gcd(n, m) AS t FROM distances),
ks AS (WITH RECURSIVE walk AS (
  SELECT feature, n, m, t, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS lo, [1E0] AS mass FROM apart
    WHERE d > 0 AND greatest(n, m) <= 10000 AND lam2 < 15
  UNION ALL
  SELECT feature, n, m, t, k + 1, lo2, list_transform(range(lo2, hi2 + 1), lambda i:
      (coalesce(mass[i - lo], 0) * (n - i + 1) + coalesce(mass[i - lo + 1], 0) * (m - k + i)) / (n + m - k))
    FROM (SELECT *, greatest(0, k + 1 - m, CAST(floor(((k + 1) * n - t) / (n + m)) AS BIGINT) + 1) AS lo2,
      least(n, k + 1, CAST(ceil(((k + 1) * n + t) / (n + m)) AS BIGINT) - 1) AS hi2 FROM walk WHERE k < n + m))
SELECT feature, d AS ks_statistic, CASE WHEN d = 0 THEN 1E0 WHEN mass IS NOT NULL THEN 1 - coalesce(mass[1], 0) ELSE least(greatest(2 *
    list_sum(list_transform(range(1, 101), lambda j: CASE WHEN j % 2 = 1 THEN 1E0 ELSE -1E0 END * exp(-2E0 * j * j * lam2))), 0), 1) END AS ks_pvalue
  FROM apart LEFT JOIN (SELECT feature, mass FROM walk WHERE k = n + m) USING (feature))"""


def drift_ctes(source: str, features: list[str]) -> str:
    psi = " UNION ALL ".join(f"({psi_sql(source, f)})" for f in features)
    distances = " UNION ALL ".join(f"({ks_distance_sql(source, f)})" for f in features)
    return f"""psi AS ({psi}), distances AS ({distances}), {KS_SQL}, results AS (SELECT feature, psi, ks_statistic, ks_pvalue,
  psi > 0.2 OR ks_pvalue < 0.05 AS drifted FROM psi JOIN ks USING (feature))"""


SUMMARY_SQL = """summary AS (SELECT CAST(count(*) FILTER (WHERE drifted) AS DOUBLE) AS drifted_feature_count,
  CAST(count(*) FILTER (WHERE drifted) AS DOUBLE) / count(*) AS drifted_feature_ratio, max(psi) AS max_psi, avg(psi) AS mean_psi
  FROM results)"""


def traffic_drift_sql(rest: str) -> str:
    ctes = ", ".join([SIDES_SQL, drift_ctes("sides", DRIFT_FEATURES), SUMMARY_SQL])
    return with_views("traffic", rest=ctes) + rest


RESULTS = f"feature, {r6('psi')} AS psi, {r6('ks_statistic')} AS ks_statistic, {r6('ks_pvalue')} AS ks_pvalue, drifted"


@query("drift_psi", traffic_drift_sql(f"SELECT feature, {r6('psi')} AS psi FROM psi"))
def drift_psi(spark, sf_dir):
    before, after = sides(spark, sf_dir)
    edges = drift.psi_edges(before, DRIFT_FEATURES)
    names = F.element_at(F.array(*[F.lit(f) for f in DRIFT_FEATURES]), F.col("feature_id") + 1)
    table = drift.population_stability(before, after, DRIFT_FEATURES, edges)
    return table.select(names.alias("feature"), rounded("psi").alias("psi"))


@query(
    "drift_ks",
    traffic_drift_sql(f"SELECT feature, {r6('ks_statistic')} AS ks_statistic, {r6('ks_pvalue')} AS ks_pvalue FROM ks"),
)
def drift_ks(spark, sf_dir):
    before, after = sides(spark, sf_dir)
    table = drift.kolmogorov_smirnov(before, after, DRIFT_FEATURES)
    names = F.element_at(F.array(*[F.lit(f) for f in DRIFT_FEATURES]), F.col("feature_id") + 1)
    return table.select(
        names.alias("feature"),
        rounded("ks_statistic").alias("ks_statistic"),
        rounded("ks_pvalue").alias("ks_pvalue"),
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.feature_drift(*sides(spark, sf_dir), DRIFT_FEATURES)


@query("drift_features", traffic_drift_sql(f"SELECT {RESULTS} FROM results"))
def drift_features(spark, sf_dir):
    return round_doubles(results(spark, sf_dir))


@query(
    "drift_summary",
    traffic_drift_sql(
        f"SELECT drifted_feature_count, {r6('drifted_feature_ratio')} AS drifted_feature_ratio, {r6('max_psi')} AS max_psi, "
        f"{r6('mean_psi')} AS mean_psi FROM summary"
    ),
)
def drift_summary(spark, sf_dir):
    return round_doubles(drift.drift_summary(results(spark, sf_dir)))


CONCEPT_SQL = """concept AS (SELECT *, CASE hits WHEN 3 THEN 'critical' WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END
    AS concept_severity FROM (SELECT *, CAST(f1_drop >= 0.05 AS INTEGER) + CAST(auroc_drop >= 0.05 AS INTEGER) +
    CAST(confidence_shift >= 0.1 AS INTEGER) AS hits FROM (SELECT user_id,
  greatest(coalesce(ref_f1_weighted, ref_f1, 0) - coalesce(cur_f1_weighted, cur_f1, 0), 0) AS f1_drop,
  greatest(coalesce(ref_auroc, 0) - coalesce(cur_auroc, 0), 0) AS auroc_drop,
  abs(coalesce(ref_confidence_mean, 0) - coalesce(cur_confidence_mean, 0)) AS confidence_shift FROM metric_pairs)))"""
CONCEPT = ["user_id", "f1_drop", "auroc_drop", "confidence_shift", "concept_severity"]
CONCEPT_COLUMNS = (
    f"user_id, {r6('f1_drop')} AS f1_drop, {r6('auroc_drop')} AS auroc_drop, {r6('confidence_shift')} AS confidence_shift, "
    "concept_severity"
)


@query("concept_drift", with_views("metric_pairs", rest=CONCEPT_SQL) + f"SELECT {CONCEPT_COLUMNS} FROM concept")
def concept_drift(spark, sf_dir):
    return round_doubles(drift.concept_drift(view(spark, sf_dir, "metric_pairs")).select(*CONCEPT))


# The share of drifted features of a client is taken from its own label mix.
RATIO_SQL = """shares AS (SELECT CAST(f_user AS BIGINT) AS user_id,
  avg(CASE WHEN f_k < 3 THEN 1E0 ELSE 0E0 END) * 4 AS drifted_ratio FROM traffic GROUP BY f_user),
severities AS (SELECT user_id, CASE WHEN drifted_ratio >= 0.5 OR concept_severity = 'critical' THEN 'critical'
  WHEN drifted_ratio >= 0.25 OR concept_severity = 'high' THEN 'high'
  WHEN drifted_ratio > 0 OR concept_severity IN ('medium', 'high', 'critical') THEN 'medium' ELSE 'low' END AS severity
  FROM concept JOIN shares USING (user_id))"""


def severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = (
        view(spark, sf_dir, "traffic")
        .groupBy(F.col("f_user").cast("bigint").alias("user_id"))
        .agg((F.avg((F.col("f_k") < 3).cast("double")) * 4).alias("drifted_ratio"))
    )
    concept = drift.concept_drift(view(spark, sf_dir, "metric_pairs")).select("user_id", "concept_severity")
    return concept.join(shares, "user_id").select(
        "user_id", drift.overall_severity("drifted_ratio", "concept_severity").alias("severity")
    )


@query(
    "drift_severity",
    with_views("traffic", "metric_pairs", rest=f"{CONCEPT_SQL}, {RATIO_SQL}") + "SELECT user_id, severity FROM severities",
)
def drift_severity(spark, sf_dir):
    return severities(spark, sf_dir)


# Policies by client, so that disabled, unknown and automatic ones all meet every severity.
@query(
    "retraining_decision",
    with_views("traffic", "metric_pairs", rest=f"{CONCEPT_SQL}, {RATIO_SQL}")
    + """SELECT user_id, severity, enabled AND reached AND auto_trigger AS "trigger", CASE WHEN NOT enabled THEN 'retraining disabled'
  WHEN reached THEN 'severity threshold reached' ELSE 'severity below threshold' END AS reason
FROM (SELECT *, CASE severity WHEN 'medium' THEN 1 WHEN 'high' THEN 2 WHEN 'critical' THEN 3 ELSE 0 END >=
    CASE min_severity WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 WHEN 'critical' THEN 3 ELSE 2 END AS reached
  FROM (SELECT user_id, CASE WHEN user_id % 11 = 0 THEN 'odd' ELSE severity END AS severity, user_id % 5 <> 0 AS enabled,
    user_id % 2 = 0 AS auto_trigger,
    CASE user_id % 6 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'critical' WHEN 3 THEN 'never' ELSE 'high' END AS min_severity
    FROM severities))""",
)
def retraining_decision(spark, sf_dir):
    reports = severities(spark, sf_dir).selectExpr(
        "user_id",
        "CASE WHEN user_id % 11 = 0 THEN 'odd' ELSE severity END AS severity",
        "user_id % 5 <> 0 AS enabled",
        "user_id % 2 = 0 AS auto_trigger",
        """CASE user_id % 6 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'critical' WHEN 3 THEN 'never'
           ELSE 'high' END AS min_severity""",
    )
    return drift.retraining_decision(reports, policy=None).select("user_id", "severity", "trigger", "reason")


@query(
    "drift_report",
    with_views(
        "traffic",
        "metric_pairs",
        rest=", ".join([SIDES_SQL, drift_ctes("sides", DRIFT_FEATURES), SUMMARY_SQL, CONCEPT_SQL]),
    )
    + f"""SELECT user_id, drifted_feature_count, {r6('max_psi')} AS max_psi, concept_severity,
  CASE WHEN drifted_feature_ratio >= 0.5 OR concept_severity = 'critical' THEN 'critical'
    WHEN drifted_feature_ratio >= 0.25 OR concept_severity = 'high' THEN 'high'
    WHEN drifted_feature_ratio > 0 OR concept_severity = 'medium' THEN 'medium' ELSE 'low' END AS severity,
  (SELECT string_agg(feature, ',' ORDER BY feature) FROM results WHERE drifted) AS drifted_features
FROM concept, summary""",
)
def drift_report(spark, sf_dir):
    report = drift.drift_report(results(spark, sf_dir), view(spark, sf_dir, "metric_pairs"))
    return report.select(
        "user_id",
        "drifted_feature_count",
        rounded("max_psi").alias("max_psi"),
        "concept_severity",
        "severity",
        F.array_join("drifted_features.feature", ",").alias("drifted_features"),
    )


@query(
    "extract_metrics",
    with_views("experiments")
    + f"""SELECT run_name, {r6("CASE shape WHEN 0 THEN fusion_f1 WHEN 1 THEN hybrid_f1 ELSE baseline_f1_weighted END")} AS metric_f1,
  {r6("CASE shape WHEN 0 THEN coalesce(fusion_auroc, fusion_auroc_ovr_weighted, 0) WHEN 1 THEN 0 ELSE coalesce(fusion_auroc, 0) END")}
    AS metric_auroc,
  {r6("CASE shape WHEN 0 THEN hybrid_f1 / 2 ELSE 0 END")} AS metric_confidence_mean
FROM (SELECT *, user_id % 3 AS shape FROM (SELECT * REPLACE (CASE WHEN user_id % 6 < 3 THEN fusion_auroc ELSE NULL END AS fusion_auroc)
  FROM experiments))""",
)
def extract_metrics(spark, sf_dir):
    shape = F.col("user_id") % 3
    rows = view(spark, sf_dir, "experiments").withColumn(
        "fusion_auroc", F.when(F.col("user_id") % 6 < 3, F.col("fusion_auroc"))
    )
    payload = rows.select(
        "run_name",
        F.when(
            shape == 0,
            F.struct(
                F.col("fusion_f1").alias("f1"),
                F.col("fusion_auroc").alias("auroc"),
                F.col("fusion_auroc_ovr_weighted").alias("auroc_ovr_weighted"),
                (F.col("hybrid_f1") / 2).alias("attack_rate_pred"),
            ),
        ).alias("fusion_binary"),
        F.when(shape == 1, F.struct(F.col("hybrid_f1").alias("f1"))).alias("hybrid_binary"),
        F.when(shape == 2, F.col("baseline_f1_weighted")).alias("f1"),
        F.when(shape == 2, F.col("fusion_auroc")).alias("auroc"),
    )
    found = drift.extract_metrics(payload)
    return round_doubles(found.select("run_name", "metric_f1", "metric_auroc", "metric_confidence_mean"))


@query(
    "drift_job",
    with_views(
        "traffic",
        "metric_pairs",
        rest=", ".join([SIDES_SQL, drift_ctes("sides", DRIFT_FEATURES), SUMMARY_SQL, CONCEPT_SQL]),
    )
    + """SELECT user_id, severity, reached AS "trigger", CASE WHEN reached THEN 'severity threshold reached'
  ELSE 'severity below threshold' END AS reason FROM (SELECT user_id, severity, severity IN ('high', 'critical') AS reached FROM (
  SELECT user_id, CASE WHEN drifted_feature_ratio >= 0.5 OR concept_severity = 'critical' THEN 'critical'
    WHEN drifted_feature_ratio >= 0.25 OR concept_severity = 'high' THEN 'high'
    WHEN drifted_feature_ratio > 0 OR concept_severity = 'medium' THEN 'medium' ELSE 'low' END AS severity
  FROM concept, summary))""",
)
def drift_job(spark, sf_dir):
    before, after = sides(spark, sf_dir)
    decided = flow.drift_job(
        before,
        after,
        view(spark, sf_dir, "metric_pairs"),
        DRIFT_FEATURES,
        DriftConfig(),
        RetrainingPolicy(auto_trigger=True),
    )
    return decided.select("user_id", "severity", "trigger", "reason")
