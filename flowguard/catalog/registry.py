"""Promotion, versions, fingerprints, reports. Candidates are the clients' experiment reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowguard.catalog.evaluate import round_doubles
from flowguard.catalog.registration import query, r6
from flowguard.operators import registry
from flowguard.plans.views import view, with_views
from flowguard.session import scratch_path

EXP = "coalesce(fusion_auroc, fusion_auroc_ovr_weighted, 0) AS fusion_auroc"
METRICS_SQL = f"""loao AS (SELECT run_name, avg(f1) AS loao_mean_f1, min(f1) AS loao_min_f1,
  avg(attack_rate_pred) AS loao_mean_attack_rate_pred, CAST(count(*) AS DOUBLE) AS loao_run_count FROM loao_runs GROUP BY run_name),
metrics AS (SELECT run_name, baseline_f1_weighted, hybrid_f1, fusion_f1, {EXP}, coalesce(loao_mean_f1, 0) AS loao_mean_f1,
  coalesce(loao_min_f1, 0) AS loao_min_f1, loao_mean_attack_rate_pred, coalesce(loao_run_count, 0) AS loao_run_count
  FROM experiments LEFT JOIN loao USING (run_name)),
gated AS (SELECT *, CASE WHEN fusion_f1 < 0.7 THEN printf('fusion_f1 below threshold (%.4f < %.4f)', fusion_f1, 0.7E0)
  WHEN fusion_auroc < 0.7 THEN printf('fusion_auroc below threshold (%.4f < %.4f)', fusion_auroc, 0.7E0)
  WHEN loao_mean_f1 < 0.65 THEN printf('loao_mean_f1 below threshold (%.4f < %.4f)', loao_mean_f1, 0.65E0)
  WHEN loao_min_f1 < 0.5 THEN printf('loao_min_f1 below threshold (%.4f < %.4f)', loao_min_f1, 0.5E0)
  WHEN fusion_f1 - baseline_f1_weighted < 0.02 THEN printf('fusion_f1 does not improve enough over baseline (%.4f - %.4f < %.4f)',
    fusion_f1, baseline_f1_weighted, 0.02E0)
  ELSE 'passed promotion gates' END AS reason FROM metrics),
decided AS (SELECT *, reason = 'passed promotion gates' AS approved FROM gated)"""
HASH_SQL = """hashed AS (SELECT *, sha256(run_name || '/' || CAST(n_rows AS VARCHAR)) AS exp1_hash FROM experiments),
folds AS (SELECT run_name, sha256(string_agg(held_out_attack || ':' || CAST(heldout_rows AS VARCHAR), ',' ORDER BY held_out_attack))
  AS exp2_hash FROM loao_runs GROUP BY run_name)"""


def experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "experiments")


@query(
    "promotion_exp_metrics",
    with_views("experiments")
    + f"""SELECT run_name, {r6('baseline_f1_weighted')} AS baseline_f1_weighted, {r6('hybrid_f1')} AS hybrid_f1,
  {r6('fusion_f1')} AS fusion_f1, {r6('coalesce(fusion_auroc, fusion_auroc_ovr_weighted, 0)')} AS fusion_auroc FROM experiments""",
)
def promotion_exp_metrics(spark, sf_dir):
    return round_doubles(registry.experiment_metrics(experiments(spark, sf_dir)))


@query(
    "loao_aggregate",
    with_views("experiments", "loao_runs", rest=METRICS_SQL)
    + f"""SELECT run_name, {r6('loao_mean_f1')} AS loao_mean_f1, {r6('loao_min_f1')} AS loao_min_f1,
  {r6('loao_mean_attack_rate_pred')} AS loao_mean_attack_rate_pred, loao_run_count FROM metrics""",
)
def loao_aggregate(spark, sf_dir):
    combined = registry.combined_metrics(experiments(spark, sf_dir), view(spark, sf_dir, "loao_runs"))
    names = ["loao_mean_f1", "loao_min_f1", "loao_mean_attack_rate_pred", "loao_run_count"]
    return round_doubles(combined.select("run_name", *names))


@query(
    "promotion_gate",
    with_views("experiments", "loao_runs", rest=METRICS_SQL) + "SELECT run_name, approved, reason FROM decided",
)
def promotion_gate(spark, sf_dir):
    combined = registry.combined_metrics(experiments(spark, sf_dir), view(spark, sf_dir, "loao_runs"))
    return registry.promotion_gate(combined).select("run_name", "approved", "reason")


@query(
    "promotion_gate_table",
    with_views("experiments", "loao_runs", rest=METRICS_SQL)
    + " UNION ALL ".join(
        f"SELECT run_name, {i} AS gate_no, '{g}' AS gate, {r6(o)} AS observed, {m}E0 AS minimum, {o} >= {m} AS passed FROM metrics"
        for i, (g, o, m) in enumerate(
            [
                ("fusion_f1", "fusion_f1", 0.7),
                ("fusion_auroc", "fusion_auroc", 0.7),
                ("loao_mean_f1", "loao_mean_f1", 0.65),
                ("loao_min_f1", "loao_min_f1", 0.5),
                ("baseline_gap", "(fusion_f1 - baseline_f1_weighted)", 0.02),
            ]
        )
    ),
)
def promotion_gate_table(spark, sf_dir):
    combined = registry.combined_metrics(experiments(spark, sf_dir), view(spark, sf_dir, "loao_runs"))
    return registry.gate_table(combined).withColumn("observed", F.floor(F.col("observed") * 1e6 + F.lit(0.50001)) / 1e6)


@query("content_hash", with_views("flows") + "SELECT row_key, sha256(label || ':' || row_key) AS hash FROM flows")
def content_hash(spark, sf_dir):
    text = F.concat("label", F.lit(":"), "row_key")
    return view(spark, sf_dir, "flows").select("row_key", registry.content_hash(text).alias("hash"))


def run_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = experiments(spark, sf_dir).select(
        "run_name",
        registry.content_hash(F.concat("run_name", F.lit("/"), F.col("n_rows").cast("string"))).alias("exp1_hash"),
    )
    # A run has one fold per attack label.
    cell = F.concat("held_out_attack", F.lit(":"), F.col("heldout_rows").cast("string"))
    folds = view(spark, sf_dir, "loao_runs").groupBy("run_name").agg(
        registry.content_hash(F.array_join(F.sort_array(F.collect_list(cell)), ",")).alias("exp2_hash")
    )
    return own.join(folds, "run_name", "left")


@query(
    "version_id",
    with_views("experiments", "loao_runs", rest=HASH_SQL)
    + """SELECT run_name, 'hybrid-' || substr(sha256(concat_ws('|', exp1_hash, exp2_hash)), 1, 12) AS version
FROM hashed LEFT JOIN folds USING (run_name)""",
)
def version_id(spark, sf_dir):
    return run_hashes(spark, sf_dir).select("run_name", registry.version_id(["exp1_hash", "exp2_hash"]).alias("version"))


DECISION_SQL = f"""{METRICS_SQL}, {HASH_SQL},
gates AS (SELECT sha256('{{"min_fusion_auroc":0.7,"min_fusion_f1":0.7,"min_fusion_over_baseline_gap":0.02,"min_loao_mean_f1":0.65,"min_loao_min_f1":0.5}}') AS gate_hash),
decisions AS (SELECT d.*, CASE WHEN approved THEN 'fusion' ELSE 'none' END AS champion_source,
  'hybrid-' || substr(sha256(concat_ws('|', sha256(exp1_hash), sha256(coalesce(exp2_hash, '')), gate_hash)), 1, 12) AS version
  FROM decided d JOIN hashed USING (run_name) LEFT JOIN folds USING (run_name), gates)"""


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.promotion_decision(
        experiments(spark, sf_dir),
        view(spark, sf_dir, "loao_runs"),
        experiment_text="exp1_hash",
        runs_text=F.coalesce("exp2_hash", F.lit("")),
        reports=run_hashes(spark, sf_dir),
    )


@query(
    "promotion_decision",
    with_views("experiments", "loao_runs", rest=DECISION_SQL)
    + f"SELECT run_name, approved, reason, champion_source, version, {r6('fusion_f1')} AS fusion_f1 FROM decisions",
)
def promotion_decision(spark, sf_dir):
    table = decisions(spark, sf_dir).select("run_name", "approved", "reason", "champion_source", "version", "fusion_f1")
    return round_doubles(table)


def published_manifests(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Publishes the decisions in two batches. A run counts as promoted when its rows were complete."""
    sizes = experiments(spark, sf_dir).select("run_name", F.col("n_rows").alias("promoted_at"), (F.col("user_id") % 2).alias("half"))
    rows = decisions(spark, sf_dir).join(sizes, "run_name")
    for half in (0, 1):
        registry.publish_manifests(rows.where(F.col("half") == half), folder, "promoted_at")


@query(
    "promotion_manifest",
    with_views("experiments", "loao_runs", rest=DECISION_SQL)
    + f"""SELECT d.run_name, d.approved, d.champion_source, d.reason, d.version, 'fusion' AS model_name,
  sha256('{{"exp1":"' || d.run_name || '","exp2":' || CAST(d.loao_run_count AS BIGINT) || '}}') AS data_hash, gate_hash AS config_hash,
  sha256(concat_ws('|', exp1_hash, coalesce(exp2_hash, ''))) AS experiment_hash, 'exp1_ae_vs_baseline + exp2_loao' AS promoted_from,
  {r6('d.loao_min_f1')} AS loao_min_f1, n_rows AS promoted_at, e.user_id % 2 = 1 AS in_latest
FROM decisions d JOIN hashed USING (run_name) LEFT JOIN folds USING (run_name) JOIN (SELECT run_name, user_id FROM experiments) e USING (run_name), gates""",
)
def promotion_manifest(spark, sf_dir):
    """Manifests read back from the store, with a mark at those of the latest batch."""
    folder = scratch_path(spark, "manifests")
    published_manifests(spark, sf_dir, folder)
    stored = registry.stored_manifests(spark, folder)
    latest = registry.stored_manifests(spark, folder, latest=True).select("run_name", F.lit(True).alias("in_latest"))
    table = stored.join(latest, "run_name", "left").select(
        "run_name", "approved", "champion_source", "reason", *registry.VERSION_INFO, "metrics.loao_min_f1", "promoted_at",
        F.coalesce("in_latest", F.lit(False)).alias("in_latest"),
    )
    return round_doubles(table)


@query(
    "deployment_summary",
    with_views("experiments", "loao_runs", rest=DECISION_SQL)
    + f"""SELECT run_name, approved, reason, champion_source, version, {r6('loao_min_f1')} AS loao_min_f1,
  {r6('fusion_auroc')} AS fusion_auroc FROM decisions""",
)
def deployment_summary(spark, sf_dir):
    table = registry.deployment_summary(decisions(spark, sf_dir))
    return round_doubles(
        table.select(
            "run_name", "approved", "reason", "champion_source", "version", "metrics.loao_min_f1", "metrics.fusion_auroc"
        )
    )


@query(
    "run_report",
    with_views("experiments", "loao_runs", rest=DECISION_SQL)
    + f"""SELECT d.run_name, {r6('d.fusion_f1')} AS fusion_f1, CAST(loao_run_count AS BIGINT) AS exp2_total_runs,
  d.approved, d.version, 'skipped' AS skipped_version FROM decisions d""",
)
def run_report(spark, sf_dir):
    rows = registry.evaluation_summary(
        experiments(spark, sf_dir).select("run_name", "fusion_f1"), view(spark, sf_dir, "loao_runs")
    )
    made = decisions(spark, sf_dir)
    full = registry.run_report(rows, made)
    skipped = registry.run_report(rows, made, deploy=False)
    return round_doubles(
        full.select(
            "run_name",
            "training.fusion_f1",
            "evaluation.exp2_total_runs",
            "deployment.approved",
            "deployment.version",
        ).join(skipped.select("run_name", F.col("deployment.version").alias("skipped_version")), "run_name")
    )


@query(
    "table_fingerprint",
    with_views("flows")
    + """SELECT n AS rows, content, md5(concat_ws('|', 'row_key:string|label:string', CAST(n AS VARCHAR), CAST(content AS VARCHAR)))
  AS fingerprint FROM (SELECT CAST(count(*) AS BIGINT) AS n,
  CAST(sum(CAST('0x' || substr(md5(concat_ws('|', coalesce(length(row_key) || ':' || row_key, '-'), coalesce(length(label) || ':' || label, '-'))), 1, 15) AS BIGINT)) AS VARCHAR) AS content FROM flows)""",
)
def table_fingerprint(spark, sf_dir):
    return registry.table_fingerprint(view(spark, sf_dir, "flows").select("row_key", "label"))


@query(
    "champion_model",
    with_views("experiments", "loao_runs", rest=DECISION_SQL)
    + """SELECT 'any' AS pick, version AS model_version, champion_source FROM (SELECT * FROM decisions JOIN experiments USING (run_name)
  ORDER BY n_rows DESC, version DESC LIMIT 1)
UNION ALL SELECT 'approved', coalesce(max(version), 'unversioned'), coalesce(max(champion_source), 'unknown') FROM (SELECT version, champion_source
  FROM decisions JOIN experiments USING (run_name) WHERE approved ORDER BY n_rows DESC, version DESC LIMIT 1)
UNION ALL SELECT 'none', 'unversioned', 'unknown'""",
)
def champion_model(spark, sf_dir):
    folder = scratch_path(spark, "manifests")
    published_manifests(spark, sf_dir, folder)
    stored = registry.stored_manifests(spark, folder)
    nothing = registry.stored_manifests(spark, f"{folder}/none")
    return (
        registry.champion_model(stored)
        .withColumn("pick", F.lit("any"))
        .unionByName(registry.champion_model(stored, approved_only=True).withColumn("pick", F.lit("approved")))
        .unionByName(registry.champion_model(nothing).withColumn("pick", F.lit("none")))
    )
