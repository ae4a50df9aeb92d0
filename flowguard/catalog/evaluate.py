"""Evaluation of scored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowguard.catalog.registration import query, r6
from flowguard.functions.columns import rounded
from flowguard.operators import metrics
from flowguard.plans.views import view, with_views
from flowguard.session import scratch_path
from flowguard.sources import stores

BINARY = ["accuracy", "f1", "precision", "recall"]
MULTI = ["accuracy", "f1_weighted", "f1_macro", "precision_weighted", "recall_weighted"]


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "scored").withColumn("proba", F.array("p0", "p1", "p2"))


def round_doubles(df: DataFrame) -> DataFrame:
    return df.withColumns({f.name: rounded(f.name) for f in df.schema.fields if f.dataType.simpleString() == "double"})


def binary_sql(source: str, y: str = "y", pred: str = "pred") -> str:
    """A scalar query with the four binary metrics as columns."""
    return f"""SELECT CAST(sum(CASE WHEN {y} = {pred} THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS accuracy,
  coalesce(2E0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, coalesce(1E0 * tp / nullif(tp + fp, 0), 0) AS precision,
  coalesce(1E0 * tp / nullif(tp + fn, 0), 0) AS recall
FROM {source}, (SELECT count(*) FILTER (WHERE {y} = 1 AND {pred} = 1) AS tp,
  count(*) FILTER (WHERE {y} <> 1 AND {pred} = 1) AS fp, count(*) FILTER (WHERE {y} = 1 AND {pred} <> 1) AS fn FROM {source}) AS c
GROUP BY tp, fp, fn"""


def auroc_sql(source: str, y: str, score: str, by: str = "") -> str:
    """Area by average ranks: (sum of positive ranks - P(P+1)/2) / (P*N), per group."""
    part = f"PARTITION BY {by}" if by else ""
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT {keys}(sum(CASE WHEN yy = 1 THEN r ELSE 0E0 END) - pos * (pos + 1) / 2E0) / nullif(pos * neg, 0) AS auroc
FROM (SELECT {keys}{y} AS yy, rank() OVER ({part} ORDER BY {score}) + (count(*) OVER (PARTITION BY {keys}{score}) - 1) / 2E0 AS r,
  CAST(count(*) FILTER (WHERE {y} = 1) OVER ({part}) AS DOUBLE) AS pos,
  CAST(count(*) FILTER (WHERE {y} <> 1) OVER ({part}) AS DOUBLE) AS neg FROM {source})
{group + ", pos, neg" if group else "GROUP BY pos, neg"}"""


def per_class_sql(source: str, y: str = "label_id", pred: str = "pred_label_id") -> str:
    return f"""SELECT cls, support, predicted, tp, coalesce(1E0 * tp / nullif(predicted, 0), 0) AS precision,
  coalesce(1E0 * tp / nullif(support, 0), 0) AS recall, coalesce(2E0 * tp / nullif(support + predicted, 0), 0) AS f1
FROM (SELECT cls, CAST(sum(s) AS BIGINT) AS support, CAST(sum(p) AS BIGINT) AS predicted, CAST(sum(t) AS BIGINT) AS tp FROM (
  SELECT {y} AS cls, 1 AS s, 0 AS p, CASE WHEN {y} = {pred} THEN 1 ELSE 0 END AS t FROM {source}
  UNION ALL SELECT {pred}, 0, 1, 0 FROM {source}) GROUP BY cls)"""


MULTI_SQL = """SELECT 1E0 * sum(tp) / sum(support) AS accuracy, sum(f1 * support) / sum(support) AS f1_weighted, avg(f1) AS f1_macro,
  sum(precision * support) / sum(support) AS precision_weighted, sum(recall * support) / sum(support) AS recall_weighted
FROM per_class"""

OVR_LONG = """ovr AS (SELECT c.cls, s.label_id, CASE WHEN s.label_id = c.cls THEN 1 ELSE 0 END AS hit,
  CASE c.cls WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END AS score
  FROM scored s, (VALUES (0), (1), (2)) AS c(cls))"""


def ovr_sql() -> str:
    return f"""SELECT sum(auroc * support) / sum(support) AS auroc_ovr_weighted
FROM ({auroc_sql("ovr", "hit", "score", "cls")}) JOIN (SELECT label_id AS cls, count(*) AS support FROM scored GROUP BY label_id) USING (cls)"""


def rounded_columns(names: list[str]) -> str:
    return ", ".join(f"{r6(n)} AS {n}" for n in names)


@query(
    "binary_metrics",
    with_views("scored", rest=f"m AS ({binary_sql('scored')}), a AS ({auroc_sql('scored', 'y', 'score')})")
    + f"SELECT {rounded_columns([*BINARY, 'auroc'])} FROM m, a",
)
def binary_metrics(spark, sf_dir):
    return round_doubles(metrics.binary_metrics(scored(spark, sf_dir), "y", "pred", "score"))


@query(
    "auroc_binary",
    with_views("scored", rest=f"a AS ({auroc_sql('scored', 'y', 'score')})") + f"SELECT {r6('auroc')} AS auroc FROM a",
)
def auroc_binary(spark, sf_dir):
    return round_doubles(metrics.auroc(scored(spark, sf_dir), "y", "score"))


@query("auroc_ovr", with_views("scored", rest=OVR_LONG) + f"SELECT {r6('auroc_ovr_weighted')} AS auroc_ovr_weighted FROM ({ovr_sql()})")
def auroc_ovr(spark, sf_dir):
    return round_doubles(metrics.auroc_ovr(scored(spark, sf_dir), "label_id", "proba"))


@query(
    "per_class_metrics",
    with_views("scored", rest=f"per_class AS ({per_class_sql('scored')})")
    + f"SELECT cls, support, predicted, tp, {rounded_columns(['precision', 'recall', 'f1'])} FROM per_class",
)
def per_class_metrics(spark, sf_dir):
    return round_doubles(metrics.per_class_metrics(scored(spark, sf_dir), "label_id", "pred_label_id"))


@query(
    "multiclass_metrics",
    with_views("scored", rest=f"per_class AS ({per_class_sql('scored')}), m AS ({MULTI_SQL})")
    + f"SELECT {rounded_columns(MULTI)} FROM m",
)
def multiclass_metrics(spark, sf_dir):
    return round_doubles(metrics.multiclass_metrics(scored(spark, sf_dir), "label_id", "pred_label_id"))


@query(
    "evaluate_auto",
    with_views("scored", rest=f"per_class AS ({per_class_sql('scored')}), m AS ({MULTI_SQL}), {OVR_LONG}, o AS ({ovr_sql()})")
    + f"SELECT {rounded_columns([*MULTI, 'auroc_ovr_weighted'])} FROM m, o",
)
def evaluate_auto(spark, sf_dir):
    return round_doubles(metrics.evaluate_auto(scored(spark, sf_dir), "label_id", "pred_label_id", "proba"))


@query(
    "multiclass_predict",
    with_views("scored")
    + """SELECT row_key, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS prediction,
  greatest(p0, p1, p2) AS top_probability FROM scored""",
)
def multiclass_predict(spark, sf_dir):
    from flowguard.operators.models import argmax_class

    return scored(spark, sf_dir).select(
        "row_key", argmax_class("proba").alias("prediction"), F.array_max("proba").alias("top_probability")
    )


@query(
    "confusion_matrix",
    with_views("scored")
    + """SELECT a.c AS y, b.c AS p, CAST(coalesce(n, 0) AS BIGINT) AS n
FROM (SELECT DISTINCT label_id AS c FROM scored UNION SELECT DISTINCT pred_label_id FROM scored) AS a
CROSS JOIN (SELECT DISTINCT label_id AS c FROM scored UNION SELECT DISTINCT pred_label_id FROM scored) AS b
LEFT JOIN (SELECT label_id, pred_label_id, count(*) AS n FROM scored GROUP BY label_id, pred_label_id) AS k
  ON k.label_id = a.c AND k.pred_label_id = b.c""",
)
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(scored(spark, sf_dir), "label_id", "pred_label_id")


@query(
    "roc_points",
    with_views("scored")
    + f"""SELECT {r6('score')} AS threshold, {r6('sum(neg) OVER w / CAST(sum(neg) OVER () AS DOUBLE)')} AS fpr,
  {r6('sum(pos) OVER w / CAST(sum(pos) OVER () AS DOUBLE)')} AS tpr
FROM (SELECT score, CAST(count(*) FILTER (WHERE y = 1) AS DOUBLE) AS pos, CAST(count(*) FILTER (WHERE y <> 1) AS DOUBLE) AS neg
  FROM scored GROUP BY score) WINDOW w AS (ORDER BY score DESC)""",
)
def roc_points(spark, sf_dir):
    return round_doubles(metrics.roc_points(scored(spark, sf_dir), "y", "score"))


def bundle_sql() -> str:
    def long(model: str, table: str, names: list[str]) -> str:
        return " UNION ALL ".join(
            f"SELECT '{model}' AS model, '{n}' AS metric, {r6(n)} AS value FROM {table}" for n in names
        )

    return " UNION ALL ".join(
        [
            long("baseline_multiclass", "(SELECT * FROM m, o)", [*MULTI, "auroc_ovr_weighted"]),
            long("hybrid_binary", "(SELECT * FROM h, ha)", [*BINARY, "auroc"]),
            long("fusion_binary", "(SELECT * FROM f, fa)", [*BINARY, "auroc"]),
        ]
    )


BUNDLE_CTES = f"""per_class AS ({per_class_sql('scored')}), m AS ({MULTI_SQL}), {OVR_LONG}, o AS ({ovr_sql()}),
signals AS (SELECT *, CASE WHEN rec_error >= 0.7 THEN 1 ELSE 0 END AS hybrid_pred FROM scored),
h AS ({binary_sql('signals', 'y', 'hybrid_pred')}), ha AS ({auroc_sql('signals', 'y', 'rec_error')}),
f AS ({binary_sql('signals')}), fa AS ({auroc_sql('signals', 'y', 'score')})"""


def bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).withColumn("hybrid_pred", (F.col("rec_error") >= 0.7).cast("int"))
    return metrics.evaluate_bundle(
        rows, ("label_id", "pred_label_id", "proba"), ("y", "hybrid_pred", "rec_error"), ("y", "pred", "score")
    )


@query("evaluate_bundle", with_views("scored", rest=BUNDLE_CTES) + bundle_sql())
def evaluate_bundle(spark, sf_dir):
    return round_doubles(bundle(spark, sf_dir))


@query(
    "fold_f1",
    with_views("scored")
    + f"""SELECT fold, CAST(count(*) AS BIGINT) AS heldout_rows,
  {r6('2E0 * count(*) FILTER (WHERE y = 1 AND pred = 1) / greatest(count(*) FILTER (WHERE y = 1) + count(*) FILTER (WHERE pred = 1), 1)')} AS f1,
  {r6('avg(CAST(pred AS DOUBLE))')} AS attack_rate_pred
FROM (SELECT *, CAST(floor(f_disc * 100 + 0.5) AS INTEGER) % 5 AS fold FROM scored) GROUP BY fold""",
)
def fold_f1(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("fold", F.floor(F.col("f_disc") * 100 + F.lit(0.5)).cast("int") % 5)
    return round_doubles(metrics.fold_f1(rows, "y", "pred", ["fold"]))


@query(
    "family_accuracy",
    with_views("scored")
    + f"""SELECT split_part(label, '_', 1) AS attack_family, {r6('avg(CASE WHEN label_id = pred_label_id THEN 1E0 ELSE 0E0 END)')} AS accuracy
FROM scored GROUP BY 1""",
)
def family_accuracy(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("attack_family", F.split_part("label", F.lit("_"), F.lit(1)))
    return round_doubles(metrics.group_accuracy(rows, "attack_family", "label_id", "pred_label_id"))


def experiment_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "experiments").selectExpr(
        "run_name",
        """stack(4, 'baseline_multiclass', 0, 'f1_weighted', baseline_f1_weighted, 'hybrid_binary', 0, 'f1', hybrid_f1,
        'fusion_binary', 0, 'f1', fusion_f1, 'fusion_binary', 1, 'auroc', coalesce(fusion_auroc, fusion_auroc_ovr_weighted, 0D))
        AS (model, position, metric, value)""",
    )


@query(
    "report_lines",
    with_views(
        "experiments",
        rest="""lines AS (
  SELECT run_name, 0 AS block, 0 AS position, '# Experiment Report: ' || run_name AS line FROM experiments
  UNION ALL SELECT run_name, b, -2, '' FROM experiments, (VALUES (1), (2), (3), (4)) AS v(b)
  UNION ALL SELECT run_name, 1, -1, '### Baseline Multiclass (XGBoost)' FROM experiments
  UNION ALL SELECT run_name, 2, -1, '### Hybrid Binary (Dual Consistency)' FROM experiments
  UNION ALL SELECT run_name, 3, -1, '### Fusion Binary' FROM experiments
  UNION ALL SELECT run_name, 4, -1, '### Artifacts' FROM experiments
  UNION ALL SELECT run_name, 1, 0, printf('- f1_weighted: %.6f', baseline_f1_weighted) FROM experiments
  UNION ALL SELECT run_name, 2, 0, printf('- f1: %.6f', hybrid_f1) FROM experiments
  UNION ALL SELECT run_name, 3, 0, printf('- f1: %.6f', fusion_f1) FROM experiments
  UNION ALL SELECT run_name, 3, 1, printf('- auroc: %.6f', coalesce(fusion_auroc, fusion_auroc_ovr_weighted, 0)) FROM experiments
  UNION ALL SELECT run_name, 4, 0, '- fusion_model: models/' || run_name FROM experiments)""",
    )
    + """SELECT run_name, CAST(row_number() OVER (PARTITION BY run_name ORDER BY block, position) AS INTEGER) AS line_no, line
FROM lines""",
)
def report_lines(spark, sf_dir):
    rows = experiment_metrics(spark, sf_dir)
    artifacts = (
        rows.select("run_name")
        .distinct()
        .select(
            "run_name",
            F.lit(0).alias("position"),
            F.lit("fusion_model").alias("name"),
            F.concat(F.lit("models/"), "run_name").alias("location"),
        )
    )
    lines = metrics.report_lines(rows, artifacts, "run_name", ["run_name"])
    path = scratch_path(spark, "report")
    stores.write_documents(metrics.report_documents(lines, ["run_name"]), path, "report")
    return metrics.document_lines(stores.read_documents(spark, path, "report"))


@query(
    "evaluation_summary",
    with_views("experiments", "loao_runs")
    + f"""SELECT e.run_name AS exp1_run_name, {r6('e.fusion_f1')} AS exp1_fusion_f1, count(r.run_name) > 0 AS exp2_enabled,
  CAST(count(r.run_name) AS BIGINT) AS exp2_total_runs,
  coalesce(string_agg(r.held_out_attack, ',' ORDER BY r.held_out_attack), '') AS exp2_attacks
FROM experiments e LEFT JOIN loao_runs r USING (run_name) GROUP BY e.run_name, e.fusion_f1""",
)
def evaluation_summary(spark, sf_dir):
    from flowguard.operators.registry import evaluation_summary as summary

    experiments = view(spark, sf_dir, "experiments").select("run_name", "fusion_f1")
    table = summary(experiments, view(spark, sf_dir, "loao_runs"))
    return round_doubles(table.withColumn("exp2_attacks", F.array_join("exp2_attacks", ",")))
