"""Signals, dual scores, fusion with fixed coefficients, requests, responses, monitoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowguard.catalog.evaluate import round_doubles
from flowguard.catalog.registration import query, r6
from flowguard.functions.columns import rounded
from flowguard.operators import monitor, scoring, weights
from flowguard.operators.autoencoder import reconstruction_error as error_term
from flowguard.operators.models import class_weights as balanced_weights
from flowguard.plans.views import FLOW_FEATURES, VECTOR_FEATURES, view, with_views

# Coefficients for the SQL check of the fusion expression.
FUSION_WEIGHTS, FUSION_INTERCEPT = (4.0, 1.5, 2.0), -3.5


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "scored").select("row_key", "label", "y", F.col("score").alias("clf_score"), "rec_error")


# ---- weights -------------------------------------------------------------------------------------

RAW_WEIGHTS = "raw AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, avg(abs({f})) AS weight FROM flows" for f in FLOW_FEATURES) + ")"
WEIGHTS_SQL = f"""{RAW_WEIGHTS}, weights AS (SELECT feature, CASE WHEN max(weight) OVER () = min(weight) OVER () THEN 1E0
  ELSE greatest((weight - min(weight) OVER ()) / (max(weight) OVER () - min(weight) OVER ()), 0.05E0) END AS weight FROM raw)"""


def flow_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights.normalize_weights(weights.mean_magnitude(view(spark, sf_dir, "flows"), FLOW_FEATURES))


@query("weight_normalize", with_views("flows", rest=WEIGHTS_SQL) + f"SELECT feature, {r6('weight')} AS weight FROM weights")
def weight_normalize(spark, sf_dir):
    return round_doubles(flow_weights(spark, sf_dir))


@query(
    "weight_align",
    with_views("flows", rest=WEIGHTS_SQL)
    + f"""SELECT CAST(n.ord AS INTEGER) AS ord, n.feature, {r6('coalesce(w.weight, (SELECT avg(weight) FROM weights))')} AS weight
FROM (VALUES (0, 'f_new'), (1, 'f_price'), (2, 'f_qty'), (3, 'f_tax')) AS n(ord, feature) LEFT JOIN weights w USING (feature)""",
)
def weight_align(spark, sf_dir):
    return round_doubles(weights.align_weights(["f_new", "f_price", "f_qty", "f_tax"], flow_weights(spark, sf_dir)))


@query(
    "weight_apply",
    with_views("flows", rest=WEIGHTS_SQL)
    + "SELECT row_key, "
    + ", ".join(f"{r6(f + f' * (SELECT weight FROM weights WHERE feature = {chr(39)}{f}{chr(39)})')} AS {f}" for f in FLOW_FEATURES)
    + " FROM flows",
)
def weight_apply(spark, sf_dir):
    table = weights.apply_weights(view(spark, sf_dir, "flows"), weights.weight_map(flow_weights(spark, sf_dir)))
    return round_doubles(table.drop("label"))


@query(
    "top_features",
    with_views("flows", rest=WEIGHTS_SQL) + f"SELECT feature, {r6('weight')} AS weight FROM weights ORDER BY weights.weight DESC, feature LIMIT 2",
)
def top_features(spark, sf_dir):
    return round_doubles(weights.top_features(flow_weights(spark, sf_dir), 2))


# ---- signals -------------------------------------------------------------------------------------

DECODED = "({f} * 0.9 + 0.01)"


@query(
    "reconstruction_error",
    with_views("vectors")
    + "SELECT row_key, "
    + r6("(" + " + ".join(f"({f} - {DECODED.format(f=f)}) * ({f} - {DECODED.format(f=f)}) * {(i + 1) / 64}" for i, f in enumerate(VECTOR_FEATURES)) + ") / 64")
    + " AS rec_error FROM vectors",
)
def reconstruction_error(spark, sf_dir):
    rows = view(spark, sf_dir, "vectors")
    x = F.array(*VECTOR_FEATURES)
    rebuilt = F.array(*[F.col(f) * F.lit(0.9) + F.lit(0.01) for f in VECTOR_FEATURES])
    feature_weights = [(i + 1) / 64 for i in range(64)]
    table = rows.select("row_key", x.alias("x"), rebuilt.alias("rebuilt"))
    return table.select("row_key", rounded(error_term("x", "rebuilt", feature_weights)).alias("rec_error"))


SIGNALS_SQL = """signals AS (SELECT row_key, label, y, score AS clf_score, rec_error FROM scored),
ranges AS (SELECT min(clf_score) AS c0, max(clf_score) AS c1, min(rec_error) AS r0, max(rec_error) AS r1 FROM signals),
dual AS (SELECT signals.*, (0.6 * (clf_score - c0) / (c1 - c0) + 0.4 * (rec_error - r0) / (r1 - r0)) / (0.6 + 0.4) AS dual_score
  FROM signals, ranges),
benign_ranges AS (SELECT min(clf_score) AS c0, max(clf_score) AS c1, min(rec_error) AS r0, max(rec_error) AS r1 FROM signals
  WHERE label = 'benign'),
threshold AS (SELECT quantile_cont((0.6 * (clf_score - c0) / (c1 - c0) + 0.4 * (rec_error - r0) / (r1 - r0)) / (0.6 + 0.4), 0.95)
  AS threshold FROM signals, benign_ranges WHERE label = 'benign'),
fitted AS (SELECT row_key, (0.6 * least(greatest((clf_score - c0) / (c1 - c0), 0), 1) +
  0.4 * least(greatest((rec_error - r0) / (r1 - r0), 0), 1)) / (0.6 + 0.4) AS dual_fitted FROM signals, benign_ranges),
fused AS (SELECT *, 1 / (1 + exp(-(-3.5 + 4.0 * clf_score + 1.5 * rec_error + 2.0 * dual_score))) AS p FROM dual)"""


def signal_sql(rest: str, more: str = "") -> str:
    return with_views("scored", rest=f"{SIGNALS_SQL}, {more}" if more else SIGNALS_SQL) + rest


@query(
    "minmax_normalize",
    signal_sql(
        f"SELECT row_key, {r6('(clf_score - c0) / (c1 - c0)')} AS clf_norm, {r6('(rec_error - r0) / (r1 - r0)')} AS rec_norm FROM signals, ranges"
    ),
)
def minmax_normalize(spark, sf_dir):
    rows = signals(spark, sf_dir)
    found = scoring.signal_range(rows, "clf_score", "rec_error")
    return rows.select(
        "row_key",
        rounded(scoring.normalized("clf_score", *found.clf)).alias("clf_norm"),
        rounded(scoring.normalized("rec_error", *found.rec)).alias("rec_norm"),
    )


def dual_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.with_dual_score(signals(spark, sf_dir), "clf_score", "rec_error")


@query("dual_score", signal_sql(f"SELECT row_key, {r6('dual_score')} AS dual_score FROM dual"))
def dual_score(spark, sf_dir):
    return round_doubles(dual_rows(spark, sf_dir).select("row_key", "dual_score"))


@query(
    "dual_threshold",
    signal_sql(
        f"""SELECT {r6('threshold')} AS threshold, CAST((SELECT count(*) FROM signals WHERE label = 'benign') AS BIGINT) AS reference_rows
FROM threshold"""
    ),
)
def dual_threshold(spark, sf_dir):
    reference = signals(spark, sf_dir).where("label = 'benign'")
    threshold = scoring.fit_threshold(reference, "clf_score", "rec_error")
    return reference.agg(F.count("*").alias("reference_rows")).withColumn("threshold", rounded(F.lit(threshold)))


@query("dual_predict", signal_sql("SELECT row_key, CAST(dual_score >= threshold AS INTEGER) AS anomaly FROM dual, threshold"))
def dual_predict(spark, sf_dir):
    rows = signals(spark, sf_dir)
    threshold = scoring.fit_threshold(rows.where("label = 'benign'"), "clf_score", "rec_error")
    scored = scoring.with_dual_score(rows, "clf_score", "rec_error")
    return scored.select("row_key", scoring.anomaly_flag("dual_score", threshold).alias("anomaly"))


@query(
    "class_weights",
    with_views("scored") + f"SELECT label, {r6('(SELECT count(*) FROM scored) / (3E0 * count(*))')} AS weight FROM scored GROUP BY label",
)
def class_weights(spark, sf_dir):
    return round_doubles(balanced_weights(signals(spark, sf_dir), "label"))


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.fuse(dual_rows(spark, sf_dir), FUSION_WEIGHTS, FUSION_INTERCEPT)


@query("fusion_score", signal_sql(f"SELECT row_key, {r6('p')} AS probability, CAST(p >= 0.5 AS INTEGER) AS prediction FROM fused"))
def fusion_score(spark, sf_dir):
    return fused(spark, sf_dir).select("row_key", rounded("fusion_probability").alias("probability"), "prediction")


@query(
    "score_batch_modes",
    signal_sql(
        f"""SELECT row_key, 0E0 AS dual_row, {r6('dual_score')} AS dual_batch, {r6('dual_fitted')} AS dual_fitted
FROM dual JOIN fitted USING (row_key)"""
    ),
)
def score_batch_modes(spark, sf_dir):
    rows = signals(spark, sf_dir)
    stored = scoring.signal_range(rows.where("label = 'benign'"), "clf_score", "rec_error")
    table = scoring.with_dual_score(rows, "clf_score", "rec_error", "row").withColumnRenamed("dual_score", "dual_row")
    table = scoring.with_dual_score(table, "clf_score", "rec_error", "batch").withColumnRenamed("dual_score", "dual_batch")
    table = scoring.with_dual_score(table, "clf_score", "rec_error", "fitted", stored).withColumnRenamed("dual_score", "dual_fitted")
    return round_doubles(table.select("row_key", "dual_row", "dual_batch", "dual_fitted"))


@query(
    "score_summary",
    signal_sql(
        f"""SELECT label, CAST(count(*) AS BIGINT) AS total_items, CAST(count(*) FILTER (WHERE p >= 0.5) AS BIGINT) AS attack_count,
  CAST(count(*) FILTER (WHERE p < 0.5) AS BIGINT) AS benign_count, {r6('avg(p)')} AS mean_confidence FROM fused GROUP BY label"""
    ),
)
def score_summary(spark, sf_dir):
    return round_doubles(scoring.score_summary(fused(spark, sf_dir), ["label"]))


# ---- requests ------------------------------------------------------------------------------------

ITEMS_SQL = """items AS (
  SELECT request_id, 0 AS item_no, CAST(k AS DOUBLE) AS f_k, CAST(client AS DOUBLE) AS f_user FROM requests
  UNION ALL SELECT request_id, 1, CAST(client AS DOUBLE), CAST(NULL AS DOUBLE) FROM requests WHERE request_id % 3 > 0
  UNION ALL SELECT request_id, 2, CAST(k + client AS DOUBLE), CAST(k AS DOUBLE) FROM requests WHERE request_id % 3 > 1)"""
K_SQL = "requests AS (SELECT event_id AS request_id, user_id AS client, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"


def request_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request bodies of one to three items; the second item lacks a feature and carries an extra one."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "event_id AS request_id", "user_id AS client", "CAST(get_json_object(props, '$.k') AS INT) AS k"
    )
    bodies = events.selectExpr(
        "request_id",
        """concat('[{"f_k":', k, ',"f_user":', client, '}',
          CASE WHEN request_id % 3 > 0 THEN concat(',{"f_k":', client, ',"extra":1}') ELSE '' END,
          CASE WHEN request_id % 3 > 1 THEN concat(',{"f_k":', k + client, ',"f_user":', k, '}') ELSE '' END, ']') AS body""",
    )
    return scoring.explode_requests(bodies)


@query(
    "request_explode",
    with_views(rest=f"{K_SQL}, {ITEMS_SQL}")
    + "SELECT request_id, item_no, f_k, f_user, CASE WHEN item_no = 1 THEN 1E0 END AS extra FROM items",
)
def request_explode(spark, sf_dir):
    items = request_items(spark, sf_dir)
    return items.select(
        "request_id", "item_no", *[F.try_element_at("features", F.lit(n)).alias(n) for n in ("f_k", "f_user", "extra")]
    )


@query(
    "request_align",
    with_views(rest=f"{K_SQL}, {ITEMS_SQL}")
    + """SELECT request_id, item_no, f_user, f_k, CASE WHEN item_no = 1 THEN 'f_user,f_hour' ELSE 'f_hour' END AS missing FROM items""",
)
def request_align(spark, sf_dir):
    aligned = scoring.align_request(request_items(spark, sf_dir), ["f_user", "f_k", "f_hour"], strict=False)
    return aligned.select("request_id", "item_no", "f_user", "f_k", F.array_join("missing", ",").alias("missing"))


def request_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = request_items(spark, sf_dir).select("request_id", "item_no", F.try_element_at("features", F.lit("f_k")).alias("f_k"))
    rows = items.select(
        "request_id", "item_no", (F.col("f_k") * 0.01).alias("clf_score"), F.lit(0.0).alias("rec_error")
    )
    return scoring.fuse(scoring.with_dual_score(rows, "clf_score", "rec_error", "row"), (5.0, 0.0, 0.0), -3.0)


@query(
    "score_response",
    with_views(rest=f"{K_SQL}, {ITEMS_SQL}, scored_items AS (SELECT *, 1 / (1 + exp(-(-3.0 + 5.0 * (f_k * 0.01)))) AS p FROM items)")
    + f"""SELECT request_id, 'hybrid-v1' AS model_version, CAST(count(*) AS BIGINT) AS batch_size,
  string_agg(CASE WHEN p >= 0.5 THEN 'attack' ELSE 'benign' END, ',' ORDER BY item_no) AS labels, {r6('sum(p)')} AS confidence_sum
FROM scored_items GROUP BY request_id""",
)
def score_response(spark, sf_dir):
    responses = scoring.score_responses(request_predictions(spark, sf_dir), "request_id", "hybrid-v1")
    total = F.aggregate("items", F.lit(0.0), lambda acc, i: acc + i["confidence"])
    return responses.select(
        "request_id",
        "model_version",
        "batch_size",
        F.array_join("items.predicted_label", ",").alias("labels"),
        rounded(total).alias("confidence_sum"),
    )


@query(
    "requests_by_status",
    with_views("request_log") + "SELECT endpoint, status, CAST(count(*) AS BIGINT) AS requests FROM request_log GROUP BY endpoint, status",
)
def requests_by_status(spark, sf_dir):
    return monitor.requests_by_status(view(spark, sf_dir, "request_log"))


BUCKETS_SQL = ", ".join(f"('{'+Inf' if b == float('inf') else b}', {'CAST(1e308 AS DOUBLE)' if b == float('inf') else f'{b}E0'})" for b in monitor.LATENCY_BUCKETS)


@query(
    "latency_histogram",
    with_views("request_log")
    + f"""SELECT endpoint, b.le, CAST(count(*) FILTER (WHERE latency_ms / 1000.0 <= b.bound) AS BIGINT) AS requests,
  {r6('sum(latency_ms / 1000.0)')} AS latency_sum, CAST(count(latency_ms) AS BIGINT) AS latency_count
FROM request_log, (VALUES {BUCKETS_SQL}) AS b(le, bound) GROUP BY endpoint, b.le""",
)
def latency_histogram(spark, sf_dir):
    return round_doubles(monitor.latency_histogram(view(spark, sf_dir, "request_log")))


SLO_SQL = """slo AS (SELECT c.name AS "check", c.observed, c.target, c.upper, CASE WHEN c.upper THEN c.observed <= c.target
  ELSE c.observed >= c.target END AS passed FROM (
  SELECT 'latency_p50_ms' AS name, quantile_cont(latency_ms, 0.5) AS observed, 20E0 AS target, true AS upper FROM request_log
  UNION ALL SELECT 'latency_p95_ms', quantile_cont(latency_ms, 0.95), 50E0, true FROM request_log
  UNION ALL SELECT 'latency_p99_ms', quantile_cont(latency_ms, 0.99), 100E0, true FROM request_log
  UNION ALL SELECT 'error_rate', avg(CASE WHEN status >= 500 THEN 1E0 ELSE 0E0 END), 0.02E0, true FROM request_log
  UNION ALL SELECT 'throughput_rps', count(*) / greatest((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 1), 1000E0, false FROM request_log
  UNION ALL SELECT 'mean_confidence', avg(confidence), 0.55E0, false FROM request_log) AS c)"""


@query(
    "slo_check",
    with_views("request_log", rest=SLO_SQL) + f'SELECT "check", {r6("observed")} AS observed, target, passed FROM slo',
)
def slo_check(spark, sf_dir):
    return round_doubles(monitor.slo_check(view(spark, sf_dir, "request_log")).drop("upper"))


@query(
    "alerts",
    with_views("request_log", rest=SLO_SQL)
    + f"""SELECT 'performance_degradation' AS kind, CASE WHEN upper AND observed > target * 2 OR NOT upper AND observed * 2 < target
  THEN 'critical' ELSE 'warning' END AS severity_level, "check", {r6("observed")} AS observed, target FROM slo WHERE NOT passed""",
)
def alerts(spark, sf_dir):
    return round_doubles(monitor.alerts(monitor.slo_check(view(spark, sf_dir, "request_log"))))
