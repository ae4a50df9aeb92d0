"""Streaming jobs, each drained once and compared with the batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowguard.catalog.data import CSV_COLUMNS, PATH_SQL, as_doubles, traffic_tree
from flowguard.catalog.evaluate import round_doubles
from flowguard.catalog.registration import query, r6
from flowguard.catalog.scoring import FUSION_INTERCEPT, FUSION_WEIGHTS
from flowguard.functions.columns import rounded
from flowguard.operators import drift, scoring
from flowguard.plans.views import stream_view, view, with_views
from flowguard.streaming import jobs


def epoch_seconds(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.unix_micros(c) for c in columns})


@query(
    "stream_ingest",
    with_views("traffic")
    + "SELECT "
    + ", ".join(f"CAST(CAST({f} AS FLOAT) AS DOUBLE) AS {f}" for f in CSV_COLUMNS)
    + f", {PATH_SQL} FROM traffic",
)
def stream_ingest(spark, sf_dir):
    benign, _ = traffic_tree(spark, sf_dir)
    root = benign.rsplit("/", 1)[0]
    stream = jobs.csv_stream(spark, root, CSV_COLUMNS, max_files_per_trigger=2)
    return as_doubles(jobs.write_available(stream, "stream-ingest"), *CSV_COLUMNS)


RANGE = scoring.SignalRange((0.0, 0.99), (0.0, 1.0))


@query(
    "stream_score",
    with_views("traffic")
    + f"""SELECT row_key, label, {r6('dual')} AS anomaly_score,
  {r6('1 / (1 + exp(-(-3.5 + 4.0 * clf + 1.5 * rec + 2.0 * dual)))')} AS confidence,
  CAST(1 / (1 + exp(-(-3.5 + 4.0 * clf + 1.5 * rec + 2.0 * dual))) >= 0.5 AS INTEGER) AS prediction
FROM (SELECT *, (0.6 * least(greatest(clf / 0.99, 0), 1) + 0.4 * least(greatest(rec, 0), 1)) / (0.6 + 0.4) AS dual
  FROM (SELECT row_key, label, f_k / 100 AS clf, coalesce(f_value, 0) / 100 AS rec FROM traffic))""",
)
def stream_score(spark, sf_dir):
    rows = stream_view(spark, sf_dir, "traffic").select(
        "row_key",
        "label",
        (F.col("f_k") / F.lit(100.0)).alias("clf_score"),
        (F.coalesce("f_value", F.lit(0.0)) / F.lit(100.0)).alias("rec_error"),
    )
    scored = jobs.scored_stream(rows, "clf_score", "rec_error", RANGE, FUSION_WEIGHTS, FUSION_INTERCEPT)
    written = jobs.write_available(scored.select("row_key", "label", "anomaly_score", "confidence", "prediction"), "stream-score")
    return round_doubles(written)


METRICS_SQL = f"""CAST(count(*) AS BIGINT) AS requests, CAST(count(*) FILTER (WHERE status >= 500) AS BIGINT) AS errors,
  max(latency_ms) AS max_latency_ms, {r6('avg(latency_ms)')} AS mean_latency_ms"""


def windowed(spark: SparkSession, sf_dir: str, size: str, slide: str | None, name: str) -> DataFrame:
    log = stream_view(spark, sf_dir, "request_log")
    written = jobs.write_complete(jobs.windowed_requests(log, size, slide, delay=None), name)
    return epoch_seconds(written, "window_start", "window_end").withColumns(
        {"mean_latency_ms": rounded("mean_latency_ms"), "max_latency_ms": rounded("max_latency_ms")}
    )


@query(
    "window_metrics_tumbling",
    with_views("request_log")
    + f"""SELECT CAST(epoch_us(window_start) AS BIGINT) AS window_start, CAST(epoch_us(window_end) AS BIGINT) AS window_end, endpoint, requests,
  errors, {r6('max_latency_ms')} AS max_latency_ms, mean_latency_ms FROM (
  SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, endpoint,
  {METRICS_SQL} FROM request_log GROUP BY 1, 2, 3)""",
)
def window_metrics_tumbling(spark, sf_dir):
    return windowed(spark, sf_dir, "1 hour", None, "window-tumbling")


@query(
    "window_metrics_sliding",
    with_views("request_log")
    + f"""SELECT CAST(epoch_us(window_start) AS BIGINT) AS window_start, CAST(epoch_us(window_end) AS BIGINT) AS window_end, endpoint, requests,
  errors, {r6('max_latency_ms')} AS max_latency_ms, mean_latency_ms FROM (
  SELECT window_start, window_start + INTERVAL 6 HOUR AS window_end, endpoint, {METRICS_SQL} FROM (
    SELECT *, time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL (2 * i) HOUR AS window_start
    FROM request_log, (VALUES (0), (1), (2)) AS back(i)) GROUP BY window_start, endpoint)""",
)
def window_metrics_sliding(spark, sf_dir):
    return windowed(spark, sf_dir, "6 hours", "2 hours", "window-sliding")


@query(
    "session_metrics",
    with_views(
        "request_log",
        rest="""marked AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY client ORDER BY ts, request_id) + INTERVAL 6 HOUR
    THEN 0 ELSE 1 END AS fresh FROM request_log),
sessions AS (SELECT *, sum(fresh) OVER (PARTITION BY client ORDER BY ts, request_id ROWS UNBOUNDED PRECEDING) AS session FROM marked)""",
    )
    + """SELECT client, CAST(epoch_us(session_start) AS BIGINT) AS session_start, CAST(epoch_us(session_end) AS BIGINT) AS session_end,
  requests, errors FROM (SELECT client, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end,
    CAST(count(*) AS BIGINT) AS requests, CAST(count(*) FILTER (WHERE status >= 500) AS BIGINT) AS errors
  FROM sessions GROUP BY client, session)""",
)
def session_metrics(spark, sf_dir):
    log = stream_view(spark, sf_dir, "request_log")
    sessions = jobs.write_complete(jobs.client_sessions(log, "6 hours", delay=None), "sessions")
    return epoch_seconds(sessions, "session_start", "session_end")


@query(
    "stream_dedup",
    with_views("request_log") + "SELECT request_id, client, endpoint, status FROM request_log",
)
def stream_dedup(spark, sf_dir):
    replayed = stream_view(spark, sf_dir, "request_log", copies=2)
    unique = jobs.without_replays(replayed).select("request_id", "client", "endpoint", "status")
    return jobs.write_available(unique, "stream-dedup")


PSI_FEATURES = ["f_value", "f_k"]


def psi_window_sql(f: str) -> str:
    return f"""SELECT day, '{f}' AS feature, sum((c - r) * ln(c / r)) AS psi FROM (
  SELECT d.day, CASE WHEN b.nr = 0 THEN 0.0001E0 ELSE b.nr / greatest(b.total, 1) END AS r,
    CASE WHEN coalesce(k.n, 0) = 0 THEN 0.0001E0 ELSE k.n / greatest(sum(k.n) OVER (PARTITION BY d.day), 1) END AS c
  FROM (SELECT DISTINCT day FROM live) AS d CROSS JOIN
    (SELECT g.i, CAST(count(t.{f}) AS DOUBLE) AS nr, CAST(sum(count(t.{f})) OVER () AS DOUBLE) AS total
     FROM edges_{f} e CROSS JOIN (SELECT unnest(range(1, 11)) AS i) g
     LEFT JOIN early t ON t.{f} >= e.edges[g.i] AND (t.{f} < e.edges[g.i + 1] OR (g.i = len(e.edges) - 1 AND t.{f} = e.edges[g.i + 1]))
     WHERE g.i < len(e.edges) GROUP BY g.i) AS b
  LEFT JOIN (SELECT day, g.i, CAST(count(*) AS DOUBLE) AS n FROM edges_{f} e CROSS JOIN (SELECT unnest(range(1, 11)) AS i) g
     JOIN live t ON t.{f} >= e.edges[g.i] AND (t.{f} < e.edges[g.i + 1] OR (g.i = len(e.edges) - 1 AND t.{f} = e.edges[g.i + 1]))
     WHERE g.i < len(e.edges) GROUP BY day, g.i) AS k ON k.day = d.day AND k.i = b.i) GROUP BY day"""


def edge_sql(f: str) -> str:
    levels = ", ".join(str(i / 10) for i in range(11))
    return f"edges_{f} AS (SELECT list_sort(list_distinct(quantile_cont({f}, [{levels}]))) AS edges FROM early)"


@query(
    "window_psi",
    with_views(
        "traffic",
        rest=", ".join(
            [
                "early AS (SELECT * FROM traffic WHERE f_hour < 12)",
                "live AS (SELECT traffic.*, date_trunc('day', ts) AS day FROM traffic JOIN events ON event_id = row_key)",
                *[edge_sql(f) for f in PSI_FEATURES],
            ]
        ),
    )
    + f"""SELECT CAST(epoch_us(CAST(day AS TIMESTAMP)) AS BIGINT) AS window_start, feature, {r6('psi')} AS psi
FROM ({' UNION ALL '.join(psi_window_sql(f) for f in PSI_FEATURES)})""",
)
def window_psi(spark, sf_dir):
    early = view(spark, sf_dir, "traffic").where("f_hour < 12")
    edges = drift.psi_edges(early, PSI_FEATURES)
    live = stream_view(spark, sf_dir, "timed_traffic")
    bins = jobs.write_complete(jobs.windowed_bins(live, edges, "1 day", delay=None), "window-psi")
    table = jobs.window_psi(bins, early, edges)
    return epoch_seconds(table, "window_start").withColumn("psi", rounded("psi"))
