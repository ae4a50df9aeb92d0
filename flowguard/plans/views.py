"""Deterministic traffic-like views over the given tables, for Spark and for the DuckDB check."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
TRAFFIC_FEATURES = ["f_value", "f_user", "f_hour", "f_k", "f_const"]
FLOW_FEATURES = ["f_qty", "f_price", "f_disc", "f_tax"]
VECTOR_FEATURES = [f"f{i}" for i in range(64)]

_TRAFFIC = """
SELECT event_id AS row_key,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS f_value,
  CAST(user_id AS DOUBLE) AS f_user,
  CAST(hour(ts) AS DOUBLE) AS f_hour,
  CAST({k} AS DOUBLE) AS f_k,
  CAST(1 AS DOUBLE) AS f_const,
  CASE event_type WHEN 'view' THEN 'benign' WHEN 'click' THEN 'gafgyt_click' WHEN 'error' THEN 'gafgyt_error'
    WHEN 'purchase' THEN 'mirai_purchase' ELSE 'mirai_signup' END AS label,
  CASE event_type WHEN 'view' THEN 'benign' WHEN 'click' THEN 'gafgyt' WHEN 'error' THEN 'gafgyt' ELSE 'mirai' END
    AS attack_family,
  CASE event_type WHEN 'view' THEN 'device_a/benign_traffic.csv' WHEN 'click' THEN 'device_a/gafgyt_attacks/click.csv'
    WHEN 'error' THEN 'device_a/gafgyt_attacks/error.csv' WHEN 'purchase' THEN 'device_a/mirai_attacks/purchase.csv'
    ELSE 'device_a/mirai_attacks/signup.csv' END AS source_path
FROM {events}"""

_FLOWS = """
SELECT md5(concat_ws('|', CAST(l_orderkey AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING),
    CAST(l_linenumber AS STRING), CAST(CAST(l_quantity AS INT) AS STRING),
    CAST(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS STRING))) AS row_key,
  l_quantity + 0.0 AS f_qty, l_extendedprice + 0.0 AS f_price, l_discount + 0.0 AS f_disc, l_tax + 0.0 AS f_tax,
  CASE l_returnflag WHEN 'N' THEN 'benign' WHEN 'A' THEN 'gafgyt_a' ELSE 'mirai_r' END AS label
FROM {lineitem}"""

# Predictions by fixed rules over the row: the true class in four of five rows, else the next class.
_SCORED = """
SELECT row_key, label, y, score, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS pred, label_id, pred_label_id,
  CASE WHEN pred_label_id = 0 THEN 0.8E0 ELSE 0.1E0 END AS p0, CASE WHEN pred_label_id = 1 THEN 0.8E0 ELSE 0.1E0 END AS p1,
  CASE WHEN pred_label_id = 2 THEN 0.8E0 ELSE 0.1E0 END AS p2, f_price / 100000 AS rec_error, f_disc
FROM (
  SELECT row_key, label, y, f_price, f_disc,
    (f_qty + CASE WHEN y = 1 THEN 25 ELSE 0 END) / 75 AS score, label_id,
    CASE WHEN CAST(f_qty AS INT) % 5 = 4 THEN (label_id + 1) % 3 ELSE label_id END AS pred_label_id
  FROM (
    SELECT row_key, label, f_qty, f_price, f_disc, CASE WHEN label = 'mirai_r' THEN 1 ELSE 0 END AS y,
      CASE label WHEN 'benign' THEN 0 WHEN 'gafgyt_a' THEN 1 ELSE 2 END AS label_id
    FROM {flows}) AS labelled) AS predicted"""

_REQUEST_LOG = """
SELECT event_id AS request_id, CAST(ts AS TIMESTAMP) AS ts, user_id AS client,
  CASE WHEN user_id % 2 = 0 THEN 'single' ELSE 'batch' END AS endpoint,
  CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, value AS latency_ms,
  CAST({k} AS DOUBLE) / 99 AS confidence
FROM {events}"""

_TIMED_TRAFFIC = """
SELECT CAST(ts AS TIMESTAMP) AS ts, CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS f_value,
  CAST({k} AS DOUBLE) AS f_k
FROM {events}"""

# One experiment report per client: model qualities are shares of that client's own events.
_EXPERIMENTS = """
SELECT concat('run_', CAST(user_id AS STRING)) AS run_name, user_id,
  1 - avg(CASE WHEN event_type = 'error' THEN 1.0E0 ELSE 0.0E0 END) AS baseline_f1_weighted,
  1 - avg(CASE WHEN event_type = 'signup' THEN 1.0E0 ELSE 0.0E0 END) AS hybrid_f1,
  1 - avg(CASE WHEN CAST({k} AS INT) < 12 + (user_id % 4) * 6 THEN 1.0E0 ELSE 0.0E0 END) AS fusion_f1,
  CASE WHEN user_id % 3 = 0 THEN NULL ELSE 1 - avg(CASE WHEN CAST({k} AS INT) < 10 THEN 1.0E0 ELSE 0.0E0 END) END
    AS fusion_auroc,
  CASE WHEN user_id % 2 = 0 THEN 1 - avg(CASE WHEN CAST({k} AS INT) < 15 THEN 1.0E0 ELSE 0.0E0 END) ELSE NULL END
    AS fusion_auroc_ovr_weighted,
  CAST(count(*) AS BIGINT) AS n_rows
FROM {events} GROUP BY user_id"""

# One leave-one-attack-out run per client and attack that reached a high k; some clients have few runs or none.
_LOAO_RUNS = """
SELECT concat('run_', CAST(user_id AS STRING)) AS run_name, event_type AS held_out_attack,
  1 - avg(CASE WHEN CAST({k} AS INT) < 30 THEN 1.0E0 ELSE 0.0E0 END) AS f1,
  avg(CAST({k} AS DOUBLE)) / 99 AS attack_rate_pred, CAST(count(*) AS BIGINT) AS heldout_rows
FROM {events} WHERE event_type <> 'view' GROUP BY user_id, event_type HAVING max(CAST({k} AS INT)) >= 90"""

# Reference (before noon) and current (from noon on) quality of each client.
_METRIC_PAIRS = """
SELECT user_id,
  1 - avg(CASE WHEN hour(ts) < 12 THEN CASE WHEN event_type = 'error' THEN 1.0E0 ELSE 0.0E0 END END) AS ref_f1_weighted,
  1 - avg(CASE WHEN hour(ts) < 12 THEN CASE WHEN CAST({k} AS INT) < 20 THEN 1.0E0 ELSE 0.0E0 END END) AS ref_f1,
  1 - avg(CASE WHEN hour(ts) < 12 THEN CASE WHEN CAST({k} AS INT) < 10 THEN 1.0E0 ELSE 0.0E0 END END) AS ref_auroc,
  avg(CASE WHEN hour(ts) < 12 THEN CAST({k} AS DOUBLE) / 99 END) AS ref_confidence_mean,
  CASE WHEN user_id % 2 = 0 THEN
    1 - avg(CASE WHEN hour(ts) >= 12 THEN CASE WHEN event_type = 'error' THEN 1.0E0 ELSE 0.0E0 END END) END
    AS cur_f1_weighted,
  1 - avg(CASE WHEN hour(ts) >= 12 THEN CASE WHEN CAST({k} AS INT) < 20 THEN 1.0E0 ELSE 0.0E0 END END) AS cur_f1,
  1 - avg(CASE WHEN hour(ts) >= 12 THEN CASE WHEN CAST({k} AS INT) < 10 THEN 1.0E0 ELSE 0.0E0 END END) AS cur_auroc,
  avg(CASE WHEN hour(ts) >= 12 THEN CAST({k} AS DOUBLE) / 99 END) AS cur_confidence_mean
FROM {events} GROUP BY user_id"""

# Raw text cells with the faults a strict schema must report.
_DIRTY = """
SELECT row_key, CASE WHEN label = 'mirai_signup' AND f_k < 5 THEN 'abc' ELSE CAST(CAST(f_k AS INT) AS STRING) END AS c_k,
  CASE WHEN label = 'gafgyt_error' AND f_k > 95 THEN 'Infinity' WHEN label = 'benign' AND f_k > 95 THEN '-Infinity'
    WHEN label = 'gafgyt_click' AND f_k > 95 THEN 'NaN' WHEN f_value IS NULL THEN NULL
    ELSE CAST(CAST(f_user AS INT) AS STRING) END AS c_user,
  CASE WHEN f_k = 50 AND f_hour = 3 THEN NULL ELSE label END AS label,
  CASE WHEN f_k = 51 AND f_hour = 3 THEN NULL ELSE attack_family END AS attack_family,
  CASE WHEN f_k = 52 AND f_hour = 3 THEN NULL ELSE source_path END AS source_file
FROM {traffic}"""

_EVENT_VIEWS = {
    "traffic": _TRAFFIC,
    "timed_traffic": _TIMED_TRAFFIC,
    "request_log": _REQUEST_LOG,
    "experiments": _EXPERIMENTS,
    "loao_runs": _LOAO_RUNS,
    "metric_pairs": _METRIC_PAIRS,
}


def _vectors(first: int, source: str) -> str:
    cells = ", ".join(f"CAST(embedding[{first + i}] AS DOUBLE) AS f{i}" for i in range(64))
    return (
        f"SELECT vec_id AS row_key, {cells}, CASE WHEN label = 0 THEN 'benign' WHEN label <= 4 THEN "
        f"concat('gafgyt_', CAST(label AS STRING)) ELSE concat('mirai_', CAST(label AS STRING)) END AS label "
        f"FROM {source}"
    )


def _text(name: str, k: str, base: dict[str, str], first: int) -> str:
    if name in _EVENT_VIEWS:
        return _EVENT_VIEWS[name].format(k=k, events=base["events"])
    if name == "flows":
        return _FLOWS.format(lineitem=base["lineitem"])
    if name == "vectors":
        return _vectors(first, base["embeddings"])
    if name == "scored":
        return _SCORED.format(flows=f"({_text('flows', k, base, first)}) AS flows")
    if name == "dirty":
        return _DIRTY.format(traffic=f"({_text('traffic', k, base, first)}) AS traffic")
    raise KeyError(name)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in ("events", "lineitem", "embeddings")}
    return spark.sql(_text(name, "get_json_object(props, '$.k')", base, 0))


def stream_view(spark: SparkSession, sf_dir: str, name: str, copies: int = 1) -> DataFrame:
    """An event view over a file stream of the events; ``copies`` replays every event that often."""
    if name not in _EVENT_VIEWS:
        raise KeyError(f"{name} is not a view over the events")

    def source() -> DataFrame:
        return spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", "events.parquet").parquet(sf_dir)

    rows = source()
    for _ in range(copies - 1):
        rows = rows.unionByName(source())
    temporary = f"events_stream_{uuid.uuid4().hex}"
    rows.createOrReplaceTempView(temporary)
    return spark.sql(_text(name, "get_json_object(props, '$.k')", {"events": temporary}, 0))


def duckdb_view(name: str) -> str:
    """The same view as a DuckDB subquery over the pre-registered tables."""
    base = {t: t for t in ("events", "lineitem", "embeddings")}
    return _text(name, "json_extract_string(props, '$.k')", base, 1)


def with_views(*names: str, rest: str = "") -> str:
    """A DuckDB ``WITH`` clause that defines the views, plus further named queries."""
    parts = [f"{n} AS ({duckdb_view(n)})" for n in names]
    if rest:
        parts.append(rest)
    return "WITH " + ", ".join(parts) + " "
