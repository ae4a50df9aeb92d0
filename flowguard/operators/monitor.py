"""Request monitoring over a log of requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowguard.config import SloPolicy
from flowguard.operators.quantiles import EXACT_ROWS, exact_quantiles

# Cumulative latency buckets in seconds, alert kinds and levels.
LATENCY_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0, float("inf"))
ALERT_KIND = "performance_degradation"
WARNING, CRITICAL = "warning", "critical"
CRITICAL_FACTOR = 2.0


def requests_by_status(log: DataFrame) -> DataFrame:
    return log.groupBy("endpoint", "status").agg(F.count("*").alias("requests"))


def latency_histogram(log: DataFrame, buckets: Sequence[float] = LATENCY_BUCKETS) -> DataFrame:
    """Cumulative counts per endpoint and bucket, with the endpoint's sum and count in seconds."""
    seconds = F.col("latency_ms") / F.lit(1000.0)
    wide = log.groupBy("endpoint").agg(
        *[F.count_if(seconds <= F.lit(b)).alias(f"b{i}") for i, b in enumerate(buckets)],
        F.sum(seconds).alias("latency_sum"),
        F.count("latency_ms").alias("latency_count"),
    )
    cells = ", ".join(f"'{'+Inf' if b == float('inf') else b}', b{i}" for i, b in enumerate(buckets))
    return wide.selectExpr("endpoint", f"stack({len(buckets)}, {cells}) AS (le, requests)", "latency_sum", "latency_count")


def slo_check(log: DataFrame, policy: SloPolicy = SloPolicy(), exact_rows: int = EXACT_ROWS) -> DataFrame:
    """(check, observed, target, passed) of latency percentiles, error rate, throughput and confidence."""
    latency = exact_quantiles(log.select("latency_ms"), ["latency_ms"], [0.5, 0.95, 0.99], exact_rows)["latency_ms"]
    if latency is None:
        raise ValueError("the request log has no latencies")
    targets = [
        ("latency_p50_ms", F.lit(latency[0]), policy.p50_ms, True),
        ("latency_p95_ms", F.lit(latency[1]), policy.p95_ms, True),
        ("latency_p99_ms", F.lit(latency[2]), policy.p99_ms, True),
        ("error_rate", F.avg((F.col("status") >= 500).cast("double")), policy.error_rate, True),
        ("throughput_rps", F.count("*") / F.greatest(_seconds(), F.lit(1.0)), policy.throughput_rps, False),
        ("mean_confidence", F.coalesce(F.avg("confidence"), F.lit(0.0)), policy.confidence, False),
    ]
    row = log.agg(*[c.alias(n) for n, c, _, _ in targets])
    cells = ", ".join(f"'{n}', `{n}`, {t}D, {'true' if upper else 'false'}" for n, _, t, upper in targets)
    long = row.selectExpr(f"stack({len(targets)}, {cells}) AS (check, observed, target, upper)")
    passed = F.when(F.col("upper"), F.col("observed") <= F.col("target")).otherwise(F.col("observed") >= F.col("target"))
    return long.select("check", "observed", "target", passed.alias("passed"), "upper")


def _seconds() -> Column:
    return (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))).cast("double") / 1e6


def alerts(checks: DataFrame) -> DataFrame:
    """One row per failed check; critical when the target is missed by a factor of two."""
    far = F.when(F.col("upper"), F.col("observed") > F.col("target") * CRITICAL_FACTOR).otherwise(
        F.col("observed") * CRITICAL_FACTOR < F.col("target")
    )
    return checks.where(~F.col("passed")).select(
        F.lit(ALERT_KIND).alias("kind"),
        F.when(far, CRITICAL).otherwise(WARNING).alias("severity_level"),
        "check",
        "observed",
        "target",
    )


def window_metrics(log: DataFrame, size: str, slide: str | None = None, by: Sequence[str] = ("endpoint",)) -> DataFrame:
    """Requests, errors and latency per time window; works on batch and streaming logs alike."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return (
        log.groupBy(window.alias("w"), *by)
        .agg(
            F.count("*").alias("requests"),
            F.count_if(F.col("status") >= 500).alias("errors"),
            F.max("latency_ms").alias("max_latency_ms"),
            F.avg("latency_ms").alias("mean_latency_ms"),
        )
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "requests", "errors",
                "max_latency_ms", "mean_latency_ms")
    )


def session_metrics(log: DataFrame, gap: str) -> DataFrame:
    """Requests per client session; a session ends after ``gap`` without a request."""
    return (
        log.groupBy("client", F.session_window("ts", gap).alias("s"))
        .agg(F.count("*").alias("requests"), F.count_if(F.col("status") >= 500).alias("errors"))
        .select("client", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "requests", "errors")
    )
