"""Streaming jobs. Each one is the batch operator over a streaming DataFrame plus a sink."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowguard.functions.columns import bin_sql, double_array, finite_sql, quoted
from flowguard.operators.drift import EMPTY_BIN_SHARE
from flowguard.operators.monitor import session_metrics, window_metrics
from flowguard.operators.scoring import SignalRange, fuse, with_dual_score
from flowguard.session import scratch_path
from flowguard.sources.traffic_csv import feature_schema, path_columns

MERGE_SESSIONS = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"


def csv_stream(
    spark: SparkSession, paths: str, features: Sequence[str], max_files_per_trigger: int | None = None
) -> DataFrame:
    """Labelled traffic rows as files arrive; labels come from the path as in the batch scan."""
    reader = (
        spark.readStream.schema(feature_schema(features))
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
    )
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.csv(paths).withColumns(path_columns(F.col("_metadata.file_path")))


def write_available(df: DataFrame, name: str, output_mode: str = "append") -> DataFrame:
    """Drains the stream into parquet with a checkpoint (exactly once) and returns the written table."""
    spark = df.sparkSession
    base = scratch_path(spark, name)
    started = (
        df.writeStream.format("parquet")
        .outputMode(output_mode)
        .option("path", f"{base}/data")
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    started.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/data")


def write_complete(df: DataFrame, name: str) -> DataFrame:
    """Drains the stream in complete mode and returns the aggregate after its last trigger, open windows included.

    Give it an aggregate without watermark: all groups stay in the state, and no row is late. A replayed trigger
    overwrites its own folder, so the result is exact after a failure.
    """
    spark = df.sparkSession
    base = scratch_path(spark, name)
    numbers: list[int] = []

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/trigger-{number}")
        numbers.append(number)

    started = (
        df.writeStream.outputMode("complete")
        .foreachBatch(store)
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    started.awaitTermination()
    if not numbers:
        return spark.createDataFrame([], df.schema)
    return spark.read.schema(df.schema).parquet(f"{base}/trigger-{max(numbers)}")


def watermarked(rows: DataFrame, time: str, delay: str | None) -> DataFrame:
    """``None`` sets no watermark, for results in complete mode."""
    return rows if delay is None else rows.withWatermark(time, delay)


def windowed_requests(
    log: DataFrame, size: str, slide: str | None = None, delay: str | None = "10 minutes"
) -> DataFrame:
    """Request metrics per window. In append mode rows later than the watermark are dropped and closed windows are
    emitted once."""
    return window_metrics(watermarked(log, "ts", delay), size, slide)


def client_sessions(log: DataFrame, gap: str, delay: str | None = "10 minutes") -> DataFrame:
    """Request metrics per client session. Each task merges its own sessions before the shuffle, so that a busy client
    sends sessions instead of requests to its task."""
    log.sparkSession.conf.set(MERGE_SESSIONS, "true")
    return session_metrics(watermarked(log, "ts", delay), gap)


def without_replays(log: DataFrame, keys: Sequence[str] = ("request_id",), delay: str = "1 day") -> DataFrame:
    """Each request once, however often it is replayed within the watermark delay."""
    return log.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


def scored_stream(
    rows: DataFrame,
    clf: str,
    rec: str,
    stored: SignalRange,
    weights: Sequence[float],
    intercept: float,
) -> DataFrame:
    """Stateless scoring with a stored signal range; a stream has no batch to normalise over."""
    return fuse(with_dual_score(rows, clf, rec, "fitted", stored), weights, intercept, clf, rec)


def windowed_bins(
    rows: DataFrame, edges: dict[str, list[float]], size: str, delay: str | None = "10 minutes", time: str = "ts"
) -> DataFrame:
    """Histogram of every feature per window over fixed reference edges: one count per bin."""
    features = list(edges)
    values = [f"{finite_sql(quoted(f))} AS v{i}" for i, f in enumerate(features)]
    cells = ", ".join(f"{i}, {bin_sql(f'v{i}', edges[f])}" for i, f in enumerate(features))
    long = rows.selectExpr(time, *values).selectExpr(time, f"stack({len(features)}, {cells}) AS (feature_id, bin)")
    most = max(len(e) for e in edges.values()) - 1
    counts = F.array(*[F.count_if(F.col("bin") == b) for b in range(max(most, 1))])
    return (
        watermarked(long, time, delay)
        .groupBy(F.window(time, size).alias("w"), "feature_id")
        .agg(counts.alias("counts"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "feature_id", "counts")
    )


def window_psi(bins: DataFrame, reference: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """Index of every window and feature against the reference counts of the same bins."""
    features = list(edges)
    counts = reference.selectExpr(
        *[f"{bin_sql(finite_sql(quoted(f)), edges[f])} AS b{i}" for i, f in enumerate(features)]
    ).selectExpr(
        *[
            f"count_if(b{i} = {b}) AS n{i}_{b}"
            for i, f in enumerate(features)
            for b in range(max(len(edges[f]) - 1, 1))
        ]
    ).first()
    shares = []
    for i, f in enumerate(features):
        n = [counts[f"n{i}_{b}"] for b in range(max(len(edges[f]) - 1, 1))]
        total = max(sum(n), 1)
        shares.append(double_array([c / total if c else EMPTY_BIN_SHARE for c in n]))
    at = F.col("feature_id") + 1
    table = bins.withColumns(
        {
            "ref": F.element_at(F.array(*shares), at),
            "usable": F.element_at(F.array(*[F.lit(len(edges[f]) > 1) for f in features]), at),
        }
    ).withColumn("n", F.greatest(F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, c: a + c), F.lit(1)))
    # The divisor is a column of its own, so that the lambda below reads plain columns only.
    current = table.withColumn(
        "cur",
        F.transform(
            F.slice("counts", 1, F.size("ref")),
            lambda c: F.when(c == 0, F.lit(EMPTY_BIN_SHARE)).otherwise(c.cast("double") / F.col("n")),
        ),
    )
    terms = F.zip_with("ref", "cur", lambda r, c: (c - r) * F.log(c / r))
    name = F.element_at(F.array(*[F.lit(f) for f in features]), at)
    value = F.when(F.col("usable"), F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)).otherwise(F.lit(0.0))
    return current.select("window_start", name.alias("feature"), value.alias("psi"))


def model_scores(model, requests: DataFrame, body: str = "body") -> DataFrame:
    """A stream of JSON requests scored by a fitted hybrid model, prepared and normalised by what the model has stored.

    No state and no range of the batch is needed, so a file sink with a checkpoint holds every item exactly once.
    """
    return model.score_requests(requests, body).drop("details")
