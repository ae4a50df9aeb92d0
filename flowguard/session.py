"""Session settings, the shared work folder and size-checked lookups."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A lookup side is broadcast only when it was counted and stays under this many rows.
BROADCAST_ROWS = 200_000
# Per-class or per-feature statistics may be held by the driver up to this many rows.
DRIVER_ROWS = 100_000


def build_session(cpus: int | str = "*", app: str = "flowguard", **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if configured:
        if current is None:
            context.setCheckpointDir(configured)
        return configured
    if current:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="flowguard-")
    context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for this application below the shared folder; the application's folder can go after the run."""
    root = shared_dir(spark).rstrip("/")
    return f"{root}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table", partition_by: str | None = None) -> DataFrame:
    """Cuts the lineage by a parquet table in the shared folder.

    Later passes survive lost executors, and read only the columns and row groups they need.
    """
    path = scratch_path(df.sparkSession, name)
    writer = df.write if partition_by is None else df.write.partitionBy(partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def driver_rows(df: DataFrame, what: str, limit: int = DRIVER_ROWS) -> list:
    """Collect a statistics table, refusing one that is larger than a statistics table can be."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows; it is not a bounded statistics table")
    return rows


def attach_rows(
    big: DataFrame,
    rows: Sequence[tuple],
    schema: str,
    on: Sequence[str],
    how: str = "left",
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Equi-join with lookup rows the driver already holds: broadcast if few, shuffled (AQE splits skew) otherwise."""
    small = big.sparkSession.createDataFrame(list(rows), schema)
    return big.join(F.broadcast(small) if len(rows) <= max_rows else small, list(on), how)
