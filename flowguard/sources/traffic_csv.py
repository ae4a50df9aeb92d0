"""Labelled ingest of a device's CSV tree: labels, families and sources come from the file path."""

from __future__ import annotations

import hashlib
import logging
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowguard.config import BENIGN, FAMILY, LABEL, SOURCE
from flowguard.functions.columns import quoted
from flowguard.operators.ordering import first_rows_per_group
from flowguard.session import attach_rows, driver_rows, materialize
from flowguard.sources.stores import path_exists, promote

LOGGER = logging.getLogger(__name__)

# Naming of the attack folders and files. A match starts where a name does; elsewhere none is tried, which would
# take the square of a name's length for every row.
ATTACK_PATH = r"(?<![^/])([^/]+)_attacks/([^/]+)\.csv"
FILE_NAME = r"(?<![^/])([^/]+\.csv)"

PATH, BLOCK = "__path", "__block"
BLOCK_LIMIT = 2_000_000


def path_columns(path: Column | str) -> dict[str, Column]:
    """label, attack_family and source_file out of ``.../<family>_attacks/<stem>.csv``."""
    column = F.col(path) if isinstance(path, str) else path
    family = F.regexp_extract(column, ATTACK_PATH, 1)
    stem = F.regexp_extract(column, ATTACK_PATH, 2)
    attack = family != ""
    return {
        LABEL: F.when(attack, F.concat_ws("_", family, stem)).otherwise(F.lit(BENIGN)),
        FAMILY: F.when(attack, family).otherwise(F.lit(BENIGN)),
        SOURCE: F.regexp_extract(column, FILE_NAME, 1),
    }


def discover(spark: SparkSession, benign: str, attack_dirs: Sequence[str]) -> list[str]:
    """Existing input paths; the benign file is required, a missing attack folder is skipped."""
    if not path_exists(spark, benign):
        raise FileNotFoundError(f"benign file not found: {benign}")
    found = [benign]
    for folder in attack_dirs:
        if path_exists(spark, folder):
            found.append(folder)
        else:
            LOGGER.warning("attack folder not found, skipped: %s", folder)
    return found


def infer_features(spark: SparkSession, csv_path: str) -> list[str]:
    """Column names from the header line alone."""
    if not path_exists(spark, csv_path):
        raise FileNotFoundError(f"file not found: {csv_path}")
    names = spark.read.option("header", True).csv(csv_path).columns
    if not names:
        raise ValueError(f"no header in {csv_path}")
    return names


def feature_schema(names: Sequence[str], order_key: str | None = None) -> T.StructType:
    """Float columns; a column that orders rows stays a double, so that large keys do not collide."""
    return T.StructType([T.StructField(n, T.DoubleType() if n == order_key else T.FloatType(), True) for n in names])


def scan(
    spark: SparkSession,
    benign: str,
    attack_dirs: Sequence[str],
    features: Sequence[str] | None = None,
    max_rows_per_file: int | None = None,
    order_key: str | None = None,
) -> DataFrame:
    """One multi-path scan of all files: float features plus the three metadata columns.

    A cell that is not numeric fails the job. Files are split by size, so a huge one is read by many tasks.
    """
    paths = discover(spark, benign, attack_dirs)
    names = list(features) if features else infer_features(spark, benign)
    raw = (
        spark.read.schema(feature_schema(names, order_key))
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .csv(paths)
        .select("*", F.col("_metadata.file_path").alias(PATH), F.col("_metadata.file_block_start").alias(BLOCK))
    )
    rows = raw if max_rows_per_file is None else first_rows_of_files(raw, max_rows_per_file)
    return rows.withColumns(path_columns(PATH)).drop(PATH, BLOCK)


def first_rows_of_files(rows: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` rows of every file, in file order.

    Rows are counted per input block; blocks before the one where the cap ends are kept whole, and only
    the rows of that block (one input split) are numbered.
    """
    if cap <= 0:
        return rows.limit(0)
    sizes = driver_rows(rows.groupBy(PATH, BLOCK).agg(F.count("*").alias("n")), "input blocks", limit=BLOCK_LIMIT)
    ends, seen = {}, {}
    for path, block, n in sorted((r[PATH], r[BLOCK], r.n) for r in sizes):
        before = seen.get(path, 0)
        if before < cap <= before + n:
            ends[path] = (block, cap - before)
        seen[path] = before + n
    cut = [(p, b, need) for p, (b, need) in ends.items()]
    schema = f"{PATH} string, __end bigint, __need bigint"
    # The id is taken in the scan: after a shuffled join it would not follow the lines of the file.
    numbered = rows.withColumn("__id", F.monotonically_increasing_id())
    marked = attach_rows(numbered, cut, schema, [PATH]) if cut else rows.withColumns({"__end": F.lit(None), "__need": F.lit(None)})
    whole = marked.where(F.col("__end").isNull() | (F.col(BLOCK) < F.col("__end"))).select(*map(quoted, rows.columns))
    if not cut:
        return whole
    place = Window.partitionBy(PATH).orderBy("__id")
    last = (
        marked.where(F.col(BLOCK) == F.col("__end"))
        .withColumn("__no", F.row_number().over(place))
        .where(F.col("__no") <= F.col("__need"))
    )
    return whole.unionByName(last.select(*map(quoted, rows.columns)))


def load(
    spark: SparkSession,
    benign: str,
    attack_dirs: Sequence[str],
    order_key: str | None = None,
    max_rows_per_file: int | None = None,
    cache_dir: str | None = None,
) -> DataFrame:
    """Whole data set, optionally the first rows of each file, optionally through a parquet cache.

    "First" follows ``order_key`` if one is given and the order of the lines in the file otherwise. The cache entry is named by the inputs and the row cap, so a different cap is never served from it.
    """
    entry = None
    if cache_dir is not None:
        identity = "|".join([benign, *attack_dirs, str(order_key), str(max_rows_per_file)])
        entry = f"{cache_dir}/{hashlib.sha256(identity.encode()).hexdigest()[:16]}"
        if path_exists(spark, f"{entry}/_SUCCESS"):
            return spark.read.parquet(entry)
    if order_key is None:
        table = scan(spark, benign, attack_dirs, max_rows_per_file=max_rows_per_file)
    else:
        table = scan(spark, benign, attack_dirs, order_key=order_key)
        if max_rows_per_file is not None:
            # One label per file; two families may have files of the same name. The passes below read the parsed rows.
            table = first_rows_per_group(materialize(table, "parsed"), LABEL, order_key, max_rows_per_file)
    if table.isEmpty():
        raise RuntimeError("no rows were loaded; check the input paths")
    if entry is not None:
        table.write.mode("overwrite").parquet(entry)
        table = spark.read.parquet(entry)
    return table


def device_filter(df: DataFrame, path: str, device: str) -> DataFrame:
    """Rows whose path matches the device pattern, or all rows if none does."""
    match = F.coalesce(F.col(path).rlike(device), F.lit(False))
    if df.where(match).isEmpty():
        LOGGER.warning("no row matches device pattern %s; all rows are kept", device)
        return df
    return df.where(match)


def write_tree(df: DataFrame, path_column: str, root: str, columns: Sequence[str]) -> list[str]:
    """Writes the rows as a CSV tree, one folder per source path; returns the source paths.

    All folders are written in one pass, a path in as many files as its share of about twice the cores, so the number of files does
    not grow with the rows. A folder is renamed to its path when the pass is complete.
    """
    spark = df.sparkSession
    counted = driver_rows(df.groupBy(F.col(path_column).alias("path")).agg(F.count("*").alias("n")), "source paths")
    if any(not r.path for r in counted):
        raise ValueError("rows without a source path")
    paths, total, files = sorted(r.path for r in counted), sum(r.n for r in counted), 2 * spark.sparkContext.defaultParallelism
    shards = [(r.path, -(-files * r.n // total)) for r in counted]
    named = df.select(*columns, F.col(path_column).alias(PATH)).withColumn("__row", F.monotonically_increasing_id())
    dealt = attach_rows(named, shards, f"{PATH} string, __shards bigint", [PATH]).withColumn("__shard", F.col("__row") % F.col("__shards"))
    unfinished = f"{root}/_unfinished-{uuid.uuid4().hex}"
    rows = dealt.repartition(files, PATH, "__shard").select(*columns, PATH)
    rows.write.partitionBy(PATH).option("header", True).csv(unfinished)
    promote(spark, unfinished, PATH, root)
    return paths
