"""Parquet tables, JSON documents and text reports."""

from __future__ import annotations

import time
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPLITS = ("train", "val", "test")
# Ends a document in a text file of several.
RECORD_END = "\x1e"


def _located(spark: SparkSession, path: str):
    """The path and the file system that its scheme names."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path, jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def promote(spark: SparkSession, folder: str, column: str, root: str) -> None:
    """Renames the partitions of ``folder`` by ``column`` to the paths below ``root`` that they are named by; what is there goes."""
    source, system = _located(spark, folder)
    for status in system.listStatus(source):
        name = status.getPath().getName()
        if not name.startswith(f"{column}="):
            continue
        target = _located(spark, f"{root}/{unquote(name.removeprefix(f'{column}='))}")[0]
        system.delete(target, True)
        system.mkdirs(target.getParent())
        if not system.rename(status.getPath(), target):
            raise RuntimeError(f"could not rename {name} to {target}")
    system.delete(source, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm_path, system = _located(spark, path)
    return bool(system.exists(jvm_path))


def write_splits(df: DataFrame, path: str) -> None:
    """One parquet folder per split, so that reading a split reads only its files."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    absent = [s for s in SPLITS if not path_exists(spark, f"{path}/split={s}")]
    if absent:
        raise FileNotFoundError(f"missing splits under {path}: {absent}")
    return spark.read.parquet(path)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    return read_splits(spark, path).where(F.col("split") == split)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    if not path_exists(spark, path):
        raise FileNotFoundError(f"table not found: {path}")
    return spark.read.parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents with a declared schema; a document that is not an object fails the job."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"report not found: {path}")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_lines(df: DataFrame, path: str, line: str = "line") -> None:
    df.select(line).write.mode("overwrite").text(path)


def write_documents(df: DataFrame, path: str, column: str) -> None:
    """Texts of several lines, each ended by ``RECORD_END``."""
    df.select(column).write.mode("overwrite").option("lineSep", RECORD_END).text(path)


def read_documents(spark: SparkSession, path: str, column: str) -> DataFrame:
    if not path_exists(spark, path):
        raise FileNotFoundError(f"documents not found: {path}")
    return spark.read.option("lineSep", RECORD_END).text(path).withColumnRenamed("value", column)


def publish(df: DataFrame, folder: str) -> str:
    """Appends the rows as one JSON batch that readers see whole or not at all; returns its name.

    The batch is written under a name that readers skip and renamed when it is complete, so a job that dies leaves nothing behind
    that is read. Names start with the time of publication and are never used twice.
    """
    spark = df.sparkSession
    unique = uuid.uuid4().hex
    hidden, system = _located(spark, f"{folder}/_unfinished-{unique}")
    df.write.option("ignoreNullFields", False).json(hidden.toString())
    name = f"batch={time.time_ns():020d}-{unique}"
    if not system.rename(hidden, _located(spark, f"{folder}/{name}")[0]):
        raise RuntimeError(f"could not publish {name} in {folder}")
    return name


def published(spark: SparkSession, folder: str) -> list[str]:
    """Names of the published batches, oldest first; none without the folder. Read from the listing alone."""
    path, system = _located(spark, folder)
    if not system.exists(path):
        return []
    names = [status.getPath().getName() for status in system.listStatus(path)]
    return sorted(n for n in names if n.startswith("batch="))


def read_published(spark: SparkSession, folder: str, schema: str, latest: bool = False) -> DataFrame:
    """The rows of all batches, or of the latest alone, with the batch's name; no rows without a batch."""
    names = published(spark, folder)[-1 if latest else 0 :]
    whole = f"{schema}, batch string"
    if not names:
        return spark.createDataFrame([], whole)
    source = folder if not latest else f"{folder}/{names[0]}"
    return spark.read.schema(whole).option("mode", "FAILFAST").option("basePath", folder).json(source)
