"""Helpers that the operators share: words, keys, tables in the shared folder and distributed running totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowguard.session import materialize

# Fixed value: a word is a run of characters other than space and the five ASCII controls 09 to 0D.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of a text as an array; none for null or blank text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` refers to it inside lambdas."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def whole_row(df: DataFrame, name: str = "row") -> Column:
    """All columns as one struct, so that columns added beside it cannot clash with the caller's."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns]).alias(name)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], value: str | None = None, name: str = "before"
) -> DataFrame:
    """Adds ``name``: the sum of ``value`` (or the number of rows) over the earlier rows of the same group.

    Rows are range-sorted by group and order, so that a group of any size is spread over many tasks: each range
    reports its total, the totals (one row per group and range) are summed over, and every range then counts on
    from its own offset. ``group`` and ``order`` are read twice, so ``df`` should be a stored, narrow table. Group
    columns must not be null. Rows that are equal in all of them follow in any order and are parted by their place in ``df``.
    """
    amount = F.lit(1).cast("long") if value is None else F.col(value).cast("long")
    placed = df.withColumn("__row", F.monotonically_increasing_id())
    ranges = placed.repartitionByRange(shuffle_partitions(df.sparkSession), *[F.col(c).asc() for c in group], *order, F.col("__row").asc()).drop("__row")
    stored = materialize(ranges.withColumn("__range", F.spark_partition_id()), "ranges")
    earlier = (Window.unboundedPreceding, -1)
    totals = stored.groupBy(*group, "__range").agg(F.sum(amount).alias("__total"))
    offsets = totals.select(
        *group,
        "__range",
        F.coalesce(
            F.sum("__total").over(Window.partitionBy(*group).orderBy("__range").rowsBetween(*earlier)), F.lit(0)
        ).alias("__offset"),
    )
    inside = Window.partitionBy(*group, "__range").orderBy(*order).rowsBetween(*earlier)
    return (
        stored.join(offsets, [*group, "__range"])
        .withColumn(name, F.col("__offset") + F.coalesce(F.sum(amount).over(inside), F.lit(0)))
        .drop("__range", "__offset")
    )
