"""Running totals over ordered values without a single-task window.

Distinct values are put into buckets by value. Inside a bucket a window gives the local running
total; the totals of whole buckets form a small table whose running total is the bucket's offset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowguard.functions.columns import double_array, quoted
from flowguard.operators.quantiles import SKETCH_ACCURACY

ROWS_PER_BUCKET = 1_000_000
MAX_BUCKETS = 4096


def value_splits(
    df: DataFrame, columns: Sequence[str], rows_per_bucket: int = ROWS_PER_BUCKET, rows: int | None = None
) -> list[float]:
    """Split points that cut the pooled columns into buckets of about ``rows_per_bucket`` rows."""
    total = df.count() if rows is None else rows
    buckets = min(MAX_BUCKETS, -(-total // max(rows_per_bucket, 1)))
    if buckets <= 1:
        return []
    grid = double_array([i / buckets for i in range(1, buckets)])
    sketches = df.agg(
        *[F.percentile_approx(quoted(c), grid, F.lit(SKETCH_ACCURACY)).alias(f"q{i}") for i, c in enumerate(columns)]
    ).first()
    return sorted({float(v) for i in range(len(columns)) for v in (sketches[f"q{i}"] or [])})


def within_bucket(by: Sequence[str], order: str, inclusive: bool) -> Window:
    return (
        Window.partitionBy(*by, "bucket")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )


def bucket_offsets(totals: DataFrame, by: Sequence[str], sums: dict[str, str]) -> DataFrame:
    """Exclusive running totals over the bucket table: at most MAX_BUCKETS x columns rows per group."""
    keys = list(by) or [F.lit(0)]
    before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumns(
        {name: F.coalesce(F.sum(column).over(before), F.lit(0)) for name, column in sums.items()}
    )


def running_totals(
    counts: DataFrame, by: Sequence[str], value: str, sums: dict[str, str], several_buckets: bool = True
) -> DataFrame:
    """Adds to every distinct value the totals of all smaller values of its group.

    ``counts`` has one row per (by, value) and a ``bucket`` column; ``sums`` maps new to summed columns.
    """
    keys = [*by, "bucket"]
    window = within_bucket(by, value, inclusive=False)
    if not several_buckets:
        return counts.withColumns({n: F.coalesce(F.sum(c).over(window), F.lit(0)) for n, c in sums.items()})
    totals = counts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums.values()])
    offsets = bucket_offsets(totals, by, {f"{n}__before": c for n, c in sums.items()}).select(
        *keys, *[f"{n}__before" for n in sums]
    )
    local = counts.withColumns({f"{n}__local": F.coalesce(F.sum(c).over(window), F.lit(0)) for n, c in sums.items()})
    joined = local.join(offsets, keys)
    names: dict[str, Column] = {n: F.col(f"{n}__local") + F.col(f"{n}__before") for n in sums}
    return joined.withColumns(names).drop(*[f"{n}{s}" for n in sums for s in ("__local", "__before")])
