"""Exact quantiles and order statistics that never gather a whole column.

Up to ``DIRECT_ROWS`` values per column the built-in ``percentile`` is used. Beyond that the wanted
ranks are bracketed: a mergeable sketch proposes edges, an exact histogram over the edges says
which bin holds each rank, and only the rows of those bins are looked at again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowguard.functions.columns import double_array, quoted
from flowguard.session import attach_rows, driver_rows, materialize

EXACT_ROWS = 1_000_000
DIRECT_ROWS = 50_000
SKETCH_EDGES = 512
MAX_EDGES = 20_000
SKETCH_ACCURACY = 10_000


def bucketed(df: DataFrame, column: str, splits: Sequence[float], output: str) -> DataFrame:
    """Adds the integer bucket of a double column by binary search over fixed split points."""
    inner = sorted({float(s) for s in splits if math.isfinite(s)})
    if not inner:
        return df.withColumn(output, F.lit(0))
    bucketizer = Bucketizer(
        splits=[-math.inf, *inner, math.inf], inputCol=column, outputCol=output, handleInvalid="keep"
    )
    return bucketizer.transform(df).withColumn(output, F.col(output).cast("int"))


def kth_smallest(
    values: DataFrame, ranks: Mapping[object, Sequence[int]], exact_rows: int = EXACT_ROWS, largest: int | None = None
) -> dict[tuple[object, int], float]:
    """Values at 0-based ranks per group of a ``(group, value)`` table; values must not be null.

    While a group has more than ``exact_rows`` candidate rows, a sketch proposes edges, an exact histogram
    over them says which bin holds each rank, and only the rows of those bins stay candidates.
    """
    kind = values.schema["group"].dataType.simpleString()
    # A target is a rank inside a shrinking row subset; ``offset`` is its rank within that subset.
    targets = [(group, int(rank), int(rank)) for group, wanted in ranks.items() for rank in sorted(set(wanted))]
    found: dict[tuple[object, int], float] = {}
    rows, reduced = values, False
    while targets:
        keys = ["group", "rank"] if reduced else ["group"]
        if largest is None:
            sizes = rows.where(F.col("group").isin(list(ranks))).groupBy(*keys).agg(F.count("*").alias("n"))
            largest = sizes.agg(F.max("n")).first()[0] or 0
        candidates = attach_rows(rows, targets, f"group {kind}, rank bigint, offset bigint", keys, how="inner")
        per_target = ["group", "rank", "offset"]
        if largest <= exact_rows:
            order = Window.partitionBy(*per_target).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
            counts = candidates.groupBy(*per_target, "value").agg(F.count("*").alias("n"))
            hits = _holding(counts.withColumn("upto", F.sum("n").over(order))).select("group", "rank", "value").collect()
            found.update({(r.group, r.rank): r.value for r in hits})
            return found
        # All groups share one edge list; many groups get coarser sketches and, if needed, one more round.
        steps = max(8, min(SKETCH_EDGES, MAX_EDGES // len(targets)))
        grid = double_array([i / steps for i in range(steps + 1)])
        sketches = driver_rows(
            rows.groupBy(*keys).agg(F.percentile_approx("value", grid, F.lit(SKETCH_ACCURACY)).alias("edges")),
            "order statistic sketches",
        )
        edges = sorted({e for r in sketches for e in r.edges})
        # Rows on an edge get a bin of their own, so one value that fills a third of the rows is done at once.
        on_edge = F.col("value") == F.element_at(double_array([math.nan, *edges]), F.col("bin") + 1)
        binned = bucketed(candidates, "value", edges, "bin").withColumn(
            "bin", F.col("bin") * 2 + F.when(on_edge, 0).otherwise(1)
        )
        order = Window.partitionBy(*per_target).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        counts = binned.groupBy(*per_target, "bin").agg(F.count("*").alias("n"))
        hits = driver_rows(_holding(counts.withColumn("upto", F.sum("n").over(order))), "order statistic bins")
        chosen = []
        targets = []
        for r in hits:
            if r["bin"] % 2 == 0:
                found[(r.group, r.rank)] = edges[r["bin"] // 2 - 1]
            else:
                chosen.append((r.group, r.rank, r["bin"]))
                targets.append((r.group, r.rank, r.offset - r.upto + r.n))
        if targets:
            schema = f"group {kind}, rank bigint, bin int"
            kept = attach_rows(binned.drop("offset"), chosen, schema, ["group", "rank", "bin"], how="inner")
            rows, reduced = materialize(kept.select("group", "rank", "value"), "order-statistic"), True
            largest = max(r.n for r in hits if r["bin"] % 2)
    return found


def _holding(counts: DataFrame) -> DataFrame:
    """The cells of a running count that contain the wanted offset."""
    return counts.where((F.col("upto") > F.col("offset")) & (F.col("upto") - F.col("n") <= F.col("offset")))


def interpolate(position: float, low: float, high: float) -> float:
    lower, upper = math.floor(position), math.ceil(position)
    if lower == upper or low == high:
        return low
    return (upper - position) * low + (position - lower) * high


def _codes(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """2i for a value between edge i-1 and edge i, 2i+1 for edge i itself."""
    return np.searchsorted(edges, values, side="right") + np.searchsorted(edges, values, side="left")


def _code_counts(values: DataFrame, edges: Sequence[np.ndarray]) -> dict[int, list[tuple[int, int]]]:
    """(code, number of values) of every column, by code; every task counts its own rows first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(2 * len(e) + 1, dtype=np.int64) for e in edges]
        for batch in batches:
            for total, column, e in zip(totals, batch.columns, edges):
                total += np.bincount(_codes(column.drop_null().to_numpy(), e), minlength=len(total))
        for i, total in enumerate(totals):
            at = np.flatnonzero(total)
            columns = [pa.array(np.full(len(at), i, dtype=np.int32)), pa.array(at.astype(np.int32)), pa.array(total[at])]
            yield pa.RecordBatch.from_arrays(columns, names=["feature_id", "code", "n"])

    counted = values.mapInArrow(run, "feature_id int, code int, n bigint").groupBy("feature_id", "code").agg(F.sum("n").alias("n"))
    found: dict[int, list[tuple[int, int]]] = {}
    for r in sorted(counted.collect()):
        found.setdefault(r.feature_id, []).append((r.code, r.n))
    return found


def _inside(values: DataFrame, edges: Sequence[np.ndarray], brackets: Sequence[str]) -> DataFrame:
    """(group, value) of the values in the brackets ``feature:code``; all others are dropped in the scan."""
    names = [np.full(2 * len(e) + 1, None, dtype=object) for e in edges]
    for b in brackets:
        i, code = map(int, b.split(":"))
        names[i][code] = b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, column, e in zip(names, batch.columns, edges):
                given = column.drop_null().to_numpy()
                group = own[_codes(given, e)]
                kept = group != None  # noqa: E711
                yield pa.RecordBatch.from_arrays([pa.array(group[kept], pa.string()), pa.array(given[kept])], names=["group", "value"])

    return values.mapInArrow(run, "group string, value double")


def _levels(probabilities: Sequence[float]) -> str:
    """The probabilities as one folded literal, however many there are."""
    return f"CAST(split('{','.join(repr(float(p)) for p in probabilities)}', ',') AS array<double>)"


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    exact_rows: int = EXACT_ROWS,
    direct_rows: int = DIRECT_ROWS,
) -> dict[str, list[float] | None]:
    """Linearly interpolated quantiles per column over its non-null values; None for an empty column.

    Three passes at any size, each with map-side aggregation: a sketch brackets every probability, a
    histogram over the bracket ends places the exact ranks, and only values strictly inside a needed
    bracket (a share of about 4 / SKETCH_ACCURACY of the rows) are ordered.
    """
    margin = 2.0 / SKETCH_ACCURACY
    ends = sorted({min(max(p + d, 0.0), 1.0) for p in probabilities for d in (-margin, margin)} | {0.0, 1.0})
    first = df.selectExpr(
        *[f"count({quoted(c)}) AS n{i}" for i, c in enumerate(columns)],
        *[f"percentile_approx({quoted(c)}, {_levels(ends)}, {SKETCH_ACCURACY}) AS e{i}" for i, c in enumerate(columns)],
    ).first()
    counts = [first[f"n{i}"] for i in range(len(columns))]
    if max(counts, default=0) <= direct_rows:
        row = df.selectExpr(*[f"percentile({quoted(c)}, {_levels(probabilities)}) AS q{i}" for i, c in enumerate(columns)]).first()
        return {c: (list(row[f"q{i}"]) if counts[i] else None) for i, c in enumerate(columns)}
    # The brackets are data of the tasks: as expressions, those of many columns and probabilities exceed what a plan can hold.
    edges = [np.unique(np.array(first[f"e{i}"] or [], dtype=float)) for i in range(len(columns))]
    values = df.select(*[F.col(quoted(c)).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    bins = _code_counts(values, edges)
    at: dict[tuple[int, int], float] = {}
    inside: dict[str, list[tuple[int, int, int]]] = {}  # bracket -> (feature, rank, rank inside the bracket)
    for i, found in bins.items():
        for rank in sorted({f(p * (counts[i] - 1)) for p in probabilities for f in (math.floor, math.ceil)}):
            below = 0
            for code, n in found:
                if rank < below + n:
                    break
                below += n
            if code % 2:
                at[(i, rank)] = float(edges[i][code // 2])
            else:
                inside.setdefault(f"{i}:{code}", []).append((i, rank, rank - below))
    if inside:
        rows = _inside(values, edges, list(inside))
        largest = max(n for i, found in bins.items() for code, n in found if f"{i}:{code}" in inside)
        picked = kth_smallest(rows, {b: [k for _, _, k in t] for b, t in inside.items()}, exact_rows, largest)
        at.update({(i, rank): picked[(b, k)] for b, t in inside.items() for i, rank, k in t})
    result: dict[str, list[float] | None] = {}
    for i, c in enumerate(columns):
        positions = [p * (counts[i] - 1) for p in probabilities]
        result[c] = (
            [interpolate(p, at[(i, math.floor(p))], at[(i, math.ceil(p))]) for p in positions] if counts[i] else None
        )
    return result
