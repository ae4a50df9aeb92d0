"""Exact-count choices by a seeded hash order, for groups of any size.

The quota of a group is turned into a threshold (hash, key). One pass counts rows per hash prefix,
a second ranks only the rows of the prefix where the quota ends. Choosing rows is then a
comparison on every row: no shuffle of the table and no window over a whole group.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowguard.functions.columns import hash_order, quoted
from flowguard.operators.quantiles import kth_smallest
from flowguard.session import attach_rows, driver_rows

PREFIX_DIGITS = 4  # 65,536 hash prefixes where a table is ranked whole
ROWS_PER_PREFIX = 100_000
MAX_PREFIX_DIGITS = 5
LARGEST_EXACT_KEY = 2**53  # keys are compared as doubles


def prefix_digits(largest_group: int) -> int:
    """Hex digits that leave about ROWS_PER_PREFIX rows per prefix, and never more than 16^5 prefixes."""
    digits = 1
    while digits < MAX_PREFIX_DIGITS and largest_group > ROWS_PER_PREFIX * 16**digits:
        digits += 1
    return digits


def hash_cutoffs(
    rows: DataFrame, quotas: Iterable[tuple[object, str, int]], largest_group: int
) -> dict[tuple[object, str], tuple[str, str]]:
    """Last chosen (hash, key) per (group, cut) of a ``(group, hash, key)`` table with unique keys.

    A quota of 0 has no threshold and is left out; a quota must not exceed the size of its group.
    """
    wanted = [(g, c, int(k)) for g, c, k in quotas if k > 0]
    if not wanted:
        return {}
    kind = rows.schema["group"].dataType.simpleString()
    prefixed = rows.withColumn("prefix", F.substring("hash", 1, prefix_digits(largest_group)))
    order = Window.partitionBy("group").orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)
    counts = prefixed.groupBy("group", "prefix").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(order))
    last = driver_rows(
        attach_rows(counts, wanted, f"group {kind}, cut string, quota bigint", ["group"], how="inner")
        .where((F.col("upto") >= F.col("quota")) & (F.col("upto") - F.col("n") < F.col("quota")))
        .select("group", "prefix", "cut", (F.col("quota") - F.col("upto") + F.col("n")).alias("need")),
        "hash cut-offs",
    )
    schema = f"group {kind}, prefix string, cut string, need bigint"
    ranked = attach_rows(prefixed, last, schema, ["group", "prefix"], how="inner").withColumn(
        "rank", F.row_number().over(Window.partitionBy("group", "prefix", "cut").orderBy("hash", "key"))
    )
    hits = ranked.where(F.col("rank") == F.col("need")).select("group", "cut", "hash", "key").collect()
    return {(r.group, r.cut): (r.hash, r.key) for r in hits}


def not_after(hash_column: Column | str, key: Column | str, last_hash: Column, last_key: Column) -> Column:
    """True where (hash, key) is at or before the threshold; false where there is none."""
    h = F.col(hash_column) if isinstance(hash_column, str) else hash_column
    k = (F.col(key) if isinstance(key, str) else key).cast("string")
    return F.coalesce((h < last_hash) | ((h == last_hash) & (k <= last_key)), F.lit(False))


def exact_sample(df: DataFrame, key: str, size: int, seed: int) -> DataFrame:
    """Exactly ``min(size, rows)`` rows, uniform without replacement, the same on every run."""
    total = df.count()
    if size >= total:
        return df
    rows = df.select(
        F.lit(0).alias("group"), hash_order(seed, key).alias("hash"), F.col(key).cast("string").alias("key")
    )
    cut = hash_cutoffs(rows, [(0, "sample", size)], total)
    if not cut:
        return df.limit(0)
    last_hash, last_key = cut[(0, "sample")]
    return df.where(not_after(hash_order(seed, key), key, F.lit(last_hash), F.lit(last_key)))


def shuffle_rank(df: DataFrame, key: str, seed: int, output: str = "shuffle_rank") -> DataFrame:
    """Position of every row in a seeded permutation, ranked per hash prefix plus the prefix offset."""
    hashed = df.withColumn("hash", hash_order(seed, key)).withColumn("prefix", F.substring("hash", 1, PREFIX_DIGITS))
    before = Window.partitionBy(F.lit(0)).orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        hashed.groupBy("prefix")
        .agg(F.count("*").alias("n"))
        .select("prefix", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    local = hashed.withColumn("local", F.row_number().over(Window.partitionBy("prefix").orderBy("hash", F.col(key).cast("string"))))
    return (
        local.join(offsets, "prefix")
        .withColumn(output, (F.col("local") + F.col("offset")).cast("bigint"))
        .drop("hash", "prefix", "local", "offset")
    )


def first_rows_per_group(df: DataFrame, group: str, key: str, cap: int) -> DataFrame:
    """Exactly the first ``cap`` rows of each group by a numeric key; null keys come last, equal keys in row-hash order.

    The key at rank ``cap`` is found per group by order statistics, so no group is sorted whole. Only rows that tie
    with it are numbered, after every task has cut them to ``cap``.
    """
    if cap <= 0:
        return df.limit(0)
    order = F.col(quoted(key))
    sizes = driver_rows(
        df.groupBy(F.col(quoted(group)).alias("group")).agg(
            F.count("*").alias("n"), F.count(order).alias("filled"), F.max(F.abs(order)).alias("top")
        ),
        "groups to cap",
    )
    if any(r.top is not None and r.top >= LARGEST_EXACT_KEY for r in sizes):
        raise ValueError("the row order key must stay below 2^53 in magnitude")
    capped = [r for r in sizes if r.n > cap]
    if not capped:
        return df
    ranks = {r.group: [cap - 1] for r in capped if r.filled >= cap}
    values = df.select(F.col(quoted(group)).alias("group"), order.cast("double").alias("value")).where("value IS NOT NULL")
    at = kth_smallest(values, ranks, largest=max(r.filled for r in capped)) if ranks else {}
    kind = df.schema[group].dataType.simpleString()
    limits = [(r.group, at.get((r.group, cap - 1)), True) for r in capped]
    marked = attach_rows(df, limits, f"{quoted(group)} {kind}, __last double, __capped boolean", [group])
    # Without a last key a group has fewer filled keys than the cap: they all stay, and null keys make up the rest.
    before = F.when(F.col("__last").isNull(), order.isNotNull()).otherwise(order.cast("double") < F.col("__last"))
    tied = F.col("__capped") & order.cast("double").eqNullSafe(F.col("__last"))
    columns = [quoted(c) for c in df.columns]
    whole = marked.where(F.col("__capped").isNull() | before).select(*columns)
    counts = marked.where("__capped").groupBy(F.col(quoted(group)).alias("group")).agg(F.count_if(before).alias("n"))
    needs = [(r.group, cap - r.n) for r in driver_rows(counts, "groups to cap")]
    edge = marked.where(tied).select(*columns)
    place = Window.partitionBy(quoted(group)).orderBy(F.xxhash64(*columns))
    numbered = edge.withColumn("__place", F.row_number().over(place)).where(F.col("__place") <= cap)
    last = attach_rows(numbered, needs, f"{quoted(group)} {kind}, __need bigint", [group]).where("__place <= __need")
    return whole.unionByName(last.select(*columns))
