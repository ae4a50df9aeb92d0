"""Deterministic exact-count splits and leave-one-attack-out folds."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowguard.config import FoldConfig, SplitConfig
from flowguard.functions.columns import hash_order, quoted
from flowguard.operators.ordering import hash_cutoffs, not_after
from flowguard.session import attach_rows, driver_rows


def proportional_quota(counts: Mapping[str, int], total: int) -> dict[str, int]:
    """Largest-remainder share of ``total`` per class; equal remainders go by class name."""
    size = sum(counts.values())
    exact = {c: (n * total) // size for c, n in counts.items()}
    left = total - sum(exact.values())
    by_remainder = sorted(counts, key=lambda c: (-((counts[c] * total) % size), c))
    for c in by_remainder[:left]:
        exact[c] += 1
    return exact


def split_quotas(counts: Mapping[str, int], cfg: SplitConfig) -> dict[str, tuple[int, int]]:
    """(test, validation) rows per class: the kept side is apportioned, the rest is held out."""
    small = sorted(c for c, n in counts.items() if n < 2)
    if small:
        raise ValueError(f"classes with fewer than two rows cannot be stratified: {small[:5]}")
    size = sum(counts.values())
    rest = size - math.ceil(cfg.test_size * size)
    kept = proportional_quota(counts, rest)
    train = proportional_quota(kept, rest - math.ceil(cfg.val_size / (1.0 - cfg.test_size) * rest))
    return {c: (counts[c] - kept[c], kept[c] - train[c]) for c in counts}


def stratified_split(df: DataFrame, by: str, key: str, cfg: SplitConfig = SplitConfig()) -> DataFrame:
    """Adds ``split`` (train, val, test) with exact stratified counts; ``key`` must be unique."""
    if by not in df.columns:
        raise KeyError(f"stratification column not found: {by}")
    sizes = driver_rows(df.groupBy(by).agg(F.count("*").alias("n")), "strata")
    if any(r[by] is None for r in sizes):
        raise ValueError("the stratification column contains nulls")
    counts = {r[by]: r.n for r in sizes}
    if not counts:
        raise ValueError("cannot split an empty table")
    quotas = split_quotas(counts, cfg)
    rows = df.select(
        F.col(by).alias("group"), hash_order(cfg.seed, key).alias("hash"), F.col(key).cast("string").alias("key")
    )
    wanted = [(c, "test", t) for c, (t, _) in quotas.items()] + [(c, "val", t + v) for c, (t, v) in quotas.items()]
    at = hash_cutoffs(rows, wanted, max(counts.values()))
    table = [(c, *at.get((c, "test"), (None, None)), *at.get((c, "val"), (None, None))) for c in counts]
    kind = df.schema[by].dataType.simpleString()
    schema = f"`{by}` {kind}, test_hash string, test_key string, val_hash string, val_key string"
    order = hash_order(cfg.seed, key)
    role = (
        F.when(not_after(order, key, F.col("test_hash"), F.col("test_key")), "test")
        .when(not_after(order, key, F.col("val_hash"), F.col("val_key")), "val")
        .otherwise("train")
    )
    return attach_rows(df, table, schema, [by]).withColumn("split", role).drop("test_hash", "test_key", "val_hash", "val_key")


def attack_labels(df: DataFrame, cfg: FoldConfig = FoldConfig()) -> list[str]:
    rows = driver_rows(df.select(F.col(cfg.label).cast("string").alias("a")).distinct(), "attack labels")
    return sorted(r.a for r in rows if r.a is not None and r.a != cfg.benign)


def fold_table(df: DataFrame, key: str, cfg: FoldConfig = FoldConfig()) -> list[tuple[int, str, str, str]]:
    """(fold, held-out attack, last test hash, last test key) with a seed of its own per fold."""
    benign = df.where(F.col(cfg.label) == cfg.benign)
    if not df.where(F.col(cfg.label).isNull()).isEmpty():
        raise ValueError("the label column contains nulls")
    size = benign.count()
    if size == 0:
        raise ValueError("leave-one-attack-out needs benign rows but there are none")
    if size < 2:
        raise ValueError("leave-one-attack-out needs at least two benign rows")
    attacks = attack_labels(df, cfg)
    if not attacks:
        return []
    test_rows = math.ceil(cfg.benign_test_size * size)
    seeds = F.explode(F.sequence(F.lit(0), F.lit(len(attacks) - 1)))
    rows = benign.select(F.col(key).cast("string").alias("key"), seeds.alias("group")).select(
        "group", hash_order(F.col("group") + F.lit(cfg.seed), "key").alias("hash"), "key"
    )
    at = hash_cutoffs(rows, [(i, "test", test_rows) for i in range(len(attacks))], size)
    return [(i, a, *at[(i, "test")]) for i, a in enumerate(attacks)]


def assign_folds(
    df: DataFrame, folds: Sequence[tuple[int, str, str, str]], key: str, cfg: FoldConfig = FoldConfig()
) -> DataFrame:
    """The rows once per given fold, with fold, held_out_attack and role."""
    table = F.array(
        *[
            F.struct(
                F.lit(i).alias("fold"),
                F.lit(a).alias("held_out_attack"),
                F.lit(h).alias("last_hash"),
                F.lit(k).alias("last_key"),
            )
            for i, a, h, k in folds
        ]
    )
    label = F.col(cfg.label).cast("string")
    order = hash_order(F.col("f.fold") + F.lit(cfg.seed), key)
    role = F.when(
        label == cfg.benign,
        F.when(not_after(order, key, F.col("f.last_hash"), F.col("f.last_key")), "test").otherwise("train"),
    ).otherwise(F.when(label == F.col("f.held_out_attack"), "test").otherwise("train"))
    return (
        df.where(label.isNotNull())
        .withColumn("f", F.explode(table))
        .withColumn("role", role)
        .select("f.fold", "f.held_out_attack", "role", *map(quoted, df.columns))
    )


def loao_folds(df: DataFrame, key: str, cfg: FoldConfig = FoldConfig()) -> DataFrame:
    """All folds as one table: fold, held_out_attack, role (train or test) and the row.

    Benign rows are divided anew in every fold; the held-out attack is only ever tested.
    """
    return assign_folds(df, fold_table(df, key, cfg), key, cfg)


def fold_leakage(folds: DataFrame, key: str) -> DataFrame:
    """Rows found on both sides of a fold, per fold; all zero for a sound fold table."""
    sides = folds.groupBy("fold", key).agg(F.count_distinct("role").alias("sides"))
    return sides.groupBy("fold").agg(F.count_if(F.col("sides") > 1).alias("leaked_rows"))
