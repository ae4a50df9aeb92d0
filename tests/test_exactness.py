"""Order statistics, samples, splits and running totals against brute force, with tiny bounds so that the large-data paths run."""

import math
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowguard.config import FoldConfig, SplitConfig
from flowguard.operators import metrics, ordering, quantiles, splits
from flowguard.operators.drift import exact_tail, kolmogorov_smirnov
from flowguard.session import attach_rows


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(3)
    n = 6000
    a = rng.normal(size=n)
    a[rng.random(n) < 0.35] = 0.25  # one value holds a third of the rows
    frame = pd.DataFrame({"key": np.arange(n), "a": a, "b": np.round(rng.exponential(size=n) * 3)})
    return frame, spark.createDataFrame(frame).withColumn("empty", F.lit(None).cast("double"))


@pytest.mark.parametrize("bounds", [{}, {"direct_rows": 0}, {"direct_rows": 0, "exact_rows": 2}])
def test_exact_quantiles(numbers, bounds):
    frame, df = numbers
    levels = [0, 0.001, 0.1, 0.5, 0.63, 0.95, 0.999, 1]
    found = quantiles.exact_quantiles(df, ["a", "b", "empty"], levels, **bounds)
    for c in ("a", "b"):
        assert np.allclose(found[c], np.quantile(frame[c], levels), atol=1e-12)
    assert found["empty"] is None


@pytest.mark.parametrize("exact_rows", [10**6, 25])
def test_kth_smallest_per_group(numbers, exact_rows):
    frame, df = numbers
    rows = df.select(F.when(F.col("b") > 2, "x").otherwise("y").alias("group"), F.col("a").alias("value"))
    groups = {"x": np.sort(frame.a[frame.b > 2]), "y": np.sort(frame.a[frame.b <= 2])}
    ranks = {g: [0, 5, len(v) // 2, len(v) - 1] for g, v in groups.items()}
    found = quantiles.kth_smallest(rows, ranks, exact_rows)
    assert found == {(g, k): groups[g][k] for g in groups for k in ranks[g]}


def test_first_rows_per_group(numbers):
    frame, df = numbers
    rows = df.withColumn("source", F.when(F.col("b") > 3, "small").otherwise("large"))
    kept = ordering.first_rows_per_group(rows, "source", "key", 700).toPandas()
    for name, part in frame.assign(source=np.where(frame.b > 3, "small", "large")).groupby("source"):
        assert sorted(kept.key[kept.source == name]) == sorted(part.key)[:700]
    assert ordering.first_rows_per_group(rows, "source", "key", 0).count() == 0
    assert ordering.first_rows_per_group(rows, "source", "key", 10**6).count() == len(frame)


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_sample_is_exact_and_independent_of_partitioning(numbers, parts):
    _, df = numbers
    picked = ordering.exact_sample(df.repartition(parts), "key", 777, 42)
    again = ordering.exact_sample(df.orderBy(F.desc("key")), "key", 777, 42)
    keys = {r.key for r in picked.select("key").collect()}
    assert len(keys) == 777
    assert keys == {r.key for r in again.select("key").collect()}
    assert ordering.exact_sample(df, "key", 10**9, 42).count() == df.count()
    assert ordering.exact_sample(df, "key", 0, 42).count() == 0


def test_cutoffs_do_not_depend_on_the_prefix_length(numbers, monkeypatch):
    _, df = numbers
    rows = df.select(F.lit("g").alias("group"), F.md5(F.col("key").cast("string")).alias("hash"), F.col("key").cast("string").alias("key"))
    expected = sorted((r.hash, r.key) for r in rows.collect())[1233]
    for digits in (1, 2, 4):
        monkeypatch.setattr(ordering, "prefix_digits", lambda _: digits)
        assert ordering.hash_cutoffs(rows, [("g", "c", 1234)], 6000) == {("g", "c"): expected}


def test_lookup_beyond_the_broadcast_bound(numbers):
    _, df = numbers
    table = [(float(b), f"n{b}") for b in range(0, 20, 2)]
    joins = [attach_rows(df, table, "b double, name string", ["b"], max_rows=m) for m in (0, 100)]
    assert "BroadcastHashJoin" in joins[1]._jdf.queryExecution().executedPlan().toString()
    counts = [{r.name: r["count"] for r in j.groupBy("name").count().collect()} for j in joins]
    assert counts[0] == counts[1] and sum(counts[0].values()) == df.count()


def test_prefix_digits_grow_with_the_group():
    assert [ordering.prefix_digits(n) for n in (10, 2 * 10**6, 10**9, 10**12)] == [1, 2, 4, 5]


def test_shuffle_rank_is_a_permutation(numbers):
    frame, df = numbers
    ranks = sorted(r.shuffle_rank for r in ordering.shuffle_rank(df, "key", 7).select("shuffle_rank").collect())
    assert ranks == list(range(1, len(frame) + 1))


def test_stratified_split_counts(spark):
    sizes = {"benign": 503, "a": 31, "b": 7, "c": 2}
    rows = [(f"{c}{i}", c) for c, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "row_key string, label string")
    out = splits.stratified_split(df, "label", "row_key").toPandas()
    n = len(rows)
    n_test = math.ceil(0.2 * n)
    n_val = math.ceil(0.125 * (n - n_test))
    assert out.split.value_counts().to_dict() == {"train": n - n_test - n_val, "val": n_val, "test": n_test}
    assert len(out) == n and out.row_key.is_unique
    for c, size in sizes.items():
        assert abs((out[out.label == c].split == "test").sum() - 0.2 * size) <= 1
    other = splits.stratified_split(df.repartition(5), "label", "row_key").toPandas()
    assert out.set_index("row_key").split.to_dict() == other.set_index("row_key").split.to_dict()


def test_split_errors(spark):
    df = spark.createDataFrame([("1", "a"), ("2", "a"), ("3", "b")], "row_key string, label string")
    with pytest.raises(ValueError, match="fewer than two"):
        splits.stratified_split(df, "label", "row_key")
    with pytest.raises(KeyError):
        splits.stratified_split(df, "absent", "row_key")
    for bad in ({"test_size": 0.0}, {"val_size": 1.0}, {"test_size": 0.6, "val_size": 0.4}):
        with pytest.raises(ValueError):
            SplitConfig(**bad)


def test_folds(spark):
    rows = [(i, c) for i, c in enumerate(["benign"] * 11 + ["x"] * 4 + ["y"] * 3)]
    df = spark.createDataFrame(rows, "row_key bigint, label string")
    folds = splits.loao_folds(df, "row_key").toPandas()
    assert folds.groupby("fold").held_out_attack.first().to_dict() == {0: "x", 1: "y"}
    for _, part in folds.groupby("fold"):
        assert part.row_key.is_unique and len(part) == len(rows)
        test = part[part.role == "test"]
        assert (test.label == "benign").sum() == math.ceil(0.3 * 11)
        assert set(test.label) == {"benign", part.held_out_attack.iloc[0]}
        assert part.held_out_attack.iloc[0] not in set(part[part.role == "train"].label)
    first, second = (set(folds[(folds.fold == f) & (folds.role == "test") & (folds.label == "benign")].row_key) for f in (0, 1))
    assert first != second
    for few in (0, 1):
        with pytest.raises(ValueError):
            splits.loao_folds(df.where(f"label <> 'benign' OR row_key < {few}"), "row_key", FoldConfig())


def brute_auroc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return ((pos[:, None] > neg[None]).sum() + 0.5 * (pos[:, None] == neg[None]).sum()) / (len(pos) * len(neg))


@pytest.mark.parametrize("rows_per_bucket", [10**6, 40])
def test_auroc_and_roc(spark, rows_per_bucket):
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({"g": rng.integers(0, 2, 900), "y": rng.integers(0, 2, 900)})
    frame["s"] = np.where(rng.random(900) < 0.33, 0.5, np.round(rng.random(900) + 0.2 * frame.y, 2))
    df = spark.createDataFrame(frame)
    for r in metrics.auroc(df, "y", "s", ["g"], rows_per_bucket).collect():
        part = frame[frame.g == r.g]
        assert r.auroc == pytest.approx(brute_auroc(part.y.to_numpy(), part.s.to_numpy()), abs=1e-12)
    flipped = metrics.auroc(df.withColumn("s", -F.col("s")), "y", "s", rows_per_bucket=rows_per_bucket).first().auroc
    assert flipped == pytest.approx(1 - brute_auroc(frame.y.to_numpy(), frame.s.to_numpy()), abs=1e-12)
    points = metrics.roc_points(df, "y", "s", rows_per_bucket=rows_per_bucket).toPandas()
    assert len(points) == frame.s.nunique()
    for r in points.itertuples():
        assert r.tpr == pytest.approx((frame.s[frame.y == 1] >= r.threshold).mean())
        assert r.fpr == pytest.approx((frame.s[frame.y == 0] >= r.threshold).mean())


@pytest.mark.parametrize("rows_per_bucket", [10**6, 50])
def test_kolmogorov_smirnov(spark, rows_per_bucket):
    rng = np.random.default_rng(6)
    ref = pd.DataFrame({"u": rng.normal(size=700), "v": np.where(rng.random(700) < 0.4, 1.0, rng.random(700).round(2))})
    cur = pd.DataFrame({"u": rng.normal(0.2, size=500), "v": rng.random(500).round(2)})
    found = kolmogorov_smirnov(spark.createDataFrame(ref), spark.createDataFrame(cur), ["u", "v"], rows_per_bucket)
    for r in found.collect():
        c = ["u", "v"][r.feature_id]
        both = np.sort(np.concatenate([ref[c], cur[c]]))
        gap = np.searchsorted(np.sort(ref[c]), both, "right") / 700 - np.searchsorted(np.sort(cur[c]), both, "right") / 500
        assert r.ks_statistic == pytest.approx(np.abs(gap).max(), abs=1e-12)


def merged_orders(n, m):
    """Largest distance, times n * m, of every order in which n and m values can be merged."""
    for chosen in combinations(range(n + m), n):
        steps = np.isin(np.arange(n + m), chosen)
        yield int(np.abs(np.cumsum(steps) * m - np.cumsum(~steps) * n).max())


@pytest.mark.parametrize("n, m", [(1, 1), (1, 8), (3, 5), (4, 6), (6, 6), (8, 7), (8, 8)])
def test_exact_tail_counts_all_merged_orders(n, m):
    found = np.array(list(merged_orders(n, m)))
    for reach in {*found.tolist(), 0, n * m}:
        assert exact_tail(reach / (n * m), n, m) == pytest.approx((found >= reach).mean(), abs=1e-13)


def test_exact_tail_is_near_the_series_for_large_samples_and_keeps_small_values():
    distance = 0.02
    lam2 = distance**2 * 10_000 * 9_000 / 19_000
    series = 2 * sum((-1) ** (k - 1) * np.exp(-2 * k * k * lam2) for k in range(1, 50))
    assert exact_tail(distance, 10_000, 9_000) == pytest.approx(series, rel=0.05)
    # Of all orders only two keep the samples apart.
    assert exact_tail(1.0, 40, 40) == pytest.approx(2 / math.comb(80, 40), rel=1e-9)


def test_pvalue_is_exact_up_to_the_bound_and_asymptotic_beyond(spark):
    rng = np.random.default_rng(5)
    ref, cur = rng.normal(size=30), rng.normal(0.8, size=25)
    sides = [spark.createDataFrame([(float(v), float(v) if i < 9 else None, None) for i, v in enumerate(x)], "a double, b double, c double") for x in (ref, cur)]
    found = {r.feature_id: r for r in kolmogorov_smirnov(*sides, ["a", "b", "c"], exact_rows=20).collect()}
    whole = {r.feature_id: r for r in kolmogorov_smirnov(*sides, ["a", "b", "c"]).collect()}
    assert whole[0].ks_pvalue == exact_tail(whole[0].ks_statistic, 30, 25)
    assert found[1].ks_pvalue == whole[1].ks_pvalue == exact_tail(found[1].ks_statistic, 9, 9)
    lam2 = found[0].ks_statistic ** 2 * 30 * 25 / 55
    series = 2 * sum((-1) ** (k - 1) * np.exp(-2 * k * k * lam2) for k in range(1, 101))
    assert found[0].ks_pvalue == pytest.approx(series, abs=1e-12) and found[0].ks_pvalue != whole[0].ks_pvalue
    # Neither a feature without values nor a table beyond the bound is read by Python.
    assert 2 not in whole
    plan = kolmogorov_smirnov(*sides, ["a", "b", "c"], exact_rows=5)._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan
