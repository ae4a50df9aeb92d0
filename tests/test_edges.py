"""Small frames for the edges of the semantics."""

import hashlib
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowguard.config import BoostConfig, DriftConfig, DualConfig, PrepConfig, RetrainingPolicy
from flowguard.operators import checks, drift, metrics, models, ordering, prep, registry, scoring, splits, weights
from flowguard.operators.attribution import shap_weights
from flowguard.plans import flow
from flowguard.sources import stores, traffic_csv
from flowguard.streaming import jobs


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def fails(df, match):
    with pytest.raises(Exception, match=match):
        df.collect()


# ---- preprocessing


def test_all_missing_feature_is_named(spark):
    df = frame(spark, [(1.0, None), (2.0, float("nan"))], "a double, b double")
    with pytest.raises(ValueError, match="b"):
        prep.fit_preprocessor(df, ["a", "b"])


def test_constant_feature_and_missing_cells(spark):
    df = frame(spark, [(1.0, 5.0), (None, 5.0), (float("nan"), 5.0), (3.0, 5.0)], "a double, c double")
    params = prep.fit_preprocessor(df, ["a", "c"], PrepConfig(clip_quantiles=(0.0, 1.0)))
    assert params.features[0].fill == 2.0 and params.features[1].std == 0.0
    rows = prep.transform(df, params).collect()
    assert [round(r.a, 6) for r in rows] == [round(v, 6) for v in (-1 / np.sqrt(0.5), 0, 0, 1 / np.sqrt(0.5))]
    assert {r.c for r in rows} == {0.0}
    with pytest.raises(ValueError, match="missing feature columns"):
        prep.transform(df.drop("c"), params)


def test_unscaled_passes_clipped_values(spark):
    df = frame(spark, [(float(i),) for i in range(11)], "a double")
    params = prep.fit_preprocessor(df, ["a"], PrepConfig(clip_quantiles=(0.1, 0.9), scale=False))
    assert sorted(r.a for r in prep.transform(df, params).collect())[:2] == [1.0, 1.0]


def test_unseen_label_fails(spark):
    df = frame(spark, [("a",), ("b",)], "label string")
    assert {r.label_id for r in prep.encode_labels(df, ["a", "b"]).collect()} == {0, 1}
    fails(prep.encode_labels(df, ["a"]), "label not seen in training")


# ---- checks


def test_layout_errors(spark):
    df = frame(spark, [(1.0, "x", "x", "x")], "a double, label string, attack_family string, source_file string")
    checks.require_valid(df, ["a"])
    with pytest.raises(ValueError, match="duplicate"):
        checks.require_layout(df.select("*", F.lit(1).alias("a")), ["a"])
    with pytest.raises(ValueError, match="attack_family"):
        checks.require_layout(df.drop("attack_family"), ["a"])
    with pytest.raises(ValueError, match="outside the schema"):
        checks.require_layout(df.withColumn("z", F.lit(1)), ["a"])
    with pytest.raises(ValueError, match="not_infinite"):
        checks.require_valid(df.withColumn("a", F.lit(float("-inf"))), ["a"])
    with pytest.raises(ValueError, match="no feature column"):
        checks.quality_summary(df, ["q"])


# ---- sources


def test_csv_tree(spark, tmp_path):
    for name, rows in {
        "benign_traffic.csv": "w,m\n1,2\n3,\n",
        "gafgyt_attacks/combo.csv": "w,m\n5,6\n",
        "mirai_attacks/udp.csv": "w,m\n7,8\n9,10\n",
    }.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(rows)
    benign, attacks = f"{tmp_path}/benign_traffic.csv", [f"{tmp_path}/{d}" for d in ("gafgyt_attacks", "mirai_attacks", "gone")]
    rows = traffic_csv.load(spark, benign, attacks).toPandas()
    assert rows.groupby("label").w.sum().to_dict() == {"benign": 4.0, "gafgyt_combo": 5.0, "mirai_udp": 16.0}
    assert set(rows.source_file) == {"benign_traffic.csv", "combo.csv", "udp.csv"}
    assert str(rows.w.dtype) == "float32" and rows.m.isna().sum() == 1
    capped = traffic_csv.load(spark, benign, attacks, "w", 1, f"{tmp_path}/cache")
    assert sorted(r.w for r in capped.collect()) == [1.0, 5.0, 7.0]
    # Another cap is not served from the cache of the first.
    assert traffic_csv.load(spark, benign, attacks, "w", 5, f"{tmp_path}/cache").count() == 5
    with pytest.raises(FileNotFoundError):
        traffic_csv.load(spark, f"{tmp_path}/none.csv", attacks)
    (tmp_path / "gafgyt_attacks/combo.csv").write_text("w,m\nabc,6\n")
    fails(traffic_csv.scan(spark, benign, attacks), "MALFORMED|Malformed|FAILFAST|CANNOT_PARSE|FAILED_READ")


@pytest.mark.parametrize("split_bytes", ["128m", "60"])
def test_row_cap_follows_the_file(spark, tmp_path, split_bytes):
    """Same-named files of two families are capped on their own, whether a file is one input split or many."""
    files = {"benign_traffic.csv": 3, "gafgyt_attacks/udp.csv": 40, "mirai_attacks/udp.csv": 25}
    for i, (name, n) in enumerate(files.items()):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text("w\n" + "".join(f"{1000 * i + (j * 7) % 41}\n" for j in range(n)))
    benign, attacks = f"{tmp_path}/benign_traffic.csv", [f"{tmp_path}/gafgyt_attacks", f"{tmp_path}/mirai_attacks"]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    try:
        for cap in (1, 25, 30):
            rows = traffic_csv.load(spark, benign, attacks, max_rows_per_file=cap).toPandas()
            for i, (label, n) in enumerate(zip(("benign", "gafgyt_udp", "mirai_udp"), files.values())):
                expected = sorted(1000.0 * i + (j * 7) % 41 for j in range(min(n, cap)))
                assert sorted(rows.w[rows.label == label]) == expected
        by_key = traffic_csv.load(spark, benign, attacks, "w", 2).toPandas()
        assert by_key.groupby("label").size().to_dict() == {"benign": 2, "gafgyt_udp": 2, "mirai_udp": 2}
        assert traffic_csv.scan(spark, benign, attacks, max_rows_per_file=0).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_prepare(spark):
    rng = np.random.default_rng(4)
    rows = pd.DataFrame({"id": range(300), "a": rng.normal(size=300), "b": 1.0, "z": 2.0})
    rows["label"] = np.where(rows.id % 3 == 0, "benign", "x_y")
    rows["attack_family"], rows["source_file"] = "f", "d/" + rows.label
    df = spark.createDataFrame(rows)
    data = flow.prepare(df, key="id", max_total_rows=200, max_feature_columns=2, device="absent")
    assert data.params.names == ["a", "b"] and data.classes == ("benign", "x_y")
    assert {r.split: r.rows for r in data.stats().collect()} == {"train": 140, "val": 20, "test": 40}
    assert data.quality.first().rows == 200
    with pytest.raises(ValueError, match="not_null"):
        flow.prepare(df.withColumn("label", F.when(F.col("id") > 0, F.col("label"))), key="id")


def test_missing_reports_and_splits(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        stores.read_report(spark, f"{tmp_path}/none", "a int")
    with pytest.raises(FileNotFoundError):
        stores.read_splits(spark, str(tmp_path))


# ---- metrics


def test_undefined_ratios_are_zero(spark):
    df = frame(spark, [(1, 0, 0.5), (1, 0, 0.5)], "y int, p int, s double")
    row = metrics.binary_metrics(df, "y", "p", "s").first()
    assert (row.accuracy, row.f1, row.precision, row.recall, row.auroc) == (0, 0, 0, 0, None)
    tied = frame(spark, [(1, 0.5), (0, 0.5)], "y int, s double")
    assert metrics.auroc(tied, "y", "s").first().auroc == 0.5


def test_two_class_evaluation_uses_column_one(spark):
    df = frame(spark, [(1, 1, [0.2, 0.8]), (0, 0, [0.9, 0.1]), (0, 1, [0.4, 0.6])], "y int, p int, q array<double>")
    row = metrics.evaluate_auto(df, "y", "p", "q").first()
    assert row.auroc == 1.0 and row.accuracy == pytest.approx(2 / 3)


# ---- drift


def test_psi_edges(spark):
    ref = frame(spark, [(float(i), 1.0, None) for i in range(100)], "a double, k double, e double")
    far = ref.withColumn("a", F.col("a") + 1000)
    names = ["a", "k", "e"]
    same = {r.feature: r for r in drift.feature_drift(ref, ref, names).collect()}
    assert same["a"].psi == 0 and same["a"].ks_statistic == 0 and same["a"].ks_pvalue == 1 and not same["a"].drifted
    assert same["k"].psi == 0
    assert same["e"].psi == 0 and same["e"].ks_statistic is None and not same["e"].drifted
    away = {r.feature: r for r in drift.feature_drift(ref, far, names).collect()}
    # All current values fall outside the reference range: every bin has the empty share.
    assert away["a"].psi == pytest.approx(10 * (0.0001 - 0.1) * np.log(0.0001 / 0.1))
    assert away["a"].ks_statistic == 1.0 and away["a"].drifted
    nothing = ref.withColumn("a", F.lit(None).cast("double"))
    assert {r.feature: r.psi for r in drift.feature_drift(ref, nothing, names).collect()}["a"] == 0
    with pytest.raises(ValueError, match="in common"):
        drift.feature_drift(ref, ref.select(F.col("a").alias("z")))
    with pytest.raises(ValueError, match="fewer than"):
        drift.feature_drift(ref, ref, names, DriftConfig(min_reference_rows=101))


def test_psi_matches_numpy(spark):
    rng = np.random.default_rng(8)
    ref, cur = rng.gamma(2, size=800).round(1), rng.gamma(2.4, size=600).round(1)
    edges = np.unique(np.quantile(ref, np.linspace(0, 1, 11)))
    r, c = np.histogram(ref, edges)[0], np.histogram(cur, edges)[0]
    r, c = np.where(r == 0, 1e-4, r / r.sum()), np.where(c == 0, 1e-4, c / c.sum())
    left, right = (spark.createDataFrame(pd.DataFrame({"x": v})) for v in (ref, cur))
    assert drift.feature_drift(left, right, ["x"]).first().psi == pytest.approx(float(((c - r) * np.log(c / r)).sum()))


def test_empty_drift_summary(spark):
    empty = spark.createDataFrame([], "feature string, psi double, drifted boolean")
    row = drift.drift_summary(empty).first()
    assert (row.drifted_feature_count, row.drifted_feature_ratio, row.max_psi, row.mean_psi) == (0, 0, 0, None)


def test_concept_levels(spark):
    rows = [(0.9, 0.9, 0.5, 0.9, 0.9, 0.5), (0.9, 0.9, 0.5, 0.8, 0.9, 0.5), (0.9, 0.9, 0.5, 0.8, 0.8, 0.5),
            (0.9, 0.9, 0.5, 0.8, 0.8, 0.9), (0.5, 0.5, 0.5, 0.9, 0.9, 0.5)]
    names = "ref_f1 double, ref_auroc double, ref_confidence_mean double, cur_f1 double, cur_auroc double, cur_confidence_mean double"
    out = drift.concept_drift(frame(spark, rows, names)).collect()
    assert [r.concept_severity for r in out] == ["low", "medium", "high", "critical", "low"]
    assert out[-1].f1_drop == 0


def test_retraining_policies(spark):
    df = frame(spark, [("low",), ("high",), ("odd",), (None,)], "severity string")

    def triggers(policy):
        return [(r.trigger, r.reason) for r in drift.retraining_decision(df, policy).collect()]

    below, reached = "severity below threshold", "severity threshold reached"
    assert triggers(RetrainingPolicy()) == [(False, below), (False, reached), (False, below), (False, below)]
    assert triggers(RetrainingPolicy(auto_trigger=True))[1] == (True, reached)
    assert triggers(RetrainingPolicy(enabled=False, auto_trigger=True)) == [(False, "retraining disabled")] * 4
    assert triggers(RetrainingPolicy(auto_trigger=True, min_severity="never"))[1][0] is True


# ---- scoring


def test_requests(spark):
    def items(n):
        return frame(spark, [("r", "[" + ",".join(['{"a":1}'] * n) + "]")], "id string, body string")

    assert scoring.explode_requests(items(1024)).count() == 1024
    fails(scoring.explode_requests(items(1025)), "1 to 1024")
    fails(scoring.explode_requests(items(0)), "1 to 1024")
    one = scoring.explode_requests(frame(spark, [("r", '[{"a":1,"x":2}]')], "id string, body string"))
    assert scoring.align_request(one, ["a"]).first().a == 1.0
    fails(scoring.align_request(one, ["a", "b", "c"]), "missing required features: b, c")
    lots = scoring.align_request(one, list("bcdefgh"), strict=False).first()
    assert lots.missing == list("bcdefgh")


def test_constant_batch_scores_zero(spark):
    df = frame(spark, [(0.7, 0.1), (0.7, 0.1)], "c double, r double")
    assert {r.dual_score for r in scoring.with_dual_score(df, "c", "r").collect()} == {0.0}
    with pytest.raises(ValueError):
        DualConfig(alpha=0.0, beta=0.0)
    with pytest.raises(RuntimeError):
        scoring.anomaly_flag("c", None)
    with pytest.raises(ValueError):
        scoring.with_dual_score(df, "c", "r", "fitted")
    empty = scoring.score_summary(df.limit(0).selectExpr("1 AS prediction", "c AS confidence")).first()
    assert (empty.total_items, empty.mean_confidence) == (0, 0.0)


def test_weights(spark):
    equal = frame(spark, [("a", 2.0), ("b", 2.0)], "feature string, weight double")
    assert weights.weight_map(weights.normalize_weights(equal)) == {"a": 1.0, "b": 1.0}
    spread = frame(spark, [("a", 0.0), ("b", 1.0), ("c", 4.0)], "feature string, weight double")
    assert weights.weight_map(weights.normalize_weights(spread)) == {"a": 0.05, "b": 0.25, "c": 1.0}
    with pytest.raises(ValueError, match="missing weighted columns"):
        weights.apply_weights(frame(spark, [(1.0,)], "a double"), {"a": 1.0, "z": 1.0})


# ---- registry


def test_gates_first_failure_wins(spark):
    names = "run_name string, baseline_f1_weighted double, hybrid_f1 double, fusion_f1 double, fusion_auroc double"
    exp = frame(spark, [("ok", 0.9, 0.9, 0.95, 0.99), ("f1", 0.9, 0.9, 0.6, 0.6), ("gap", 0.95, 0.9, 0.96, 0.99), ("none", None, None, None, None)], names)
    runs = frame(spark, [(r, a, f, 0.5) for r in ("ok", "f1", "gap") for a, f in (("x", 0.9), ("y", 0.6))],
                 "run_name string, held_out_attack string, f1 double, attack_rate_pred double")
    out = {r.run_name: r for r in registry.promotion_decision(exp, runs).collect()}
    assert out["ok"].approved and out["ok"].reason == "passed promotion gates" and out["ok"].champion_source == "fusion"
    assert out["f1"].reason == "fusion_f1 below threshold (0.6000 < 0.7000)"
    assert out["gap"].reason == "fusion_f1 does not improve enough over baseline (0.9600 - 0.9500 < 0.0200)"
    assert out["none"].champion_source == "none" and out["none"].loao_run_count == 0
    assert out["none"].loao_mean_attack_rate_pred is None
    again = {r.run_name: r.version for r in registry.promotion_decision(exp.repartition(3), runs).collect()}
    assert again == {k: v.version for k, v in out.items()} and len(set(again.values())) == 4


def test_fingerprint_ignores_order(spark):
    df = spark.range(500).selectExpr("id", "id % 7 AS m")
    first = registry.table_fingerprint(df).first().fingerprint
    assert first == registry.table_fingerprint(df.repartition(9).orderBy(F.desc("id"))).first().fingerprint
    assert first != registry.table_fingerprint(df.where("id > 0")).first().fingerprint
    assert first != registry.table_fingerprint(df.withColumnRenamed("m", "n")).first().fingerprint


def test_file_hashes(spark, tmp_path):
    import hashlib

    (tmp_path / "a.bin").write_bytes(b"model bytes")
    found = registry.file_hashes(spark.read.format("binaryFile").load(str(tmp_path))).first()
    assert found.hash == hashlib.sha256(b"model bytes").hexdigest()


# ---- rows and features that must not be lost


def test_cap_is_exact_with_ties_and_null_keys(spark):
    rows = [("a", 1.0, i) for i in range(50)] + [("b", None, i) for i in range(9)] + [("b", 2.0, 99), ("c", 1.0, 0)]
    df = frame(spark, rows, "g string, `k.ey` double, v int")
    kept = ordering.first_rows_per_group(df, "g", "k.ey", 5)
    assert {r.g: r["count"] for r in kept.groupBy("g").count().collect()} == {"a": 5, "b": 5, "c": 1}
    assert kept.where("v = 99").count() == 1
    again = ordering.first_rows_per_group(df.repartition(7), "g", "k.ey", 5)
    assert {tuple(r) for r in kept.collect()} == {tuple(r) for r in again.collect()}


def test_names_with_dots_and_more_than_25_features(spark):
    rng = np.random.default_rng(5)
    names = [f"MI_L0.{i}_w" for i in range(30)]
    rows = pd.DataFrame(rng.normal(size=(200, 30)), columns=names)
    rows["id"], rows["label"] = range(200), np.where(np.arange(200) % 2 == 0, "benign", "x_y")
    rows["attack_family"], rows["source_file"] = "f", "d"
    data = flow.prepare(spark.createDataFrame(rows), key="id", cfg=PrepConfig(impute_strategy="mean"))
    assert data.params.names == names
    train = data.split("train")
    model = models.fit_boosted(train, names[:3], ["benign", "x_y"], cfg=BoostConfig(trees=2, depth=2, early_stopping=False))
    assert model.attack_score(data.table).where("clf_score IS NULL").isEmpty()
    assert shap_weights(model, train, "row_key").count() == 3
    assert drift.feature_drift(train, data.split("test"), names[:2]).count() == 2
    assert {r.feature for r in weights.mean_magnitude(train, names[:2]).collect()} == set(names[:2])


def test_empty_load_is_never_cached(spark, tmp_path):
    (tmp_path / "benign.csv").write_text("w,m\n")
    for _ in range(2):
        with pytest.raises(RuntimeError, match="no rows"):
            traffic_csv.load(spark, str(tmp_path / "benign.csv"), [], cache_dir=str(tmp_path / "cache"))


def test_drift_against_an_empty_side_has_no_p_value(spark):
    some = frame(spark, [(float(i),) for i in range(20)], "a double")
    row = drift.kolmogorov_smirnov(some, some.where("a < 0"), ["a"]).first()
    assert row.ks_statistic is None and row.ks_pvalue is None
    assert drift.feature_drift(some, some.where("a < 0"), ["a"]).first().drifted is False


def test_null_scores_stay_null(spark):
    df = frame(spark, [(None, 0.5), (0.2, 0.5)], "c double, r double")
    for span in ((0.0, 1.0), (0.0, 0.0)):
        fitted = scoring.SignalRange(span, (0.0, 1.0))
        found = scoring.with_dual_score(df, "c", "r", "fitted", fitted).collect()
        assert found[0].dual_score is None and found[1].dual_score is not None


def test_fingerprint_tells_cells_apart(spark):
    prints = {
        registry.table_fingerprint(frame(spark, [r], "a string, b string")).first().fingerprint
        for r in [("a|b", "c"), ("a", "b|c"), (None, "c"), ("-", "c"), ("<null>", "c")]
    }
    assert len(prints) == 5


def test_streamed_header_must_match(spark, tmp_path):
    (tmp_path / "benign.csv").write_text("m,w\n1,2\n")
    with pytest.raises(Exception):
        jobs.write_available(jobs.csv_stream(spark, str(tmp_path), ["w", "m"]), "reordered").collect()


def test_null_labels_raise_in_folds(spark):
    df = frame(spark, [(1, "benign"), (2, "benign"), (3, "x"), (4, None)], "k int, label string")
    with pytest.raises(ValueError, match="nulls"):
        splits.loao_folds(df, "k")


def decided(spark, names):
    metrics = {"baseline_f1_weighted": 0.5, "hybrid_f1": 0.6, "fusion_f1": 0.9, "fusion_auroc": 0.9}
    experiments = spark.createDataFrame(pd.DataFrame([{"run_name": n, **metrics} for n in names]))
    runs = frame(spark, [(n, 0.8, 0.5) for n in names for _ in range(2)], "run_name string, f1 double, attack_rate_pred double")
    return registry.promotion_decision(experiments, runs)


def test_manifests_are_appended_whole_and_read_from_the_listing(spark, tmp_path):
    folder = str(tmp_path / "manifests")
    assert registry.stored_manifests(spark, folder).count() == 0 and stores.published(spark, folder) == []
    none = registry.champion_model(registry.stored_manifests(spark, folder, latest=True)).first()
    assert (none.model_version, none.champion_source) == ("unversioned", "unknown")
    first = registry.publish_manifests(decided(spark, ["a", "b"]), folder, F.lit(1))
    second = registry.publish_manifests(decided(spark, ["c"]), folder, F.lit(2))
    # What a job that died has left is not read.
    (tmp_path / "manifests" / "_unfinished-0").mkdir()
    (tmp_path / "manifests" / "_unfinished-0" / "part-0.json").write_text('{"run_name": "half')
    assert stores.published(spark, folder) == [first, second]
    stored = registry.stored_manifests(spark, folder)
    assert {(r.run_name, r.batch) for r in stored.collect()} == {("a", first[6:]), ("b", first[6:]), ("c", second[6:])}
    latest = registry.stored_manifests(spark, folder, latest=True).collect()
    assert [r.run_name for r in latest] == ["c"] and latest[0].version_info.promoted_from == registry.PROMOTED_FROM
    assert registry.champion_model(stored).first().model_version == latest[0].version
    expected = hashlib.sha256(b'{"exp1":"c","exp2":2}').hexdigest()
    assert latest[0].data_hash == expected and latest[0].metrics.loao_run_count == 2.0
    # A batch that fails is not published.
    with pytest.raises(Exception):
        registry.publish_manifests(decided(spark, ["d"]), folder, F.raise_error(F.lit("stop")))
    assert stores.published(spark, folder) == [first, second]


def test_quality_report_nests_the_null_group(spark, tmp_path):
    rows = [(1.0, "x", "f", "s"), (None, "x", "g", "s"), (2.0, None, "g", "s"), (3.0, None, None, "s")]
    df = frame(spark, rows, "a double, label string, attack_family string, source_file string")
    stores.write_report(checks.quality_report(df), str(tmp_path / "q"))
    found = stores.read_report(spark, str(tmp_path / "q"), checks.REPORT_SCHEMA).first()
    assert (found.rows, found.columns, found.feature_columns, found.missing_ratio) == (4, 4, 1, 0.25)
    assert found.label_distribution == {"x": 2, "NaN": 2}
    assert found.family_distribution == {"f": 1, "g": 2, "NaN": 1}
    empty = checks.quality_report(df.where("a > 9")).first()
    assert empty.rows == 0 and empty.label_distribution == {}


def test_report_documents_survive_the_store(spark, tmp_path):
    values = frame(spark, [("r 1", "fusion_binary", 0, "f1", 0.5), ("r,2", "fusion_binary", 0, "f1", None)], "run_name string, model string, position int, metric string, value double")
    artifacts = frame(spark, [("r 1", 0, "m", "models/m")], "run_name string, position int, name string, location string")
    lines = metrics.report_lines(values, artifacts, "run_name", ["run_name"])
    stores.write_documents(metrics.report_documents(lines, ["run_name"]), str(tmp_path / "r"), "report")
    back = metrics.document_lines(stores.read_documents(spark, str(tmp_path / "r"), "report")).collect()
    found = [r.line for r in sorted((r for r in back if r.run_name == "r 1"), key=lambda r: r.line_no)]
    assert found[0] == "# Experiment Report: r 1" and "- f1: 0.500000" in found and found[-1] == "- m: models/m"
    assert {r.run_name for r in back} == {"r 1", "r,2"}


def test_tree_is_written_in_one_pass_and_few_files(spark, tmp_path):
    paths = ["dev/benign_traffic.csv", "dev/my_x_attacks/a b=1.csv", "dev/y_attacks/scan.csv"]
    rows = spark.range(0, 3000, 1, 60).select((F.col("id") * 1.0).alias("a"), F.element_at(F.array(*map(F.lit, paths)), (F.col("id") % 3 + 1).cast("int")).alias("p"))
    assert traffic_csv.write_tree(rows, "p", str(tmp_path), ["a"]) == sorted(paths)
    assert sorted(str(f.relative_to(tmp_path)) for f in tmp_path.glob("*/**/*.csv") if f.is_dir()) == sorted(paths)
    # As many files as the cores ask for, however many partitions the rows have.
    assert len([f for f in tmp_path.glob("**/part-*.csv") if f.is_file()]) <= 2 * spark.sparkContext.defaultParallelism + len(paths)
    back = traffic_csv.load(spark, f"{tmp_path}/dev/benign_traffic.csv", [f"{tmp_path}/dev/my_x_attacks", f"{tmp_path}/dev/y_attacks"])
    assert {(r.label, r.attack_family): r.n for r in back.groupBy("label", "attack_family").agg(F.countDistinct("a").alias("n")).collect()} == {
        ("benign", "benign"): 1000, ("my_x_a%20b=1", "my_x"): 1000, ("y_scan", "y"): 1000,
    }
    with pytest.raises(ValueError, match="source path"):
        traffic_csv.write_tree(rows.withColumn("p", F.lit(None).cast("string")), "p", str(tmp_path), ["a"])


def test_long_folder_names_cost_no_square_of_their_length(spark):
    at = lambda p: tuple(spark.createDataFrame([(p,)], "p string").select(*traffic_csv.path_columns("p").values()).first())
    assert at("x_attacks/y_attacks/z.csv.csv") == ("y_z.csv", "y", "z.csv.csv")
    assert at("/_attacks/.csv/b.csv/part-0.csv") == ("benign", "benign", "b.csv")
    start = time.time()
    assert at("/".join(["n" * 30_000] * 3) + "/q_attacks/r.csv") == ("q_r", "q", "r.csv")
    assert time.time() - start < 5
