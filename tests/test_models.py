"""Model behaviour on a small separable table."""

from dataclasses import replace
from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowguard.config import AutoencoderConfig, BoostConfig, HybridConfig, PrepConfig
from flowguard.operators import attribution, autoencoder, models, scoring
from flowguard.plans import hybrid
from flowguard.streaming import jobs
from flowguard.operators.monitor import session_metrics, window_metrics

FEATURES = ["a", "b", "c"]
SMALL = HybridConfig(
    boost=BoostConfig(trees=3, depth=2),
    autoencoder=AutoencoderConfig(hidden=(8,), latent=2, epochs=5, batch_size=32),
    multiclass=False,
)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    n = 600
    label = rng.choice(["benign", "x", "y"], n, p=[0.5, 0.3, 0.2])
    a = rng.normal(size=n) + 4 * (label == "x")
    b = a * 0.5 + 0.1 * rng.normal(size=n) - 4 * (label == "y")
    frame = pd.DataFrame({"row_key": np.arange(n), "label": label, "a": a, "b": b, "c": rng.normal(size=n)})
    frame["split"] = rng.choice(["train", "val", "test"], n, p=[0.6, 0.2, 0.2])
    return spark.createDataFrame(frame).cache()


@pytest.fixture(scope="module")
def binary(rows):
    train = rows.where("split = 'train'").withColumn("label", F.when(F.col("label") == "benign", "benign").otherwise("attack"))
    return models.fit_boosted(train, FEATURES, ["benign", "attack"], cfg=SMALL.boost)


def test_probabilities_sum_to_one(rows):
    cfg = replace(SMALL.boost, trees=2)
    val = rows.where("split = 'val'")
    model = models.fit_boosted(rows.where("split = 'train'"), FEATURES, ["benign", "x", "y"], cfg=cfg, validation=val)
    out = model.predict_proba(val).select("label", "proba", models.argmax_class("proba").alias("p")).collect()
    assert all(abs(sum(r.proba) - 1) < 1e-9 for r in out)
    assert np.mean([["benign", "x", "y"][r.p] == r.label for r in out]) > 0.8


def test_attribution_is_exact(spark, rows, binary):
    leaves = attribution.tree_leaves(spark, binary.models[0])
    x = np.array([[r.a, r.b, r.c] for r in rows.limit(40).collect()])
    phi = attribution.shapley_values(x, leaves, 3)
    raw = binary.models[0].setRawPredictionCol("raw").setFeaturesCol("features").transform(models.assembled(rows.limit(40), FEATURES))
    margin = np.array([r.raw[1] for r in raw.select("raw").collect()])
    assert np.allclose(np.sort(phi.sum(axis=1) + attribution.expected_value(leaves)), np.sort(margin), atol=1e-9)

    def conditional(row, known):
        total = 0.0
        for value, features, above, upto, share in leaves:
            for f, lo, hi, part in zip(features, above, upto, share):
                value *= float(lo < row[f] <= hi) if f in known else part
            total += value
        return total

    for i in range(3):
        others = [j for j in range(3) if j != i]
        brute = sum(
            factorial(k) * factorial(2 - k) / 6 * (conditional(x[0], {*s, i}) - conditional(x[0], set(s)))
            for k in range(3)
            for s in combinations(others, k)
        )
        assert phi[0, i] == pytest.approx(brute, abs=1e-12)


def test_weights_prefer_the_informative_features(rows, binary):
    found = {r.feature: r.weight for r in attribution.shap_weights(binary, rows, "row_key", 200).collect()}
    assert set(found) == set(FEATURES) and found["c"] < max(found["a"], found["b"])


def test_gradient_of_the_network():
    cfg = AutoencoderConfig(hidden=(5,), latent=2)
    sizes = autoencoder.layer_sizes(3, cfg)
    flat = autoencoder.flatten(autoencoder.initial_layers(3, cfg))
    x, w = np.random.default_rng(1).normal(size=(7, 3)), np.array([1.0, 0.5, 2.0])
    _, grad = autoencoder.loss_gradient(x, autoencoder.unflatten(flat, sizes), w)
    for i in range(0, len(flat), 9):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        up, _ = autoencoder.loss_gradient(x, autoencoder.unflatten(flat + step, sizes), w)
        down, _ = autoencoder.loss_gradient(x, autoencoder.unflatten(flat - step, sizes), w)
        assert grad[i] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_autoencoder_learns_benign_rows(spark, rows):
    benign = rows.where("label = 'benign'").repartition(3)
    cfg = AutoencoderConfig(hidden=(8,), latent=2, epochs=12, batch_size=16, learning_rate=0.01, replicas=3)
    model = autoencoder.fit_autoencoder(benign, FEATURES, {"a": 1.0, "b": 2.0}, cfg)
    assert model.weights == (1.0, 2.0, 1.5)
    assert model.losses[-1] < model.losses[0]
    scored = model.add_error(rows)
    mean = {r.attack: r.e for r in scored.groupBy((F.col("label") != "benign").alias("attack")).agg(F.avg("rec_error").alias("e")).collect()}
    assert mean[True] > mean[False]
    back = autoencoder.Autoencoder.from_frame(model.to_frame(spark))
    assert np.array_equal(back.flat, model.flat) and back.features == model.features and back.weights == model.weights
    with pytest.raises(ValueError, match="missing feature columns"):
        model.add_error(rows.drop("b"))


def test_fusion_is_at_the_optimum(rows):
    table = rows.withColumn("y", (F.col("label") != "benign").cast("int"))
    model = models.fit_fusion(table, FEATURES, "y")
    pdf = table.toPandas()
    x, y = pdf[FEATURES].to_numpy(), pdf.y.to_numpy()
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    p = 1 / (1 + np.exp(-(x @ np.array(model.weights) + model.intercept)))
    gradient = x.T @ (w * (p - y)) + np.array(model.weights)
    assert np.abs(gradient).max() < 1e-6 and abs((w * (p - y)).sum()) < 1e-6
    with pytest.raises(ValueError, match="both classes"):
        models.fit_fusion(table.where("y = 1"), FEATURES, "y")
    with pytest.raises(ValueError, match="gaps: 1 "):
        models.fit_fusion(table.withColumn("b", F.expr("CASE WHEN row_key = 0 THEN NULL ELSE b END")), FEATURES, "y")


def test_fusion_settles_on_signals_of_any_scale(spark):
    rng = np.random.default_rng(8)
    y = rng.integers(0, 2, 400)
    # Separable in one signal, a huge and a tiny one, and a constant.
    pdf = pd.DataFrame({"u": y + rng.random(400) / 4, "v.1": rng.normal(y, 1) * 1e6, "w": rng.normal(size=400) * 1e-7, "k": 3.0, "y": y})
    names = ["u", "v.1", "w", "k"]
    model = models.fit_fusion(spark.createDataFrame(pdf), names, "y")
    x, w = pdf[names].to_numpy(), np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    p = 1 / (1 + np.exp(-(x @ np.array(model.weights) + model.intercept)))
    gradient = x.T @ (w * (p - y)) + np.array(model.weights)
    assert (np.abs(gradient) < 1e-7 * np.abs(x).sum(axis=0)).all() and abs((w * (p - y)).sum()) < 1e-6
    assert model.weights[0] > 1


def test_hybrid_run_and_store(spark, rows, tmp_path):
    run = hybrid.fit_hybrid(rows, FEATURES, SMALL)
    found = {(r.model, r.metric): r.value for r in hybrid.run_metrics(run).collect()}
    assert found[("fusion_binary", "auroc")] > 0.9 and found[("fusion_binary", "f1")] > 0.8
    first, reused = hybrid.fit_or_load(rows, FEATURES, SMALL, str(tmp_path))
    second, again = hybrid.fit_or_load(rows.repartition(3), FEATURES, SMALL, str(tmp_path))
    assert (reused, again) == (False, True)

    def scores(model, mode):
        return {r.row_key: (r.confidence, r.prediction, r.predicted_label) for r in model.score(rows, mode).collect()}

    assert scores(first, "fitted") == scores(second, "fitted")
    assert {r.anomaly_score for r in first.score(rows, "row").collect()} == {0.0}
    assert hybrid.run_hash(rows, SMALL) != hybrid.run_hash(rows, replace(SMALL, weighting="shap"))


def test_folds_with_and_without_refit(rows):
    cfg = replace(SMALL, weighting="shap", attribution_rows=100)
    plain = hybrid.loao_experiment(rows.drop("split"), FEATURES, cfg).collect()
    assert {r.held_out_attack for r in plain} == {"x", "y"} and all(0 <= r.f1 <= 1 for r in plain)
    refit = hybrid.loao_experiment(rows.drop("split"), FEATURES, replace(cfg, weighting="importance"), refit=PrepConfig()).collect()
    assert {r.heldout_rows for r in refit} == {r.heldout_rows for r in plain}
    scores = hybrid.loao_scores(rows.drop("split"), FEATURES, cfg, at_once=2)
    again = hybrid.metrics.fold_f1(scores, "y", "prediction", ["fold", "held_out_attack"]).collect()
    assert {(r.fold, r.held_out_attack, r.heldout_rows) for r in again} == {(r.fold, r.held_out_attack, r.heldout_rows) for r in plain}
    attack = scores.join(rows.select("row_key", "label"), "row_key").where("y = 1")
    assert attack.where("label <> held_out_attack").isEmpty() and attack.count() == sum(r.heldout_rows for r in plain) - scores.where("y = 0").count()
    summary = hybrid.loao_summary(scores.select("held_out_attack").distinct()).first()
    assert summary.total_runs == 2 and summary.held_out_attacks == ["x", "y"]
    with pytest.raises(ValueError, match="no attack label"):
        hybrid.loao_scores(rows.drop("split").where("label = 'benign'"), FEATURES, cfg)
    with pytest.raises(ValueError, match="unknown weighting"):
        hybrid.fit_hybrid(rows, FEATURES, replace(SMALL, weighting="other"))


def test_autoencoder_does_not_depend_on_input_splits(spark, rows):
    benign = rows.where("label = 'benign'")
    cfg = AutoencoderConfig(hidden=(4,), latent=2, epochs=2, batch_size=16, replicas=2)
    one, many = (autoencoder.fit_autoencoder(benign.repartition(n), FEATURES, cfg=cfg) for n in (1, 7))
    assert np.allclose(one.flat, many.flat, rtol=0, atol=1e-12) and np.allclose(one.losses, many.losses)
    with pytest.raises(ValueError, match="replicas"):
        AutoencoderConfig(replicas=0)
    with pytest.raises(ValueError, match="no benign rows"):
        autoencoder.fit_autoencoder(benign.limit(0), FEATURES, cfg=cfg)


def test_batch_scores_do_not_change_when_signals_are_stored(rows):
    run = hybrid.fit_hybrid(rows, FEATURES, SMALL)
    found = {r.row_key: r for r in run.model.score(rows, normalize="batch").collect()}
    lazy = scoring.with_dual_score(run.model.signals(rows), "clf_score", "rec_error", "batch", cfg=SMALL.dual)
    for r in scoring.fuse(lazy, run.model.fusion.weights, run.model.fusion.intercept).collect():
        assert found[r.row_key].confidence == pytest.approx(r.confidence, abs=1e-9)


def test_late_rows_are_dropped(spark, tmp_path):
    """Append mode emits a window once and ignores rows behind the watermark."""
    schema = "ts timestamp, endpoint string, status int, latency_ms double"
    batches = [
        [("2024-01-01 00:05:00", "a", 200, 1.0), ("2024-01-01 02:00:00", "a", 500, 2.0)],
        [("2024-01-01 05:00:00", "a", 200, 3.0)],
        # Spark drops by the watermark that the batch before the last one left behind.
        [("2024-01-01 00:06:00", "a", 200, 9.0), ("2024-01-01 09:00:00", "a", 200, 3.0)],
    ]
    folder = f"{tmp_path}/log"
    for i, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, "ts string, endpoint string, status int, latency_ms double")
        frame.selectExpr("CAST(ts AS timestamp) AS ts", "endpoint", "status", "latency_ms").coalesce(1).write.parquet(f"{folder}/b={i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)
    out = jobs.write_available(jobs.windowed_requests(stream, "1 hour"), "late").collect()
    found = {r.window_start.hour: r.requests for r in out}
    batch = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(folder)
    whole = {r.window_start.hour: r.requests for r in window_metrics(batch, "1 hour").collect()}
    assert whole[0] == 2 and found[0] == 1 and found[2] == 1
    # Complete mode without watermark keeps late rows and open windows: it equals the batch result.
    full = jobs.write_complete(jobs.windowed_requests(stream, "1 hour", delay=None), "complete").collect()
    assert {r.window_start.hour: r.requests for r in full} == whole


def test_sessions_in_complete_mode_equal_the_batch(spark, tmp_path):
    minutes = [("c", 0), ("c", 4), ("c", 30), ("d", 2), ("c", 33), ("c", 2), (None, 5)]
    folder = f"{tmp_path}/log"
    for i, (client, m) in enumerate(minutes):
        frame = spark.createDataFrame([(client, f"2024-01-01 00:{m:02d}:00", 200)], "client string, ts string, status int")
        frame.selectExpr("client", "CAST(ts AS timestamp) AS ts", "status").write.parquet(f"{folder}/b={i}")
    schema = "client string, ts timestamp, status int"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).option("recursiveFileLookup", True).parquet(folder)
    got = jobs.write_complete(jobs.client_sessions(stream, "10 minutes", delay=None), "sessions")
    assert spark.conf.get(jobs.MERGE_SESSIONS) == "true"
    batch = session_metrics(spark.read.schema(schema).option("recursiveFileLookup", True).parquet(folder), "10 minutes")
    assert got.exceptAll(batch).isEmpty() and batch.exceptAll(got).isEmpty() and got.count() >= 3


def test_requests_and_streams_score_like_the_prepared_table(spark, tmp_path):
    """A stream that is stopped and started anew scores every item once, as the batch does."""
    from flowguard.operators import prep
    from flowguard.session import scratch_path

    rng = np.random.default_rng(2)
    frame = pd.DataFrame({"row_key": np.arange(120), "label": rng.choice(["benign", "x", "y"], 120)})
    for f in FEATURES:
        frame[f] = rng.normal(size=120) + 2 * (frame.label == "x")
    frame["split"] = rng.choice(["train", "val", "test"], 120, p=[0.6, 0.2, 0.2])
    raw = spark.createDataFrame(frame)
    params = prep.fit_preprocessor(raw.where("split = 'train'"), FEATURES)
    table = prep.transform(raw, params, keep=["row_key", "label", "split"]).cache()
    cfg = replace(SMALL, boost=BoostConfig(trees=3, depth=2, max_bins=16), softmax=True, multiclass=True, weighting="shap")
    model = hybrid.fit_hybrid(table, FEATURES, cfg, params=params).model
    model.save(spark, f"file://{tmp_path}/model")
    back = hybrid.HybridModel.load(spark, f"file://{tmp_path}/model")
    want = {r.row_key: r.confidence for r in model.score(table, normalize="fitted").collect()}
    cells = [x for f in FEATURES for x in (F.lit(f), F.col(f))]
    bodies = raw.select("row_key", F.to_json(F.array(F.create_map(*cells))).alias("body"))
    assert {r.row_key: r.confidence for r in back.score_requests(bodies).collect()} == pytest.approx(want)
    folder, base = scratch_path(spark, "requests"), scratch_path(spark, "scored")
    for part in (0, 1):
        bodies.where(F.col("row_key") % 2 == part).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(bodies.schema).parquet(folder)
        query = jobs.model_scores(back, stream).writeStream.format("parquet").option("path", f"{base}/data")
        query.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(f"{base}/data").collect()
    assert len(found) == 120 and {r.row_key: r.confidence for r in found} == pytest.approx(want)
    with pytest.raises(Exception, match="missing required features"):
        model.score_requests(bodies.withColumn("body", F.lit('[{"a": 1.0}]'))).collect()
