"""Softmax boosting against plain loops over single rows."""

import pickle

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowguard.config import BoostConfig
from flowguard.operators import boosting, quantiles
from flowguard.operators.attribution import expected_value, shapley_values

FEATURES = ["a", "b", "c.d"]
CLASSES = ["benign", "x", "y"]
CFG = BoostConfig(trees=4, depth=3, max_bins=16, alpha=0.3, early_stopping=False)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    n = 240
    label = rng.choice(CLASSES, n, p=[0.5, 0.3, 0.2])
    frame = pd.DataFrame({"a": rng.normal(size=n) + 2 * (label == "x"), "b": rng.normal(size=n) - 2 * (label == "y"), "c.d": rng.integers(0, 4, n).astype(float)})
    frame["label"], frame["part"] = label, rng.choice(["train", "val"], n, p=[0.7, 0.3])
    return spark.createDataFrame(frame).repartition(4).cache()


def plain_fit(rows, edges, cfg):
    """(feature, bin, value) of every node by loops; rows are (hash, class, values)."""
    x = boosting.binned(np.array([r[2] for r in rows], dtype=float), edges).astype(int)
    y, hashes = [r[1] for r in rows], np.array([r[0] for r in rows], dtype=np.int64).view(np.uint64)
    margin = np.zeros((len(rows), len(CLASSES)))
    rounds = []
    for t in range(cfg.trees):
        p = np.exp(margin) / np.exp(margin).sum(axis=1, keepdims=True)
        use = boosting.sampled_rows(hashes, t, cfg)
        trees, step = [], np.zeros_like(margin)
        for c in range(len(CLASSES)):
            g, h = p[:, c] - [v == c for v in y], 2 * p[:, c] * (1 - p[:, c])
            soft = lambda v: np.sign(v) * max(abs(v) - cfg.alpha, 0)
            score = lambda ix: soft(g[ix].sum()) ** 2 / (h[ix].sum() + cfg.reg_lambda)  # noqa: E731, B023
            weight = lambda ix: -cfg.learning_rate * soft(g[ix].sum()) / (h[ix].sum() + cfg.reg_lambda)  # noqa: E731, B023
            columns, tree, pending = boosting.sampled_columns(len(FEATURES), t, c, cfg), {}, [(0, np.arange(len(rows)), 0)]
            while pending:
                at, ix, depth = pending.pop()
                train = ix[use[ix]]
                best = (1e-6, -1, 0)
                for f in columns if depth < cfg.depth else []:
                    for b in range(len(edges[f])):
                        left, right = train[x[train, f] <= b], train[x[train, f] > b]
                        if h[left].sum() >= 1 and h[right].sum() >= 1:
                            gain = score(left) + score(right) - score(train)
                            if gain > best[0] + 1e-12:
                                best = (gain, f, b)
                tree[at] = (best[1], best[2], weight(train))
                if best[1] >= 0:
                    inside = x[ix, best[1]] <= best[2]
                    pending += [(2 * at + 1, ix[inside], depth + 1), (2 * at + 2, ix[~inside], depth + 1)]
                else:
                    step[ix, c] = weight(train)
            trees.append(tree)
        margin += step
        rounds.append(trees)
    return rounds, margin


def test_trees_equal_plain_loops(table):
    train = table.where("part = 'train'")
    for renew in (1, 3):
        model = boosting.fit_softmax(train, FEATURES, CLASSES, cfg=CFG, renew=renew, blocks=2)
        edges = boosting.bin_edges(train, FEATURES, CFG.max_bins)
        given = train.select(F.xxhash64("a", "b", "`c.d`", "label").alias("h"), "label", "a", "b", "`c.d`").collect()
        rows = [(r[0], CLASSES.index(r[1]), r[2:]) for r in given]
        want, margin = plain_fit(rows, edges, CFG)
        for t, trees in enumerate(want):
            for c, tree in enumerate(trees):
                for at, (feature, cut, value) in tree.items():
                    assert model.forest.feature[t, c, at] == feature
                    assert model.forest.value[t, c, at] == pytest.approx(value, abs=1e-9)
                    assert feature < 0 or model.forest.bin[t, c, at] == cut
        x = np.array([r[2] for r in rows], dtype=float)
        assert np.allclose(boosting.margins_of(x, model.forest, binned=False), margin)
        assert np.allclose(boosting.margins_of(boosting.binned(x, edges), model.forest, binned=True), margin)


def test_probabilities_importances_and_store(spark, table, tmp_path):
    model = boosting.fit_softmax(table.where("part = 'train'"), FEATURES, CLASSES, cfg=CFG)
    scored = model.predict_proba(table).select("a", "b", "`c.d`", "label", "proba").toPandas()
    proba = np.stack(scored.proba.to_numpy())
    assert np.allclose(proba.sum(axis=1), 1) and np.allclose(proba, model.probabilities(scored[FEATURES].to_numpy(float)))
    assert (np.array(CLASSES)[proba.argmax(axis=1)] == scored.label).mean() > 0.75
    weights = {r.feature: r.weight for r in model.importances(spark).collect()}
    assert sum(weights.values()) == pytest.approx(1) and weights["c.d"] < weights["a"]
    model.save(spark, f"file://{tmp_path}/m")
    back = boosting.SoftmaxBooster.load(spark, f"file://{tmp_path}/m")
    assert back.classes == model.classes and all(np.array_equal(a, b) for a, b in zip(back.forest.arrays(), model.forest.arrays()))
    attack = model.attack_score(table).agg(F.avg("clf_score")).head()[0]
    assert attack == pytest.approx(1 - proba[:, 0].mean())
    # Attribution sums to the margin.
    x = scored[FEATURES].to_numpy(float)[:20]
    for c in range(3):
        leaves = model.leaves(c)
        assert np.allclose(shapley_values(x, leaves, 3).sum(axis=1) + expected_value(leaves), boosting.margins_of(x, model.forest, False)[:, c])


def test_early_stop_keeps_the_best_rounds(table):
    cfg = BoostConfig(trees=40, depth=4, max_bins=16, learning_rate=0.9, patience=3)
    train, val = table.where("part = 'train'"), table.where("part = 'val'")
    model = boosting.fit_softmax(train, FEATURES, CLASSES, cfg=cfg, validation=val, renew=4)
    assert len(model.losses) < 40 and model.forest.rounds == int(np.argmin(model.losses)) + 1
    assert len(model.losses) - model.forest.rounds == 3
    rows = val.toPandas()
    p = model.probabilities(rows[FEATURES].to_numpy(float))
    loss = -np.log(p[np.arange(len(rows)), [CLASSES.index(v) for v in rows.label]]).mean()
    assert loss == pytest.approx(min(model.losses))


def test_odd_inputs(spark, table):
    with pytest.raises(ValueError, match="two classes"):
        boosting.fit_softmax(table, FEATURES, ["benign"])
    with pytest.raises(ValueError, match="no training rows"):
        boosting.fit_softmax(table.where("label = 'none'"), FEATURES, CLASSES)
    odd = table.unionByName(table.limit(3).withColumn("a", F.lit(None).cast("double")))
    model = boosting.fit_softmax(odd, FEATURES, CLASSES, cfg=CFG)
    assert model.predict_proba(odd.where("a IS NULL")).where("abs(aggregate(proba, 0D, (s, v) -> s + v) - 1) < 1e-9").count() == 3


def test_bin_edges_of_many_columns_beyond_the_direct_way(spark):
    wide = pd.DataFrame(np.random.default_rng(3).normal(size=(3000, 40)), columns=[f"f{i}" for i in range(40)])
    wide.iloc[::7, 3], wide.iloc[:, 5] = 0.25, 1.0
    levels = [i / 256 for i in range(1, 256)]
    found = quantiles.exact_quantiles(spark.createDataFrame(wide).repartition(3), list(wide), levels, direct_rows=100)
    for name in wide:
        assert found[name] == pytest.approx(list(wide[name].quantile(levels)))


def test_broadcast_models_hold_no_class_of_the_library(spark, table, monkeypatch):
    model = boosting.fit_softmax(table.where("part = 'train'"), FEATURES, CLASSES, cfg=CFG)
    sent = []
    given = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(value) or given(self, value))
    assert model.predict_proba(table).count() == table.count()
    assert sent and not any(b"flowguard" in pickle.dumps(value) for value in sent)
