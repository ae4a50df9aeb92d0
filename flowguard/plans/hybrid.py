"""The hybrid detector: boosted classifier, autoencoder, dual score and fusion, trained and stored as one."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowguard.config import BENIGN, LABEL, DualConfig, FoldConfig, HybridConfig
from flowguard.functions.columns import quoted
from flowguard.operators import metrics, models, prep, registry, scoring, weights
from flowguard.operators.attribution import shap_weights
from flowguard.operators.autoencoder import Autoencoder, feature_array, fit_autoencoder, forward, unflatten
from flowguard.operators.boosting import SoftmaxBooster, fit_softmax, matrix, probabilities_of
from flowguard.operators.splits import assign_folds, fold_table
from flowguard.session import driver_rows, materialize
from flowguard.sources import stores

SIGNALS = ("clf_score", "rec_error", "dual_score")
ATTACK_CLASS = "attack"


@dataclass(frozen=True)
class HybridModel:
    classifier: models.BoostedClassifier | SoftmaxBooster
    input_weights: dict[str, float]
    autoencoder: Autoencoder
    dual: DualConfig
    threshold: float
    reference_range: scoring.SignalRange
    fusion: models.FusionModel
    params: prep.PrepParams | None = None

    def signals(self, df: DataFrame, with_proba: bool = False) -> DataFrame:
        """Adds clf_score and rec_error to prepared rows."""
        if isinstance(self.classifier, SoftmaxBooster):
            return self._signals_in_one_pass(df, with_proba)
        features = list(self.classifier.features)
        scored = self.classifier.predict_proba(df, "proba").withColumn(
            "clf_score", F.lit(1.0) - F.col("proba")[self.classifier.benign_index]
        )
        plain = {f: F.col(quoted(f)) for f in features}
        # The autoencoder sees weighted inputs; the prepared features stay as they are.
        weighted = scored.withColumns({f"__raw_{f}": c for f, c in plain.items()}) if self.input_weights else scored
        if self.input_weights:
            weighted = weights.apply_weights(weighted, self.input_weights)
        found = self.autoencoder.add_error(weighted)
        if self.input_weights:
            found = found.drop(*features).withColumnsRenamed({f"__raw_{f}": f for f in features})
        return found if with_proba else found.drop("proba")

    def _signals_in_one_pass(self, df: DataFrame, with_proba: bool) -> DataFrame:
        """Trees and network read the same Arrow batches; both travel as one broadcast of the model's own size."""
        prep.require_columns(df, self.classifier.features, "feature")
        scale = np.array([self.input_weights.get(f, 1.0) for f in self.classifier.features])
        loss = np.array(self.autoencoder.weights)
        shared = df.sparkSession.sparkContext.broadcast((self.classifier.forest.arrays(), self.autoencoder.flat, self.autoencoder.sizes))

        @F.pandas_udf("proba array<double>, rec_error double")
        def both(found: pd.Series) -> pd.DataFrame:
            trees, flat, sizes = shared.value
            x = matrix(found, sizes[0])
            weighted = x * scale
            gap = weighted - forward(weighted, unflatten(flat, sizes))[-1]
            return pd.DataFrame({"proba": list(probabilities_of(x, trees)), "rec_error": (gap * gap * loss).mean(axis=1)})

        scored = df.withColumn("__both", both(feature_array(self.classifier.features)))
        found = scored.withColumns(
            {
                "proba": F.col("__both.proba"),
                "clf_score": F.lit(1.0) - F.col("__both.proba")[self.classifier.benign_index],
                "rec_error": F.col("__both.rec_error"),
            }
        ).drop("__both")
        return found if with_proba else found.drop("proba")

    def score_requests(self, requests: DataFrame, body: str = "body", strict: bool = True) -> DataFrame:
        """Predictions of every item of JSON requests, batch or stream: explode, align, prepare, score by the stored range.

        With ``strict`` a request without a required feature fails the job; otherwise the stored fill values take its place.
        """
        if self.params is None:
            raise ValueError("the model carries no preprocessing parameters")
        items = scoring.explode_requests(requests, body)
        aligned = scoring.align_request(items, self.params.names, strict=strict)
        kept = [c for c in aligned.columns if c not in self.params.names]
        rows = prep.transform(aligned, self.params, keep=kept)
        return self.score(rows, normalize="fitted")

    def score(self, df: DataFrame, normalize: str = "batch", prepared: bool = True) -> DataFrame:
        """Predictions of every row; ``prepared=False`` applies the stored preprocessing first.

        ``batch`` needs the range of the signals before it can scale them: they are computed once and stored.
        """
        rows = df
        if not prepared:
            if self.params is None:
                raise ValueError("the model carries no preprocessing parameters")
            rows = prep.transform(df, self.params)
        found = self.signals(rows)
        if normalize == "batch":
            found = materialize(found, "signals")
        dual = scoring.with_dual_score(found, "clf_score", "rec_error", normalize, self.reference_range, self.dual)
        return scoring.fuse(dual, self.fusion.weights, self.fusion.intercept)

    def save(self, spark: SparkSession, path: str) -> None:
        self.classifier.save(spark, f"{path}/classifier")
        stores.write_table(self.autoencoder.to_frame(spark).coalesce(1), f"{path}/autoencoder")
        stores.write_table(self.fusion.to_frame(spark).coalesce(1), f"{path}/fusion")
        pairs = list(self.input_weights.items())
        stores.write_table(spark.createDataFrame(pairs, "feature string, weight double").coalesce(1), f"{path}/weights")
        if self.params is not None:
            stores.write_table(self.params.to_frame(spark).coalesce(1), f"{path}/prep")
        dual = {**asdict(self.dual), "threshold": self.threshold, "clf": self.reference_range.clf, "rec": self.reference_range.rec}
        # Written last: its presence marks a complete model.
        stores.write_report(
            spark.createDataFrame(
                [tuple(dual[k] for k in ("alpha", "beta", "threshold_quantile", "threshold", "clf", "rec"))],
                DUAL_SCHEMA,
            ),
            f"{path}/dual",
        )

    @staticmethod
    def load(spark: SparkSession, path: str) -> "HybridModel":
        dual = stores.read_report(spark, f"{path}/dual", DUAL_SCHEMA).first()
        given = weights.weight_map(stores.read_table(spark, f"{path}/weights"))
        params = None
        if stores.path_exists(spark, f"{path}/prep"):
            params = prep.PrepParams.from_frame(stores.read_table(spark, f"{path}/prep"))
        return HybridModel(
            (SoftmaxBooster if stores.path_exists(spark, f"{path}/classifier/nodes") else models.BoostedClassifier).load(spark, f"{path}/classifier"),
            given,
            Autoencoder.from_frame(stores.read_table(spark, f"{path}/autoencoder")),
            DualConfig(dual.alpha, dual.beta, dual.threshold_quantile),
            dual.threshold,
            scoring.SignalRange(tuple(dual.clf), tuple(dual.rec)),
            models.FusionModel.from_frame(stores.read_table(spark, f"{path}/fusion")),
            params,
        )


DUAL_SCHEMA = (
    "alpha double, beta double, threshold_quantile double, threshold double, clf array<double>, rec array<double>"
)


@dataclass(frozen=True)
class TrainedRun:
    """A fitted model and the signals of all rows it was given (kept on reliable storage)."""

    model: HybridModel
    signals: DataFrame

    def split(self, name: str) -> DataFrame:
        """Signals of one split with y, dual score (normalised in that split), flag, fusion probability and label."""
        rows = self.signals.where(F.col("split") == name)
        dual = scoring.with_dual_score(rows, "clf_score", "rec_error", "batch", cfg=self.model.dual)
        fused = scoring.fuse(dual, self.model.fusion.weights, self.model.fusion.intercept)
        return fused.withColumn("anomaly", scoring.anomaly_flag("dual_score", self.model.threshold))


def _class_names(train: DataFrame, label: str, multiclass: bool) -> list[str]:
    if not multiclass:
        return [BENIGN, ATTACK_CLASS]
    found = driver_rows(train.select(label).distinct(), "label classes")
    return sorted(r[0] for r in found if r[0] is not None)


def _feature_weights(
    classifier: models.BoostedClassifier, train: DataFrame, cfg: HybridConfig, key: str
) -> dict[str, float]:
    if cfg.weighting == "ones":
        return {}
    if cfg.weighting == "importance":
        raw = classifier.importances(train.sparkSession)
    elif cfg.weighting == "shap":
        raw = shap_weights(classifier, train, key, cfg.attribution_rows)
    else:
        raise ValueError(f"unknown weighting: {cfg.weighting}")
    return weights.weight_map(weights.normalize_weights(raw))


def fit_hybrid(
    rows: DataFrame,
    features: Sequence[str],
    cfg: HybridConfig = HybridConfig(),
    key: str = "row_key",
    weight_inputs: bool = False,
    threshold_split: str = "val",
    params: prep.PrepParams | None = None,
) -> TrainedRun:
    """Trains on the ``train`` rows of a prepared table with a ``split`` column.

    Attribution weights scale either the autoencoder's inputs or its loss. The anomaly threshold comes
    from the benign rows of ``threshold_split``.
    """
    label = F.col(LABEL) if cfg.multiclass else F.when(F.col(LABEL) == BENIGN, BENIGN).otherwise(ATTACK_CLASS)
    table = materialize(rows.select(key, LABEL, "split", *map(quoted, features)).withColumn("__class", label))
    train, val = (table.where(F.col("split") == s) for s in ("train", "val"))
    classes = _class_names(train, "__class", cfg.multiclass)
    has_val = not val.isEmpty()
    fit = fit_softmax if cfg.softmax else models.fit_boosted
    classifier = fit(train, features, classes, "__class", cfg.boost, val if has_val else None)
    found = _feature_weights(classifier, train, cfg, key)
    input_weights, loss_weights = (found, {}) if weight_inputs else ({}, found)
    benign = train.where(F.col(LABEL) == BENIGN)
    ae_rows = weights.apply_weights(benign, input_weights) if input_weights else benign
    autoencoder = fit_autoencoder(ae_rows, features, loss_weights, cfg.autoencoder)
    ids = {c: i for i, c in enumerate(classes)}
    class_id = F.coalesce(*[F.when(F.col("__class") == c, i) for c, i in ids.items()], F.lit(-1))
    unfused = HybridModel(
        classifier, input_weights, autoencoder, cfg.dual, 0.0, scoring.SignalRange((0, 0), (0, 0)),
        models.FusionModel((0.0,) * len(SIGNALS), 0.0), params,
    )
    signals = materialize(
        unfused.signals(table, with_proba=True).select(
            key, LABEL, "split", "proba", "clf_score", "rec_error",
            (F.col(LABEL) != BENIGN).cast("int").alias("y"),
            class_id.alias("class_id"),
            models.argmax_class("proba").alias("class_pred"),
        )
    )
    reference = signals.where((F.col("split") == threshold_split) & (F.col(LABEL) == BENIGN))
    threshold = scoring.fit_threshold(reference, "clf_score", "rec_error", cfg.dual)
    train_signals = scoring.with_dual_score(
        signals.where(F.col("split") == "train"), "clf_score", "rec_error", "batch", cfg=cfg.dual
    )
    fusion = models.fit_fusion(train_signals, SIGNALS, "y", cfg.fusion)
    stored = scoring.signal_range(signals.where(F.col("split") == "train"), "clf_score", "rec_error")
    model = replace(unfused, threshold=threshold, fusion=fusion, reference_range=stored)
    return TrainedRun(model, signals)


def run_metrics(run: TrainedRun, split: str = "test") -> DataFrame:
    """(model, metric, value) of the baseline classifier, the dual score and the fusion."""
    return metrics.evaluate_bundle(
        run.split(split),
        ("class_id", "class_pred", "proba"),
        ("y", "anomaly", "dual_score"),
        ("y", "prediction", "fusion_probability"),
    )


def fold_scores(
    rows: DataFrame, fold: tuple[int, str, str, str], features: Sequence[str], cfg: HybridConfig, key: str, folds: FoldConfig
) -> DataFrame:
    """One held-out attack: train without it, score it and unseen benign rows: (fold, held_out_attack, key, y, score, prediction).

    With attribution the autoencoder's inputs are weighted; the threshold comes from the train benign rows.
    """
    table = assign_folds(rows.drop("split"), [fold], key, folds).withColumnRenamed("role", "split")
    run = fit_hybrid(table, features, cfg, key, weight_inputs=True, threshold_split="train")
    named = F.lit(fold[0]).alias("fold"), F.lit(fold[1]).alias("held_out_attack")
    return run.split("test").select(*named, key, "y", F.col("fusion_probability").alias("score"), "prediction")


def run_fold(
    rows: DataFrame, fold: tuple[int, str, str, str], features: Sequence[str], cfg: HybridConfig, key: str, folds: FoldConfig
) -> DataFrame:
    """The metric row of one held-out attack."""
    return metrics.fold_f1(fold_scores(rows, fold, features, cfg, key, folds), "y", "prediction", ["fold", "held_out_attack"])


def loao_scores(
    rows: DataFrame,
    features: Sequence[str],
    cfg: HybridConfig = HybridConfig(weighting="shap"),
    key: str = "row_key",
    folds: FoldConfig = FoldConfig(),
    refit: prep.PrepConfig | None = None,
    at_once: int = 1,
) -> DataFrame:
    """Stored scores of the test rows of every fold, see ``fold_scores``. ``refit`` fits the preprocessing anew on each fold's train rows.

    The jobs of up to ``at_once`` folds run side by side, each fold from its own thread; a fold that fails ends the experiment.
    """
    table = materialize(rows.select(key, folds.label, *map(quoted, features)))
    named = fold_table(table, key, folds)
    if not named:
        raise ValueError("there is no attack label to hold out")

    def run(fold: tuple[int, str, str, str]) -> DataFrame:
        source = table
        if refit is not None:
            train = assign_folds(table, [fold], key, folds).where(F.col("role") == "train")
            source = prep.transform(table, prep.fit_preprocessor(train, features, refit))
        return materialize(fold_scores(source, fold, features, cfg, key, folds), "fold-scores")

    with ThreadPoolExecutor(max(1, min(at_once, len(named)))) as pool:
        # Each task gets its own copy of the caller's job properties.
        started = [pool.submit(inheritable_thread_target(rows.sparkSession)(run), fold) for fold in named]
        return reduce(DataFrame.unionByName, [s.result() for s in started])


def loao_experiment(
    rows: DataFrame,
    features: Sequence[str],
    cfg: HybridConfig = HybridConfig(weighting="shap"),
    key: str = "row_key",
    folds: FoldConfig = FoldConfig(),
    refit: prep.PrepConfig | None = None,
    at_once: int = 1,
) -> DataFrame:
    """Metric row per held-out attack, from the stored scores of ``loao_scores``."""
    return metrics.fold_f1(loao_scores(rows, features, cfg, key, folds, refit, at_once), "y", "prediction", ["fold", "held_out_attack"])


def loao_summary(results: DataFrame) -> DataFrame:
    """One row: ``total_runs`` and the sorted ``held_out_attacks`` of an experiment. It has one entry for each label."""
    return results.agg(F.count("*").alias("total_runs"), F.sort_array(F.collect_set("held_out_attack")).alias("held_out_attacks"))


def run_hash(rows: DataFrame, cfg: HybridConfig) -> str:
    """Names a run by its settings and by the content of its rows, in any order."""
    content = registry.table_fingerprint(rows).first().fingerprint
    return hashlib.md5((json.dumps(asdict(cfg), sort_keys=True) + content).encode()).hexdigest()


def fit_or_load(
    rows: DataFrame, features: Sequence[str], cfg: HybridConfig, store: str, key: str = "row_key",
    params: prep.PrepParams | None = None,
) -> tuple[HybridModel, bool]:
    """The stored model of this run if it is complete, else a new one; tells which."""
    spark = rows.sparkSession
    path = f"{store}/{run_hash(rows.select(key, LABEL, 'split', *map(quoted, features)), cfg)}"
    if stores.path_exists(spark, f"{path}/dual/_SUCCESS"):
        return HybridModel.load(spark, path), True
    model = fit_hybrid(rows, features, cfg, key, params=params).model
    model.save(spark, path)
    return model, False
