"""Boosted attack classifier as a Spark ML fit, logistic fusion by Newton steps, scores as native expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowguard.config import BENIGN, BoostConfig, FusionConfig
from flowguard.functions.columns import as_column, quoted
from flowguard.operators.prep import require_columns
from flowguard.session import driver_rows
from flowguard.sources import stores


# A fit has settled when its next step would lower the loss by this share at most.
SETTLED = 1e-13
HALVINGS = 40


def argmax_class(probabilities: Column | str) -> Column:
    p = as_column(probabilities)
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def assembled(df: DataFrame, features: Sequence[str], output: str = "features") -> DataFrame:
    require_columns(df, features, "feature")
    # Ordinal names: the assembler does not take names that contain a dot.
    names = [f"__in{i}" for i in range(len(features))]
    inputs = df.select("*", *[F.col(quoted(f)).alias(n) for f, n in zip(features, names)])
    return VectorAssembler(inputCols=names, outputCol=output, handleInvalid="error").transform(inputs).drop(*names)


def class_weights(df: DataFrame, y: str) -> DataFrame:
    """(class, weight) with weight n / (classes * n_class)."""
    counts = {r[0]: r[1] for r in driver_rows(df.groupBy(y).agg(F.count("*")), "classes")}
    total = sum(counts.values())
    kind = df.schema[y].dataType.simpleString()
    rows = [(c, total / (len(counts) * n)) for c, n in sorted(counts.items())]
    return df.sparkSession.createDataFrame(rows, f"`{y}` {kind}, weight double")


@dataclass(frozen=True)
class BoostedClassifier:
    """One boosted binary model per class, or a single one for two classes.

    Spark's boosting is binary: class probabilities are the per-class sigmoid scores scaled to sum 1.
    """

    features: tuple[str, ...]
    classes: tuple[str, ...]
    models: tuple[GBTClassificationModel, ...]

    @property
    def benign_index(self) -> int:
        if BENIGN not in self.classes:
            raise ValueError("the training rows have no benign class")
        return self.classes.index(BENIGN)

    def predict_proba(self, df: DataFrame, output: str = "proba") -> DataFrame:
        """Adds the array of class probabilities, indexed by class id."""
        rows = assembled(df, self.features, "__features")
        names = []
        for i, model in enumerate(self.models):
            rows = (
                model.copy()
                .setFeaturesCol("__features")
                .setPredictionCol(f"__p{i}")
                .setProbabilityCol(f"__v{i}")
                .setRawPredictionCol(f"__r{i}")
                .transform(rows)
                .drop(f"__p{i}", f"__r{i}")
            )
            names.append(vector_to_array(F.col(f"__v{i}"))[1])
        if len(self.models) == 1:
            positive = names[0]
            proba = F.array(F.lit(1.0) - positive, positive)
        else:
            total = sum(names[1:], names[0])
            proba = F.array(*[n / total for n in names])
        helpers = [f"__v{i}" for i in range(len(self.models))]
        return rows.withColumn(output, proba).drop("__features", *helpers)

    def attack_score(self, df: DataFrame, output: str = "clf_score") -> DataFrame:
        """Adds 1 - P(benign)."""
        rows = self.predict_proba(df, "__proba")
        return rows.withColumn(output, F.lit(1.0) - F.col("__proba")[self.benign_index]).drop("__proba")

    def importances(self, spark: SparkSession) -> DataFrame:
        """(feature, weight): mean of the models' gain importances."""
        totals = [0.0] * len(self.features)
        for model in self.models:
            for i, v in enumerate(model.featureImportances.toArray()):
                totals[i] += float(v) / len(self.models)
        return spark.createDataFrame(list(zip(self.features, totals)), "feature string, weight double")

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [("feature", i, f) for i, f in enumerate(self.features)]
        rows += [("class", i, c) for i, c in enumerate(self.classes)]
        stores.write_table(spark.createDataFrame(rows, "role string, ord int, name string").coalesce(1), f"{path}/layout")
        for i, model in enumerate(self.models):
            model.write().overwrite().save(f"{path}/model-{i}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "BoostedClassifier":
        layout = sorted(driver_rows(stores.read_table(spark, f"{path}/layout"), "model layout"), key=lambda r: r.ord)
        features = tuple(r.name for r in layout if r.role == "feature")
        classes = tuple(r.name for r in layout if r.role == "class")
        if not features or not classes:
            raise ValueError(f"incomplete model layout under {path}")
        count = 1 if len(classes) == 2 else len(classes)
        models = tuple(GBTClassificationModel.load(f"{path}/model-{i}") for i in range(count))
        return BoostedClassifier(features, classes, models)


def fit_boosted(
    train: DataFrame,
    features: Sequence[str],
    classes: Sequence[str],
    label: str = "label",
    cfg: BoostConfig = BoostConfig(),
    validation: DataFrame | None = None,
) -> BoostedClassifier:
    """Boosted trees on the training rows; stops early only when validation rows are given.

    ``classes`` come from the training rows alone.
    """
    if len(classes) < 2:
        raise ValueError("a classifier needs at least two classes")
    stop = validation is not None and cfg.early_stopping
    rows = train.select(label, *map(quoted, features), F.lit(False).alias("__validation"))
    if stop:
        rows = rows.unionByName(validation.select(label, *map(quoted, features), F.lit(True).alias("__validation")))
    table = assembled(rows, features).select(F.col(label).alias("__label"), "features", "__validation").persist()
    try:
        targets = [classes[1]] if len(classes) == 2 else list(classes)
        models = []
        for target in targets:
            booster = GBTClassifier(
                featuresCol="features",
                labelCol="__y",
                maxIter=cfg.trees,
                maxDepth=cfg.depth,
                stepSize=cfg.learning_rate,
                subsamplingRate=cfg.row_subsample,
                featureSubsetStrategy=str(cfg.column_subsample) if cfg.column_subsample < 1 else "all",
                maxBins=cfg.max_bins,
                seed=cfg.seed,
                cacheNodeIds=True,
            )
            if stop:
                booster = booster.setValidationIndicatorCol("__validation")
            models.append(booster.fit(table.withColumn("__y", (F.col("__label") == target).cast("double"))))
    finally:
        table.unpersist()
    return BoostedClassifier(tuple(features), tuple(classes), tuple(models))


@dataclass(frozen=True)
class FusionModel:
    weights: tuple[float, ...]
    intercept: float

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(-1, self.intercept), *enumerate(self.weights)]
        return spark.createDataFrame([(i, float(v)) for i, v in rows], "ord int, value double")

    @staticmethod
    def from_frame(table: DataFrame) -> "FusionModel":
        rows = {r.ord: r.value for r in driver_rows(table, "fusion coefficients")}
        if -1 not in rows:
            raise ValueError("the fusion table has no intercept")
        return FusionModel(tuple(rows[i] for i in range(len(rows) - 1)), rows[-1])


def _loss_pass(rows: DataFrame, names: Sequence[str], point: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Weighted logistic loss at a point (intercept last), its gradient and its second derivatives, in one aggregation."""
    x = [*[F.col(n) for n in names], F.lit(1.0)]
    z = sum((c * F.lit(float(b)) for c, b in zip(x[:-1], point)), F.lit(float(point[-1])))
    tail = F.exp(-F.abs(F.col("__z")))
    p = F.when(F.col("__z") >= 0, 1 / (1 + tail)).otherwise(tail / (1 + tail))
    at = [(i, j) for i in range(len(x)) for j in range(i + 1)]
    sums = rows.withColumn("__z", z).withColumn("__p", p).select(
        *names, "__z", "__p", "__w", "__y", (F.col("__w") * F.col("__p") * (1 - F.col("__p"))).alias("__h")
    ).agg(
        F.sum(F.col("__w") * (F.greatest("__z", F.lit(0.0)) + F.log1p(tail) - F.col("__y") * F.col("__z"))),
        *[F.sum(F.col("__w") * (F.col("__p") - F.col("__y")) * c) for c in x],
        *[F.sum(F.col("__h") * x[i] * x[j]) for i, j in at],
    ).head()
    second = np.zeros((len(x), len(x)))
    for (i, j), v in zip(at, sums[1 + len(x) :]):
        second[i, j] = second[j, i] = v
    return sums[0], np.array(sums[1 : 1 + len(x)]), second


def fit_fusion(df: DataFrame, signals: Sequence[str], y: str, cfg: FusionConfig = FusionConfig()) -> FusionModel:
    """L2 logistic regression with inverse strength C and balanced classes, intercept without penalty, at its optimum.

    Minimises C * sum(w * loss) + |b|^2 / 2 by Newton steps. Each is one aggregation of a gradient and a matrix of the size of
    the signals, so few passes over the rows are enough whatever the signals' scales. A step that does not lower the loss is
    halved. Rows without a signal or of one class only raise, and so does a fit that does not settle in ``cfg.max_iter`` steps.
    """
    values = [F.col(quoted(s)).cast("double") for s in signals]
    names = [f"__in{i}" for i in range(len(signals))]
    gaps = reduce(lambda a, b: a | b, [v.isNull() | F.isnan(v) for v in values])
    groups = {r[0]: (r.n, r.gaps) for r in df.groupBy(y).agg(F.count("*").alias("n"), F.count_if(gaps).alias("gaps")).collect()}
    if len(groups) != 2:
        raise ValueError("fusion needs rows of both classes")
    if any(g for _, g in groups.values()):
        raise ValueError(f"fusion signals have gaps: {sum(g for _, g in groups.values())} rows")
    total = sum(n for n, _ in groups.values())
    weight = F.lit(1.0)
    if cfg.balanced:
        weight = F.when(F.col(y) == 1, F.lit(total / (2.0 * groups[1][0]))).otherwise(F.lit(total / (2.0 * groups[0][0])))
    rows = df.select(*[v.alias(n) for v, n in zip(values, names)], F.col(y).cast("double").alias("__y"), weight.alias("__w"))
    ridge = np.array([1.0] * len(names) + [0.0])

    def measure(point: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        loss, gradient, second = _loss_pass(rows, names, point)
        return cfg.c * loss + ridge @ point**2 / 2, cfg.c * gradient + ridge * point, cfg.c * second + np.diag(ridge)

    point = np.zeros(len(ridge))
    loss, gradient, second = measure(point)
    for _ in range(cfg.max_iter):
        scale = 1 / np.sqrt(np.diag(second))
        step = -scale * np.linalg.solve(second * np.outer(scale, scale), scale * gradient)
        gain = -(gradient @ step) / 2
        if gain <= SETTLED * max(1.0, loss):
            found = point + step
            return FusionModel(tuple(float(v) for v in found[:-1]), float(found[-1]))
        for part in range(HALVINGS):
            there = point + step / 2**part
            new = measure(there)
            if new[0] < loss:
                break
        else:
            break
        point, (loss, gradient, second) = there, new
    raise RuntimeError(f"the fusion fit did not settle: gradient {np.abs(gradient).max():.3g}")
