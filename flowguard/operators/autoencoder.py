"""Autoencoder trained by data-parallel parameter averaging, scored as an Arrow function.

The network is a symmetric ReLU perceptron. Rows are dealt to ``replicas`` partitions by their hash. In every epoch
each partition runs mini-batch Adam from the shared weights over its own rows, with moments that start anew; the new
weights are the row-weighted mean over partitions, summed by Spark parameter by parameter. An epoch shuffles
``replicas`` times the weights, whatever the number of rows. Only the weights (fixed by the layer sizes) reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowguard.config import AutoencoderConfig
from flowguard.functions.columns import quoted, sql_double
from flowguard.operators.prep import require_columns
from flowguard.session import shared_dir

# Adam constants.
BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-8

Layers = list[tuple[np.ndarray, np.ndarray]]


def layer_sizes(inputs: int, cfg: AutoencoderConfig) -> list[int]:
    return [inputs, *cfg.hidden, cfg.latent, *reversed(cfg.hidden), inputs]


def linear_after(index: int, total: int, encoder_layers: int) -> bool:
    """The code layer and the output layer have no ReLU."""
    return index in (encoder_layers - 1, total - 1)


def initial_layers(inputs: int, cfg: AutoencoderConfig) -> Layers:
    rng = np.random.default_rng(cfg.seed)
    sizes = layer_sizes(inputs, cfg)
    layers: Layers = []
    for a, b in zip(sizes[:-1], sizes[1:]):
        bound = 1.0 / np.sqrt(a)
        layers.append((rng.uniform(-bound, bound, (a, b)), rng.uniform(-bound, bound, b)))
    return layers


def flatten(layers: Layers) -> np.ndarray:
    return np.concatenate([np.concatenate([w.ravel(), b]) for w, b in layers])


def unflatten(flat: np.ndarray, sizes: Sequence[int]) -> Layers:
    layers, at = [], 0
    for a, b in zip(sizes[:-1], sizes[1:]):
        w = flat[at : at + a * b].reshape(a, b)
        at += a * b
        layers.append((w, flat[at : at + b]))
        at += b
    return layers


def forward(x: np.ndarray, layers: Layers) -> list[np.ndarray]:
    """Activations of every layer, input first."""
    encoder = len(layers) // 2
    out = [x]
    for i, (w, b) in enumerate(layers):
        z = out[-1] @ w + b
        out.append(z if linear_after(i, len(layers), encoder) else np.maximum(z, 0.0))
    return out


def loss_gradient(x: np.ndarray, layers: Layers, weights: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean over batch and features of w * (x - x̂)² and its gradient, flat."""
    acts = forward(x, layers)
    diff = acts[-1] - x
    loss = float((diff * diff * weights).mean())
    delta = 2.0 * diff * weights / diff.size
    grads: list[np.ndarray] = []
    for i in range(len(layers) - 1, -1, -1):
        w, _ = layers[i]
        grads.append(np.concatenate([(acts[i].T @ delta).ravel(), delta.sum(axis=0)]))
        if i:
            delta = delta @ w.T
            if not linear_after(i - 1, len(layers), len(layers) // 2):
                delta = delta * (acts[i] > 0)
    return loss, np.concatenate(grads[::-1])


@dataclass(frozen=True)
class Autoencoder:
    features: tuple[str, ...]
    weights: tuple[float, ...]
    sizes: tuple[int, ...]
    flat: np.ndarray
    losses: tuple[float, ...] = ()

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """(layer, row, col, value) of all matrices; row -1 is the bias, layer -1 the feature weights."""
        rows = [(-1, -1, i, f, float(w)) for i, (f, w) in enumerate(zip(self.features, self.weights))]
        for n, (w, b) in enumerate(unflatten(self.flat, self.sizes)):
            rows += [(n, -1, j, None, float(v)) for j, v in enumerate(b)]
            rows += [(n, i, j, None, float(w[i, j])) for i in range(w.shape[0]) for j in range(w.shape[1])]
        return spark.createDataFrame(rows, "layer int, row int, col int, feature string, value double")

    @staticmethod
    def from_frame(table: DataFrame) -> "Autoencoder":
        pdf = table.toPandas().sort_values(["layer", "row", "col"])
        head = pdf[pdf.layer == -1]
        if head.empty:
            raise ValueError("the autoencoder table has no feature weights")
        layers: Layers = []
        for n in sorted(set(pdf.layer) - {-1}):
            part = pdf[pdf.layer == n]
            bias = part[part.row == -1].sort_values("col").value.to_numpy()
            layers.append((part[part.row >= 0].value.to_numpy().reshape(-1, len(bias)), bias))
        sizes = (layers[0][0].shape[0], *[len(b) for _, b in layers])
        return Autoencoder(tuple(head.feature), tuple(float(v) for v in head.value), sizes, flatten(layers))

    def add_error(self, df: DataFrame, output: str = "rec_error") -> DataFrame:
        """Adds the weighted reconstruction error of every row."""
        require_columns(df, self.features, "feature")
        spark = df.sparkSession
        state = spark.sparkContext.broadcast(self.flat)
        sizes = self.sizes

        @F.pandas_udf("array<double>")
        def reconstruct(cells: pd.Series) -> pd.Series:
            x = np.stack(cells.to_numpy()) if len(cells) else np.zeros((0, sizes[0]))
            return pd.Series(list(forward(x, unflatten(state.value, sizes))[-1]))

        rebuilt = df.withColumn("__x", feature_array(self.features)).withColumn("__rebuilt", reconstruct("__x"))
        return rebuilt.withColumn(output, reconstruction_error("__x", "__rebuilt", self.weights)).drop("__x", "__rebuilt")


def feature_array(features: Sequence[str]) -> Column:
    return F.expr(f"array({', '.join(f'CAST({quoted(f)} AS DOUBLE)' for f in features)})")


def reconstruction_error(original: str, rebuilt: str, weights: Sequence[float]) -> Column:
    """Mean over features of w * (x - x̂)², out of two array columns."""
    terms = [f"pow({original}[{i}] - {rebuilt}[{i}], 2) * {sql_double(w)}" for i, w in enumerate(weights)]
    return F.expr(f"({' + '.join(terms)}) / {float(len(terms))}D")


def fit_autoencoder(
    benign: DataFrame,
    features: Sequence[str],
    weights: Mapping[str, float] | None = None,
    cfg: AutoencoderConfig = AutoencoderConfig(),
) -> Autoencoder:
    """Trains on the given (benign) rows; ``losses`` holds the mean loss of every epoch.

    The result follows from the rows, the seed and ``replicas``; it does not depend on how the input is split.
    """
    require_columns(benign, features, "feature")
    given = dict(weights) if weights else {}
    mean = sum(given.values()) / len(given) if given else 1.0
    aligned = np.array([given.get(f, mean) for f in features])
    spark = benign.sparkSession
    shared_dir(spark)
    # A reliable checkpoint keeps partitions and their order: the epochs re-read it without a shuffle.
    hashed = benign.select(feature_array(features).alias("x")).withColumn("h", F.xxhash64("x"))
    rows = hashed.repartition(cfg.replicas, "h").sortWithinPartitions("h", "x").select("x").checkpoint()
    if rows.isEmpty():
        raise ValueError("no benign rows to train on")
    sizes = layer_sizes(len(features), cfg)
    flat = flatten(initial_layers(len(features), cfg))
    losses: list[float] = []
    for epoch in range(cfg.epochs):
        shared = spark.sparkContext.broadcast(flat)
        step = _partition_epoch(shared, sizes, aligned, cfg, epoch)
        parts = rows.mapInPandas(step, "n bigint, loss double, params array<double>")
        # One weighted sum per parameter; the loss travels as one more position.
        long = parts.select("n", F.posexplode(F.concat(F.array("loss"), "params")).alias("pos", "value"))
        means = long.groupBy("pos").agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("value"))
        table = means.toPandas().sort_values("pos")
        losses.append(float(table.value.iloc[0]))
        flat = table.value.to_numpy()[1:]
        shared.unpersist()
    return Autoencoder(tuple(features), tuple(float(w) for w in aligned), tuple(sizes), flat, tuple(losses))


def _partition_epoch(shared, sizes: Sequence[int], weights: np.ndarray, cfg: AutoencoderConfig, epoch: int):
    """One local epoch: mini-batch Adam over the batches of a partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flat = shared.value.copy()
        first, second, t, seen, total = np.zeros_like(flat), np.zeros_like(flat), 0, 0, 0.0
        rng = np.random.default_rng((cfg.seed, epoch))
        for batch in batches:
            rows = np.stack(batch["x"].to_numpy())
            rows = rows[rng.permutation(len(rows))]
            for at in range(0, len(rows), cfg.batch_size):
                x = rows[at : at + cfg.batch_size]
                loss, grad = loss_gradient(x, unflatten(flat, sizes), weights)
                grad = grad + cfg.weight_decay * flat
                t += 1
                first = BETA1 * first + (1 - BETA1) * grad
                second = BETA2 * second + (1 - BETA2) * grad * grad
                step = (first / (1 - BETA1**t)) / (np.sqrt(second / (1 - BETA2**t)) + EPSILON)
                flat = flat - cfg.learning_rate * step
                seen += len(x)
                total += loss * len(x)
        if seen:
            yield pd.DataFrame({"n": [seen], "loss": [total / seen], "params": [flat]})

    return run
