"""Multiclass gradient boosting by second-order softmax gradients, in histogram passes over a stored table of bins.

All classes grow one tree each in a round. A level of all these trees is one Spark pass: every task sums gradients and
hessians of its rows into (class, node, feature, bin) cells, blocks of features are summed over the tasks, and each block
reports its best split of every node. What reaches the driver is bounded by the model's shape; a task holds two numbers for
each cell, whatever its rows. Rows keep their margins in the stored table, renewed every few rounds; the trees since then
travel with the pass. Nothing is kept in executors between passes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowguard.config import BENIGN, BoostConfig
from flowguard.functions.columns import quoted
from flowguard.operators.autoencoder import feature_array
from flowguard.operators.prep import require_columns
from flowguard.operators.quantiles import exact_quantiles
from flowguard.session import driver_rows, materialize
from flowguard.sources import stores

# The least hessian of a row and of a child, and the least gain of a split.
LEAST_HESSIAN, LEAST_CHILD, LEAST_GAIN = 1e-16, 1.0, 1e-6
# Rows are summed in parts of this size, so that a part's cell numbers stay small.
PART = 4096


@dataclass(frozen=True)
class Forest:
    """Trees as arrays (round, class, node): node i has the children 2i + 1 and 2i + 2; a leaf has feature -1."""

    feature: np.ndarray
    bin: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    gain: np.ndarray

    @staticmethod
    def empty(classes: int, depth: int, rounds: int = 0) -> "Forest":
        shape = (rounds, classes, 2 ** (depth + 1) - 1)
        return Forest(np.full(shape, -1, dtype=np.int32), np.zeros(shape, dtype=np.int32), *(np.zeros(shape) for _ in range(4)))

    @property
    def rounds(self) -> int:
        return len(self.feature)

    @property
    def depth(self) -> int:
        return int(self.feature.shape[2] + 1).bit_length() - 2

    def arrays(self) -> list[np.ndarray]:
        return [self.feature, self.bin, self.threshold, self.value, self.cover, self.gain]

    def cut(self, first: int, last: int) -> "Forest":
        return Forest(*(a[first:last] for a in self.arrays()))

    def plus(self, other: "Forest") -> "Forest":
        return Forest(*(np.concatenate([a, b]) for a, b in zip(self.arrays(), other.arrays())))


def node_of(x: np.ndarray, feature: np.ndarray, bound: np.ndarray, depth: int) -> np.ndarray:
    """The node of every row and class in one round's trees (class, node). Missing values go left."""
    n, k = len(x), len(feature)
    rows, classes = np.arange(n)[:, None], np.arange(k)[None, :]
    at = np.zeros((n, k), dtype=np.int64)
    for _ in range(depth):
        f = feature[classes, at]
        right = x[rows, np.maximum(f, 0)] > bound[classes, at]
        at = np.where(f >= 0, 2 * at + 1 + right, at)
    return at


def margins_of(x: np.ndarray, forest: Forest, binned: bool) -> np.ndarray:
    total = np.zeros((len(x), forest.feature.shape[1]))
    classes = np.arange(forest.feature.shape[1])[None, :]
    for r in range(forest.rounds):
        bound = forest.bin[r] if binned else forest.threshold[r]
        total += forest.value[r][classes, node_of(x, forest.feature[r], bound, forest.depth)]
    return total


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def probabilities_of(x: np.ndarray, arrays: Sequence[np.ndarray]) -> np.ndarray:
    """Class probabilities by the arrays of a forest."""
    return softmax(margins_of(x, Forest(*arrays), binned=False))


def shrunk(g: np.ndarray | float, alpha: float):
    """The gradient after the L1 penalty."""
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def leaf_value(g: float, h: float, cfg: BoostConfig) -> float:
    return float(-cfg.learning_rate * shrunk(g, cfg.alpha) / (h + cfg.reg_lambda))


def sampled_columns(features: int, round_: int, class_: int, cfg: BoostConfig) -> np.ndarray:
    keep = max(1, int(features * cfg.column_subsample))
    return np.sort(np.random.default_rng((cfg.seed, round_, class_)).permutation(features)[:keep])


def sampled_rows(hashes: np.ndarray, round_: int, cfg: BoostConfig) -> np.ndarray:
    """Whether a row takes part in a round, by its hash alone."""
    mixed = (hashes.astype(np.uint64) ^ np.uint64((round_ * 0x9E3779B97F4A7C15 + cfg.seed) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(40)) < np.uint64(int(cfg.row_subsample * 2**24))


def cells(x: np.ndarray, g: np.ndarray, h: np.ndarray, at: np.ndarray, nodes: int, bins: int) -> np.ndarray:
    """Sums (2, class, node, feature, bin) of rows at the level's nodes; ``at`` is negative for rows that are not there."""
    n, width = x.shape
    k = g.shape[1]
    found = np.zeros((2, k, nodes * width * bins))
    columns = np.arange(width) * bins
    for c in range(k):
        for first in range(0, n, PART):
            here = np.flatnonzero(at[first : first + PART, c] >= 0) + first
            if len(here):
                place = (at[here, c, None] * (width * bins) + columns + x[here]).ravel()
                for i, values in enumerate((g, h)):
                    found[i, c] += np.bincount(place, np.repeat(values[here, c], width), nodes * width * bins)
    return found.reshape(2, k, nodes, width, bins)


def best_splits(sums: np.ndarray, first: int, allowed: np.ndarray, cfg: BoostConfig) -> list[tuple]:
    """(class, node, feature, bin, gain, left g, left h, right g, right h) of the best split of each node in a block of features.

    ``sums`` is (2, class, node, feature, bin) and ``allowed`` (class, feature); ``first`` is the block's first feature. Ties
    go to the first feature and bin. A node without a split has feature -1, and its sums on the left.
    """
    left = sums.cumsum(axis=-1)
    total = left[..., -1:]
    right = total - left
    score = lambda s: shrunk(s[0], cfg.alpha) ** 2 / (s[1] + cfg.reg_lambda)
    gain = score(left) + score(right) - score(total)
    fits = (left[1] >= LEAST_CHILD) & (right[1] >= LEAST_CHILD) & allowed[:, None, :, None]
    gain = np.where(fits, gain, -np.inf)
    found = []
    for c in range(gain.shape[0]):
        for node in range(gain.shape[1]):
            flat = int(gain[c, node].argmax())
            f, b = divmod(flat, gain.shape[-1])
            if gain[c, node, f, b] > LEAST_GAIN:
                sides = (*left[:, c, node, f, b], *right[:, c, node, f, b])
                found.append((c, node, first + f, b, float(gain[c, node, f, b]), *map(float, sides)))
            else:
                found.append((c, node, -1, 0, 0.0, *map(float, total[:, c, node, 0, 0]), 0.0, 0.0))
    return found


SPLIT = "class int, node int, feature int, bin int, gain double, lg double, lh double, rg double, rh double"


@dataclass(frozen=True)
class SoftmaxBooster:
    """A fitted model. ``losses`` has the validation loss after every round, if there were validation rows."""

    features: tuple[str, ...]
    classes: tuple[str, ...]
    forest: Forest
    losses: tuple[float, ...] = ()

    @property
    def benign_index(self) -> int:
        if BENIGN not in self.classes:
            raise ValueError("the training rows have no benign class")
        return self.classes.index(BENIGN)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return probabilities_of(x, self.forest.arrays())

    def predict_proba(self, df: DataFrame, output: str = "proba") -> DataFrame:
        """Adds the array of class probabilities, indexed by class id."""
        require_columns(df, self.features, "feature")
        # A broadcast is pickled by reference to its classes, which executors need not have: only arrays travel.
        model, width = df.sparkSession.sparkContext.broadcast(self.forest.arrays()), len(self.features)

        @F.pandas_udf("array<double>")
        def predict(found: pd.Series) -> pd.Series:
            return pd.Series(list(probabilities_of(matrix(found, width), model.value)))

        return df.withColumn(output, predict(feature_array(self.features)))

    def attack_score(self, df: DataFrame, output: str = "clf_score") -> DataFrame:
        """Adds 1 - P(benign)."""
        rows = self.predict_proba(df, "__proba")
        return rows.withColumn(output, F.lit(1.0) - F.col("__proba")[self.benign_index]).drop("__proba")

    def importances(self, spark: SparkSession) -> DataFrame:
        """(feature, weight): mean gain of a feature's splits, scaled to sum 1."""
        used = self.forest.feature >= 0
        total = np.bincount(self.forest.feature[used], self.forest.gain[used], len(self.features))
        count = np.bincount(self.forest.feature[used], minlength=len(self.features))
        mean = total / np.maximum(count, 1)
        scaled = mean / mean.sum() if mean.sum() > 0 else mean
        return spark.createDataFrame([(f, float(v)) for f, v in zip(self.features, scaled)], "feature string, weight double")

    def leaves(self, class_: int) -> list[tuple]:
        """Leaves of a class's trees for attribution: value, features on the path, their bounds and shares of the cover."""
        found, forest = [], self.forest
        for r in range(forest.rounds):
            pending = [(0, {})]
            while pending:
                at, bounds = pending.pop()
                feature = int(forest.feature[r, class_, at])
                if feature < 0:
                    order = sorted(bounds)
                    lows, highs, shares = zip(*(bounds[f] for f in order)) if order else ((), (), ())
                    found.append((float(forest.value[r, class_, at]), tuple(order), lows, highs, shares))
                    continue
                cut, cover = float(forest.threshold[r, class_, at]), forest.cover[r, class_, at]
                low, high, share = bounds.get(feature, (-np.inf, np.inf, 1.0))
                for child, interval in ((2 * at + 1, (low, min(high, cut))), (2 * at + 2, (max(low, cut), high))):
                    part = float(forest.cover[r, class_, child] / cover)
                    pending.append((child, {**bounds, feature: (*interval, share * part)}))
        return found

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """(round, class, node, feature, bin, threshold, value, cover, gain) of all nodes."""
        index = np.indices(self.forest.feature.shape).reshape(3, -1)
        columns = [*index, *(a.ravel() for a in self.forest.arrays())]
        names = ["round", "class", "node", "feature", "bin", "threshold", "value", "cover", "gain"]
        schema = "round int, class int, node int, feature int, bin int, threshold double, value double, cover double, gain double"
        return spark.createDataFrame(pd.DataFrame(dict(zip(names, columns))), schema)

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [("feature", i, f, None) for i, f in enumerate(self.features)] + [("class", i, c, None) for i, c in enumerate(self.classes)]
        rows += [("loss", i, None, v) for i, v in enumerate(self.losses)]
        stores.write_table(self.to_frame(spark).coalesce(1), f"{path}/nodes")
        stores.write_table(spark.createDataFrame(rows, "role string, ord int, name string, value double").coalesce(1), f"{path}/layout")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "SoftmaxBooster":
        layout = sorted(driver_rows(stores.read_table(spark, f"{path}/layout"), "model layout"), key=lambda r: r.ord)
        named = lambda role: tuple(r.name for r in layout if r.role == role)
        features, classes = named("feature"), named("class")
        if not features or not classes:
            raise ValueError(f"incomplete model layout under {path}")
        nodes = stores.read_table(spark, f"{path}/nodes").toPandas().sort_values(["round", "class", "node"])
        shape = (nodes["round"].nunique(), len(classes), nodes["node"].nunique())
        kinds = [np.int32, np.int32, float, float, float, float]
        arrays = [nodes[n].to_numpy(t).reshape(shape) for n, t in zip(["feature", "bin", "threshold", "value", "cover", "gain"], kinds)]
        return SoftmaxBooster(features, classes, Forest(*arrays), tuple(r.value for r in layout if r.role == "loss"))


def matrix(found: pd.Series, width: int) -> np.ndarray:
    return np.stack(found.to_numpy()).astype(float) if len(found) else np.zeros((0, width))


def bin_edges(train: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """Upper edges of every feature's bins: distinct exact quantiles of the training rows; the last bin is open."""
    probabilities = [i / bins for i in range(1, bins)]
    found = exact_quantiles(train, list(features), probabilities)
    return [np.unique(np.array([v for v in found[f] or []], dtype=float)) for f in features]


def binned(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """Bin b holds values up to edge b; missing values are in bin 0."""
    columns = [np.where(np.isnan(x[:, i]), 0, np.searchsorted(e, x[:, i])) for i, e in enumerate(edges)]
    return np.stack(columns, axis=1).astype(np.uint8) if columns else np.zeros((len(x), 0), np.uint8)


def _read(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, ...]:
    x = np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype=np.uint8).reshape(-1, width)
    margin = np.asarray(batch.column(4).flatten().to_numpy(), dtype=float).reshape(batch.num_rows, -1)
    return batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False), x, margin


STATE = "h bigint, label int, held boolean, bins binary, margin array<double>"


def _state(rows: DataFrame, features: Sequence[str], classes: Sequence[str], edges: Sequence[np.ndarray]) -> DataFrame:
    """Rows (h, label, held, bins, margin) of the labelled rows; the hash is of all values, so it needs no key."""
    ids = F.coalesce(*[F.when(F.col("__label") == c, i) for i, c in enumerate(classes)], F.lit(-1)).cast("int")
    given = rows.select(
        F.xxhash64(*map(quoted, features), "__label").alias("h"), ids.alias("label"), "held", feature_array(features).alias("x")
    ).where("label >= 0")
    k = len(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(edges))
            packed = pa.array([row.tobytes() for row in binned(x, edges)], pa.binary())
            margin = pa.array(list(np.zeros((batch.num_rows, k))), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), packed, margin], names=["h", "label", "held", "bins", "margin"])

    return materialize(given.mapInArrow(run, STATE), "boost-state")


def _renewed(state: DataFrame, since: Forest, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *_, x, margin = _read(batch, width)
            now = pa.array(list(margin + margins_of(x, since, binned=True)), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), now], names=["h", "label", "held", "bins", "margin"])

    return materialize(state.mapInArrow(run, STATE), "boost-state")


def _pass(state: DataFrame, since: Forest, partial: Forest, round_: int, level: int, widths: Sequence[int], cfg: BoostConfig, blocks: int):
    """One level of all trees: the best splits of its nodes, and at level 0 the validation rows' loss sum and number."""
    width, bins, nodes = len(widths), max(widths), 2**level
    edges = np.linspace(0, width, min(blocks, width) + 1).astype(int)
    k = partial.feature.shape[1]
    allowed = np.zeros((k, width), dtype=bool)
    for c in range(k):
        allowed[c, sampled_columns(width, round_, c, cfg)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, loss, n = None, 0.0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            h, label, held, x, margin = _read(batch, width)
            p = softmax(margin + margins_of(x, since, binned=True))
            if level == 0 and held.any():
                loss -= float(np.log(np.maximum(p[held, label[held]], 1e-15)).sum())
                n += int(held.sum())
            use = ~held & sampled_rows(h.view(np.uint64), round_, cfg)
            x, p, label = x[use], p[use], label[use]
            g = p - (label[:, None] == np.arange(k))
            at = node_of(x, partial.feature[0], partial.bin[0], level) - (nodes - 1)
            found = cells(x, g, np.maximum(2 * p * (1 - p), LEAST_HESSIAN), np.where(at < nodes, at, -1), nodes, bins)
            sums = found if sums is None else sums + found
        if sums is not None:
            parts = [sums[:, :, :, a:b].tobytes() for a, b in zip(edges, edges[1:])]
            numbers = [*range(len(parts)), -1]
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array([*parts, np.array([loss, n], float).tobytes()], pa.binary())], names=["block", "sums"])

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        block = int(rows["block"].iloc[0])
        total = sum(np.frombuffer(v, dtype=float) for v in rows["sums"])
        if block < 0:
            found = [(-1, -1, -1, 0, 0.0, total[0], total[1], 0.0, 0.0)]
        else:
            a, b = edges[block], edges[block + 1]
            found = best_splits(total.reshape(2, k, nodes, b - a, bins), int(a), allowed[:, a:b], cfg)
        return pd.DataFrame(found, columns=[c.split()[0] for c in SPLIT.split(", ")])

    return state.mapInArrow(run, "block int, sums binary").groupBy("block").applyInPandas(merge, SPLIT).collect()


def _grow(partial: Forest, found: Sequence, level: int, edges: Sequence[np.ndarray], cfg: BoostConfig) -> bool:
    """Writes a level's best splits into the round's trees; tells whether there is any."""
    best: dict[tuple[int, int], object] = {}
    for r in sorted((r for r in found if r["class"] >= 0), key=lambda r: (r["feature"], r["bin"])):
        spot = (r["class"], r["node"])
        if spot not in best or r["gain"] > best[spot]["gain"]:
            best[spot] = r
    grown = False
    for (c, node), r in best.items():
        at = 2**level - 1 + node
        if level == 0:
            g, h = r["lg"] + r["rg"], r["lh"] + r["rh"]
            partial.value[0, c, at], partial.cover[0, c, at] = leaf_value(g, h, cfg), h
        if r["feature"] >= 0:
            grown = True
            partial.feature[0, c, at], partial.bin[0, c, at], partial.gain[0, c, at] = r["feature"], r["bin"], r["gain"]
            partial.threshold[0, c, at] = edges[r["feature"]][r["bin"]]
            for child, g, h in ((2 * at + 1, r["lg"], r["lh"]), (2 * at + 2, r["rg"], r["rh"])):
                partial.value[0, c, child], partial.cover[0, c, child] = leaf_value(g, h, cfg), h
    return grown


def fit_softmax(
    train: DataFrame,
    features: Sequence[str],
    classes: Sequence[str],
    label: str = "label",
    cfg: BoostConfig = BoostConfig(),
    validation: DataFrame | None = None,
    renew: int = 10,
    blocks: int = 8,
) -> SoftmaxBooster:
    """Boosted trees of all classes on the training rows.

    With validation rows and early stopping, rounds end when the loss has not fallen for ``cfg.patience`` rounds, and the
    model keeps the rounds up to the least loss. Rows of other labels are left out. The result depends on the rows, not on how
    they are partitioned, but for the order of floating-point sums.
    """
    if len(classes) < 2:
        raise ValueError("a classifier needs at least two classes")
    if not 2 <= cfg.max_bins <= 256:
        raise ValueError("max_bins must lie in 2..256")
    require_columns(train, features, "feature")
    stop = validation is not None and cfg.early_stopping
    plain = lambda df, held: df.select(F.col(label).alias("__label"), *map(quoted, features), F.lit(held).alias("held"))
    rows = plain(train, False)
    if stop:
        rows = rows.unionByName(plain(validation, True))
    edges = bin_edges(train, features, cfg.max_bins)
    widths = [len(e) + 1 for e in edges]
    state = _state(rows, features, classes, edges)
    if state.where("NOT held").isEmpty():
        raise ValueError("no training rows")
    done = Forest.empty(len(classes), cfg.depth)
    kept, losses = 0, []
    for round_ in range(cfg.trees + 1):
        partial = Forest.empty(len(classes), cfg.depth, 1)
        last = round_ == cfg.trees
        if last and not stop:
            break
        for level in range(cfg.depth):
            found = _pass(state, done.cut(kept, done.rounds), partial, round_, level, widths, cfg, blocks)
            if level == 0 and stop:
                # The loss of the rounds before.
                losses += [r["lg"] / r["lh"] for r in found if r["class"] < 0 and r["lh"] > 0 and round_ > 0]
                if last or losses and len(losses) - 1 - int(np.argmin(losses)) >= cfg.patience:
                    best = int(np.argmin(losses)) + 1 if losses else done.rounds
                    return SoftmaxBooster(tuple(features), tuple(classes), done.cut(0, best), tuple(losses))
            if not _grow(partial, found, level, edges, cfg):
                break
        done = done.plus(partial)
        if done.rounds - kept >= renew:
            state, kept = _renewed(state, done.cut(kept, done.rounds), len(features)), done.rounds
    return SoftmaxBooster(tuple(features), tuple(classes), done)

