"""Impute, clip, scale and encode: statistics fitted once, applied as one projection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowguard.config import METADATA, PrepConfig
from flowguard.functions.columns import number_sql, quoted, sql_double, unpivot_sql
from flowguard.operators.quantiles import EXACT_ROWS, exact_quantiles
from flowguard.session import attach_rows, driver_rows

PARAM_SCHEMA = (
    "ord int, feature string, fill double, lower double, upper double, mean double, std double, scaled boolean"
)


@dataclass(frozen=True)
class FeatureParams:
    ord: int
    feature: str
    fill: float
    lower: float | None = None
    upper: float | None = None
    mean: float | None = None
    std: float | None = None
    scaled: bool = False


@dataclass(frozen=True)
class PrepParams:
    features: tuple[FeatureParams, ...]

    @property
    def names(self) -> list[str]:
        return [f.feature for f in self.features]

    def to_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([asdict(f) for f in self.features], PARAM_SCHEMA)

    @staticmethod
    def from_frame(table: DataFrame) -> "PrepParams":
        rows = sorted(driver_rows(table, "preprocessing parameters"), key=lambda r: r.ord)
        if not rows:
            raise ValueError("the preprocessing parameter table is empty")
        return PrepParams(tuple(FeatureParams(**r.asDict()) for r in rows))


def feature_columns(df: DataFrame, metadata: Sequence[str] = METADATA, limit: int = 0) -> list[str]:
    """All columns that are not metadata, in table order; the first ``limit`` of them if it is positive."""
    excluded = {*metadata, "label_id", "split", "row_key"}
    names = [c for c in df.columns if c not in excluded]
    if not names:
        raise ValueError("the table has no feature columns")
    return names[:limit] if limit > 0 else names


def imputed(params: FeatureParams) -> str:
    return f"coalesce({number_sql(quoted(params.feature))}, {sql_double(params.fill)})"


def clipped(params: FeatureParams) -> str:
    value = imputed(params)
    if params.lower is None:
        return value
    return f"least(greatest({value}, {sql_double(params.lower)}), {sql_double(params.upper)})"


def transformed(params: FeatureParams) -> str:
    value = clipped(params)
    if not params.scaled:
        return value
    return f"({value} - {sql_double(params.mean)}) / {sql_double(params.std if params.std else 1.0)}"


def fit_impute(
    df: DataFrame, features: Sequence[str], cfg: PrepConfig = PrepConfig(), exact_rows: int = EXACT_ROWS
) -> PrepParams:
    present = df.selectExpr(*[f"{number_sql(quoted(f))} AS {quoted(f)}" for f in features])
    if cfg.impute_strategy == "constant":
        fills: dict[str, float | None] = {f: cfg.impute_constant for f in features}
    elif cfg.impute_strategy == "median":
        medians = exact_quantiles(present, features, [0.5], exact_rows)
        fills = {f: (q[0] if q else None) for f, q in medians.items()}
    elif cfg.impute_strategy == "mean":
        row = present.agg(*[F.avg(quoted(f)).alias(f"m{i}") for i, f in enumerate(features)]).first()
        fills = {f: row[f"m{i}"] for i, f in enumerate(features)}
    else:
        counts = (
            present.selectExpr(unpivot_sql(features))
            .where("value IS NOT NULL")
            .groupBy("feature_id", "value")
            .agg(F.count("*").alias("n"))
        )
        # Most frequent value, the smallest among equals.
        best = counts.groupBy("feature_id").agg(F.max(F.struct("n", (-F.col("value")).alias("negated"))).alias("top"))
        modes = {r.feature_id: -r.top.negated + 0.0 for r in best.collect()}
        fills = {f: modes.get(i) for i, f in enumerate(features)}
    empty = [f for f, v in fills.items() if v is None]
    if empty:
        raise ValueError(f"features without any value in the training rows: {empty}")
    return PrepParams(tuple(FeatureParams(i, f, float(fills[f])) for i, f in enumerate(features)))


def fit_clip(
    df: DataFrame, params: PrepParams, cfg: PrepConfig = PrepConfig(), exact_rows: int = EXACT_ROWS
) -> PrepParams:
    table = df.selectExpr(*[f"{imputed(p)} AS {quoted(p.feature)}" for p in params.features])
    bounds = exact_quantiles(table, params.names, list(cfg.clip_quantiles), exact_rows)
    return PrepParams(
        tuple(replace(p, lower=bounds[p.feature][0], upper=bounds[p.feature][1]) for p in params.features)
    )


def fit_scale(df: DataFrame, params: PrepParams, cfg: PrepConfig = PrepConfig()) -> PrepParams:
    if not cfg.scale:
        return params
    row = df.selectExpr(
        *[f"avg({clipped(p)}) AS m{p.ord}" for p in params.features],
        *[f"stddev_pop({clipped(p)}) AS s{p.ord}" for p in params.features],
    ).first()
    return PrepParams(
        tuple(replace(p, mean=row[f"m{p.ord}"], std=row[f"s{p.ord}"], scaled=True) for p in params.features)
    )


def fit_preprocessor(
    train: DataFrame, features: Sequence[str], cfg: PrepConfig = PrepConfig(), exact_rows: int = EXACT_ROWS
) -> PrepParams:
    """Three aggregations over the training rows: fill values, clip bounds, mean and deviation."""
    params = fit_impute(train, features, cfg, exact_rows)
    params = fit_clip(train, params, cfg, exact_rows)
    return fit_scale(train, params, cfg)


def require_columns(df: DataFrame, names: Sequence[str], what: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing {what} columns: {missing[:5]}")


def transform(df: DataFrame, params: PrepParams, keep: Sequence[str] | None = None) -> DataFrame:
    """One projection; ``keep`` names the columns that pass through (default: all the others)."""
    require_columns(df, params.names, "feature")
    passing = [c for c in df.columns if c not in set(params.names)] if keep is None else list(keep)
    return df.selectExpr(
        *[quoted(c) for c in passing], *[f"{transformed(p)} AS {quoted(p.feature)}" for p in params.features]
    )


def label_classes(train: DataFrame, label: str = "label") -> list[str]:
    rows = driver_rows(train.select(label).distinct(), "label classes")
    return sorted(r[0] for r in rows if r[0] is not None)


def encode_labels(df: DataFrame, classes: Sequence[str], label: str = "label") -> DataFrame:
    """Adds ``label_id``; a label that training did not see fails the job."""
    joined = attach_rows(df, list(zip(classes, range(len(classes)))), f"`{label}` string, label_id int", [label])
    known = F.when(F.col("label_id").isNotNull(), F.col("label_id")).otherwise(
        F.raise_error(F.concat(F.lit("label not seen in training: "), F.coalesce(F.col(label), F.lit("null"))))
        .cast("int")
    )
    return joined.withColumn("label_id", known)
