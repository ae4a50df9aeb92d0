"""Schema checks as violation rows, and the quality report."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowguard.config import FAMILY, LABEL, METADATA, SOURCE
from flowguard.functions.columns import INFINITY, number_sql, quoted


# Fixed value: name of the null group in nested distributions.
NULL_GROUP = "NaN"
REPORT_SCHEMA = (
    "rows bigint, columns int, feature_columns int, missing_ratio double, "
    "label_distribution map<string, bigint>, family_distribution map<string, bigint>"
)


def duplicate_columns(names: Sequence[str]) -> list[str]:
    return sorted(n for n, times in Counter(names).items() if times > 1)


def missing_columns(names: Sequence[str], required: Sequence[str] = METADATA) -> list[str]:
    return [r for r in required if r not in names]


def extra_columns(names: Sequence[str], expected: Sequence[str]) -> list[str]:
    return [n for n in names if n not in expected]


def require_layout(df: DataFrame, features: Sequence[str], metadata: Sequence[str] = METADATA) -> None:
    """Raises on duplicate, missing or extra columns, before any row is read."""
    twice = duplicate_columns(df.columns)
    if twice:
        raise ValueError(f"duplicate columns: {twice}")
    absent = missing_columns(df.columns, [*features, *metadata])
    if absent:
        raise ValueError(f"missing required columns: {absent}")
    extra = extra_columns(df.columns, [*features, *metadata, "row_key"])
    if extra:
        raise ValueError(f"columns outside the schema: {extra}")


def _violations(df: DataFrame, features: Sequence[str], strings: Sequence[str], key: str) -> DataFrame:
    """One pass: every row emits its own failures, so nothing is shuffled."""
    checks = []
    for f in features:
        cell, value = quoted(f), f"TRY_CAST({quoted(f)} AS DOUBLE)"
        for check, failed in (
            ("coerce_double", f"{cell} IS NOT NULL AND {value} IS NULL"),
            ("not_infinite", f"abs({value}) = double('Infinity')"),
        ):
            checks.append((failed, f, check, f"CAST({cell} AS STRING)"))
    checks += [(f"{quoted(s)} IS NULL", s, "not_null", "CAST(NULL AS STRING)") for s in strings]
    cells = ", ".join(
        f"CASE WHEN {failed} THEN named_struct('column', '{column}', 'check', '{check}', 'failure_case', {text}) END"
        for failed, column, check, text in checks
    )
    return df.selectExpr(f"{quoted(key)} AS row_key", f"explode(array_compact(array({cells}))) AS v").select(
        "row_key", "v.column", "v.check", "v.failure_case"
    )


def validate_raw(df: DataFrame, features: Sequence[str], key: str = "row_key") -> DataFrame:
    return _violations(df, features, [], key)


def validate_labeled(
    df: DataFrame, features: Sequence[str], metadata: Sequence[str] = METADATA, key: str = "row_key"
) -> DataFrame:
    """All failures of the strict labelled schema; empty for a valid table."""
    return _violations(df, features, metadata, key)


def require_valid(df: DataFrame, features: Sequence[str], metadata: Sequence[str] = METADATA) -> DataFrame:
    """Returns the table, or raises with the number of failures per column and check."""
    require_layout(df, features, metadata)
    keyed = df if "row_key" in df.columns else df.withColumn("row_key", F.lit(None).cast("bigint"))
    found = validate_labeled(keyed, features, metadata).groupBy("column", "check").agg(F.count("*").alias("n")).collect()
    if found:
        summary = sorted((r["column"], r["check"], r["n"]) for r in found)
        raise ValueError(f"schema violations (column, check, rows): {summary}")
    return df


def infinite_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    counts = df.agg(
        *[F.count_if(F.abs(F.col(quoted(c)).try_cast("double")) == F.lit(INFINITY)).alias(c) for c in columns]
    )
    return counts.unpivot([], list(columns), "column", "infinite_rows")


def null_labels(df: DataFrame, label: str = LABEL) -> DataFrame:
    return df.agg(F.count_if(F.col(label).isNull()).alias("null_labels"))


def quality_summary(
    df: DataFrame, features: Sequence[str] | None = None, metadata: Sequence[str] = METADATA
) -> DataFrame:
    """Rows, columns, present features and the mean over features of their missing share."""
    wanted = list(features) if features else [c for c in df.columns if c not in {*metadata, "label_id"}]
    present = [f for f in wanted if f in df.columns]
    if not present:
        raise ValueError("no feature column of the schema is present")
    missing = " + ".join(f"avg(CAST({number_sql(quoted(f))} IS NULL AS DOUBLE))" for f in present)
    share = F.expr(f"({missing}) / {float(len(present))}D")
    return df.agg(
        F.count("*").alias("rows"),
        F.lit(len(df.columns)).alias("columns"),
        F.lit(len(present)).alias("feature_columns"),
        share.alias("missing_ratio"),
    )


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Row count per value, the null group included."""
    return df.groupBy(column).agg(F.count("*").alias("rows"))


def distribution_sets(df: DataFrame, label: str = LABEL, family: str = FAMILY) -> DataFrame:
    """Label, family and total counts in one pass."""
    return df.groupingSets([[label], [family], []], label, family).agg(
        F.count("*").alias("rows"), F.grouping_id().cast("int").alias("level")
    )


def quality_report(
    df: DataFrame,
    features: Sequence[str] | None = None,
    metadata: Sequence[str] = METADATA,
    label: str = LABEL,
    family: str = FAMILY,
) -> DataFrame:
    """One row: the quality summary and, nested, the rows of every label and of every family; nulls count under ``NULL_GROUP``.

    Groups are counted before they are nested. A row holds as many entries as there are labels and families.
    """
    entry = lambda c: F.struct(F.coalesce(F.col(c), F.lit(NULL_GROUP)).alias("key"), "rows")
    nested = lambda c, level: F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("level") == level, entry(c)))))
    groups = distribution_sets(df, label, family).agg(nested(label, 1).alias("label_distribution"), nested(family, 2).alias("family_distribution"))
    one = F.lit(1)
    return quality_summary(df, features, metadata).withColumn("one", one).join(groups.withColumn("one", one), "one").drop("one")


def column_presence(df: DataFrame, required: Sequence[str] = (LABEL, FAMILY, SOURCE)) -> DataFrame:
    """Per required column: is it there, and how many rows carry a value."""
    there = [c for c in required if c in df.columns]
    counts = df.agg(
        *[
            (F.count(quoted(c)) if c in there else F.lit(0).cast("bigint")).alias(f"c{i}")
            for i, c in enumerate(required)
        ]
    )
    cells = ", ".join(f"'{c}', {'true' if c in there else 'false'}, c{i}" for i, c in enumerate(required))
    return counts.selectExpr(f"stack({len(required)}, {cells}) AS (column, present, filled_rows)")


def column_occurrences(df: DataFrame) -> DataFrame:
    """Per column name: how often it occurs, next to the table's rows."""
    times = Counter(df.columns)
    cells = ", ".join(f"'{c}', {n}, {'true' if n > 1 else 'false'}, n" for c, n in times.items())
    return df.agg(F.count("*").alias("n")).selectExpr(
        f"stack({len(times)}, {cells}) AS (column, occurrences, duplicated, rows)"
    )
