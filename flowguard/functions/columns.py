"""Small expressions: missing values, safe ratios, fixed-point rounding, hash order."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def sql_double(value: float) -> str:
    """A double literal. Wide tables are described as SQL text: one parsed string per column is far
    cheaper to build than a tree of column objects."""
    if math.isnan(value):
        return "double('NaN')"
    if math.isinf(value):
        return "double('Infinity')" if value > 0 else "double('-Infinity')"
    return f"({float(value)!r}D)"


def number_sql(text: str) -> str:
    """Double with NaN turned into null, so that both kinds of missing are one."""
    return f"nanvl(CAST({text} AS DOUBLE), CAST(NULL AS DOUBLE))"


def coerced_sql(text: str) -> str:
    """Text or number to double; what cannot be parsed is null."""
    return f"nanvl(TRY_CAST({text} AS DOUBLE), CAST(NULL AS DOUBLE))"


def finite_sql(text: str) -> str:
    value = coerced_sql(text)
    return f"CASE WHEN abs({value}) < double('Infinity') THEN {value} END"


def number(column: str) -> Column:
    return F.expr(number_sql(quoted(column)))


def coerced(column: str) -> Column:
    return F.expr(coerced_sql(quoted(column)))


def rounded(value: Column | str) -> Column:
    """Six decimals. The cut sits just below one half, so that a mean that falls on a tie in exact
    arithmetic is rounded alike by engines that add in a different order."""
    return F.floor(as_column(value) * F.lit(1e6) + F.lit(0.50001)).cast("double") / F.lit(1e6)


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Quotient as double, 0 where the denominator is 0."""
    top, bottom = as_column(numerator).cast("double"), as_column(denominator).cast("double")
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def hash_order(seed: Column | int | str, key: Column | str) -> Column:
    """A seeded row order that does not depend on partitioning or engine."""
    first = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws("|", first.cast("string"), as_column(key).cast("string")))


def double_array(values: Iterable[float]) -> Column:
    return F.expr(f"array({', '.join(sql_double(v) for v in values)})")


def unpivot_sql(columns: Sequence[str], name: str = "feature_id", value: str = "value") -> str:
    """A ``stack`` generator that turns the columns into (ordinal, double) rows."""
    cells = ", ".join(f"{i}, CAST({quoted(c)} AS DOUBLE)" for i, c in enumerate(columns))
    return f"stack({len(columns)}, {cells}) AS ({name}, {value})"


def bin_sql(text: str, edges: Sequence[float]) -> str:
    """Histogram bin of a value: half-open, last bin closed, null outside the edges or without any bin."""
    if len(edges) < 2:
        return "CAST(NULL AS INT)"
    above = " + ".join(["0", *[f"CAST({text} >= {sql_double(e)} AS INT)" for e in edges[1:-1]]])
    return f"CASE WHEN {text} BETWEEN {sql_double(edges[0])} AND {sql_double(edges[-1])} THEN {above} END"


def fixed_text(value: Column | str, digits: int) -> Column:
    """Fixed-point text whose ties go to the even digit."""
    return F.format_string(f"%.{digits}f", F.bround(as_column(value), digits))
