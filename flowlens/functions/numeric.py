"""Column expressions for missing, infinite and ratio values; all stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

INF = float("inf")


def null_if_nan(column: Column) -> Column:
    """NaN means missing; SQL aggregates skip NULL but not NaN."""
    return F.when(~F.isnan(column), column)


def is_infinite(column: Column) -> Column:
    return F.coalesce(F.abs(column) == F.lit(INF), F.lit(False))


def is_missing(column: Column) -> Column:
    return column.isNull() | F.isnan(column)


def finite(column: Column) -> Column:
    """The value if it is a finite number, else NULL (NaN sorts above infinity, so one test covers both)."""
    return F.when(F.abs(column) < F.lit(INF), column)


def nan_to_num(column: Column, nan: float = 0.0, posinf: float = 1e10, neginf: float = -1e10) -> Column:
    """Missing and infinite values become given numbers."""
    return F.coalesce(
        finite(column),
        F.when(column == F.lit(INF), F.lit(float(posinf))).when(column == F.lit(-INF), F.lit(float(neginf))),
        F.lit(float(nan)),
    )


def ratio(numerator: Column, denominator: Column, empty: float = 0.0) -> Column:
    """``numerator / denominator``, and ``empty`` where the denominator is 0."""
    return F.when(denominator == 0, F.lit(float(empty))).otherwise(numerator / denominator)


def rate(amount: Column, divisor: Column) -> Column:
    """A rate that is infinite for a zero divisor, as flow exporters write it."""
    return F.when(divisor == 0, F.lit(INF)).otherwise(amount / divisor)


def sigmoid(column: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-column))


def long_form(df: DataFrame, features: list[str], *keep: str) -> DataFrame:
    """One row per (row, feature): ``feature``, ``value`` plus the kept columns. No shuffle."""
    values = F.array(*features).cast("array<double>")
    names = F.split(F.lit("\n".join(features)), "\n")  # a constant array
    return df.select(*keep, F.posexplode(values).alias("_i", "value")).select(
        *keep, F.element_at(names, F.col("_i") + 1).alias("feature"), "value")
