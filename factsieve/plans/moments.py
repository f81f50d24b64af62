"""Moments of all numeric columns in one aggregate over (column, value) cells; one row per column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factsieve.functions.columns import REAL_TYPES, as_number, finite_sql, quoted, ref
from factsieve.plans.ordering import ROWS_PER_SLICE
from factsieve.plans.quantiles import QUARTILES, quantiles

MOMENTS = {"n_rows": "count(1)", "missing": "count(1) - count(_v)", "total": "sum(_v)", "mean": "avg(_v)", "std": "stddev_samp(_v)",
           "min": "min(_v)", "max": "max(_v)", "g1": "skewness(_v)", "g2": "kurtosis(_v)"}
MOMENT_COLUMNS = ["n_rows", "n", "missing", "total", "mean", "std", "min", "max", "g1", "g2"]


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, pos, n_rows, n, missing, total, mean, std, min, max, g1, g2 (population skew, excess kurtosis).

    Long form: the plan has the same size for five columns as for five hundred,
    and each task sends one small buffer per column.
    """
    stats = long_numbers(df, columns).groupBy("column").agg(
        F.expr("count(value) as n"), *[F.expr(f"{e.replace('_v', 'value')} as {c}") for c, e in MOMENTS.items()])
    return stats.select("column", position(columns).alias("pos"), *MOMENT_COLUMNS)


def position(columns: list[str]) -> Column:
    """Place of ``column`` in the given list."""
    return F.create_map(*[e for i, c in enumerate(columns) for e in (F.lit(c), F.lit(i))])[F.col("column")]


def adjusted_skew() -> Column:
    """Bias-adjusted skew from n and g1; 0 for a constant column, null below three values."""
    n = F.col("n").cast("double")
    return F.when(F.col("n") > 2, F.coalesce(F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2), F.lit(0.0)))


def adjusted_kurtosis() -> Column:
    """Bias-adjusted excess kurtosis from n and g2; 0 for a constant column, null below four values."""
    n = F.col("n").cast("double")
    value = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6)
    return F.when(F.col("n") > 3, F.coalesce(value, F.lit(0.0)))


def long_numbers(df: DataFrame, columns: list[str], name: str = "column") -> DataFrame:
    """(column, value) with the double values of the given columns, one row per cell."""
    wide = df.select(*[as_number(df, c).alias(c) for c in columns])
    return wide.unpivot([], [ref(c) for c in columns], name, "value")


def column_quantiles(df: DataFrame, columns: list[str], shares: dict[str, float] = QUARTILES,
                     rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    return quantiles(long_numbers(df, columns), ["column"], "value", shares, rows_per_slice)


def with_quantiles(df: DataFrame, columns: list[str], shares: dict[str, float] = QUARTILES) -> DataFrame:
    """Moments and exact quantiles side by side, one row per column; the moments ride along with the sketch."""
    found = quantiles(long_numbers(df, columns), ["column"], "value", shares, also=MOMENTS)
    return found.select("column", position(columns).alias("pos"), *MOMENT_COLUMNS, *shares)


def missing_counts(df: DataFrame) -> DataFrame:
    """column, pos, n_rows, missing for every column, from one aggregate."""
    rows = []
    for i, f in enumerate(df.schema.fields):
        seen = finite_sql(f.name) if isinstance(f.dataType, REAL_TYPES) else quoted(f.name)
        rows.append(F.struct(F.lit(f.name).alias("column"), F.lit(i).alias("pos"), F.expr("count(1) as n_rows"),
                             F.expr(f"count(1) - count({seen}) as missing")))
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))
