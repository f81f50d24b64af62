"""The aggregates behind the usual questions about a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factsieve.functions.columns import NULL_LABEL, as_number, ref
from factsieve.operators.eda import group_means, strongest_pairs
from factsieve.operators.profile import missing_by_column
from factsieve.plans.moments import column_quantiles, with_quantiles


def missing_columns(df: DataFrame, k: int = 20) -> DataFrame:
    return missing_by_column(df).where("missing > 0").orderBy(F.desc("missing"), "column").limit(k)


def strongest_correlations(df: DataFrame, k: int = 5) -> DataFrame:
    return strongest_pairs(df, k=k).withColumn("r", F.round("r", 3))


def column_aggregate(df: DataFrame, column: str) -> DataFrame:
    return with_quantiles(df, [column], {"median": 0.5}).select(
        "column", "n", "mean", "median", F.col("total").alias("sum"), "min", "max")


def top_groups(df: DataFrame, group: str, value: str, k: int = 10, null_label: str = NULL_LABEL) -> DataFrame:
    return group_means(df, group, value, k, null_label)


def outlier_records(df: DataFrame, column: str, key: list[str], k: int = 20) -> DataFrame:
    """The first k rows, by ``key``, whose value lies strictly outside the fences; none without spread."""
    fit = column_quantiles(df, [column], {"q1": 0.25, "q3": 0.75}).first()
    x = as_number(df, column)
    rows = df.select(*[ref(c) for c in key], x.alias("value"))
    if fit is None or fit["q1"] == fit["q3"]:
        return rows.where("1 = 0")
    reach = 1.5 * (fit["q3"] - fit["q1"])
    out = (F.col("value") < F.lit(fit["q1"] - reach)) | (F.col("value") > F.lit(fit["q3"] + reach))
    return rows.where(out).orderBy(*[ref(c) for c in key]).limit(k)
