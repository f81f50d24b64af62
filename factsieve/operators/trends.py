"""Earliest against latest third of a time-ordered column, without sorting the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factsieve.functions.columns import as_number, as_time, micros
from factsieve.plans.quantiles import order_statistics


def trend_thirds(df: DataFrame, time: str, columns: list[str]) -> DataFrame:
    """column, n, early_mean, recent_mean, pct_change, direction per numeric column.

    The thirds are bounded by exact order statistics of the time.  Rows sharing the
    bounding time count with the share of them that still fits, so the result does not
    depend on how equal times are ordered.
    """
    t = micros(as_time(df, time))
    wide = df.where(t.isNotNull()).select(t.alias("_t"), *[as_number(df, c).alias(f"c{i}") for i, c in enumerate(columns)])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("y")) for i, c in enumerate(columns)])
    long = wide.select("_t", F.inline(cells)).where("y is not null")

    def third(n):
        return F.greatest(F.lit(1), F.floor(n / 3))

    edges = order_statistics(long, ["column"], "_t", [
        ("_first", 1 / 3, "greatest(1, floor(n / 3)) - 1"), ("_last", 2 / 3, "n - greatest(1, floor(n / 3))")])
    joined = long.join(edges, "column")

    def sums(name: str, inside, tie) -> list:
        return [F.coalesce(F.sum(F.when(inside, F.col("y"))), F.lit(0.0)).alias(f"{name}_sum"), F.count_if(inside).alias(f"{name}_n"),
                F.avg(F.when(tie, F.col("y"))).alias(f"{name}_tie")]

    s = joined.groupBy("column", "n").agg(
        *sums("a", F.col("_t") < F.col("_first"), F.col("_t") == F.col("_first")),
        *sums("b", F.col("_t") > F.col("_last"), F.col("_t") == F.col("_last")))
    k = third(F.col("n"))
    early = (F.col("a_sum") + (k - F.col("a_n")) * F.col("a_tie")) / k
    recent = (F.col("b_sum") + (k - F.col("b_n")) * F.col("b_tie")) / k
    means = s.select("column", "n", early.alias("early_mean"), recent.alias("recent_mean"))
    change = F.when(F.col("early_mean") == 0, 0.0).otherwise(
        F.try_divide((F.col("recent_mean") - F.col("early_mean")) * 100, F.abs("early_mean")))
    return means.select(
        "column", "n", "early_mean", "recent_mean", change.alias("pct_change"),
        F.when(F.col("recent_mean") > F.col("early_mean"), "up").when(F.col("recent_mean") < F.col("early_mean"), "down")
        .otherwise("flat").alias("direction"))
