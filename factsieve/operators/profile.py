"""Dataset and column profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factsieve.functions.columns import NESTED_TYPES, TIME_TYPES, percent, ref
from factsieve.plans.facts import Facts
from factsieve.plans.frequency import SHOWN, distinct_counts, top_of, value_counts
from factsieve.plans.moments import adjusted_kurtosis, adjusted_skew, missing_counts, with_quantiles
from factsieve.plans.rows import duplicate_summary, side_by_side
from factsieve.sources.tables import logical_bytes

ROLES = ["numeric", "categorical", "datetime", "boolean", "text"]  # fixed values


def missing_by_column(df: DataFrame) -> DataFrame:
    return missing_counts(df).select("column", "missing", percent(F.col("missing"), F.col("n_rows")).alias("missing_pct"))


def distinct_by_column(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    base = missing_counts(df if columns is None else df.select(*[ref(c) for c in columns]))
    return (base.join(distinct_counts(value_counts(df, columns)), "column", "left")
            .select("column", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"),
                    percent(F.coalesce("n_distinct", F.lit(0)), F.col("n_rows")).alias("distinct_pct")))


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    return with_quantiles(df, columns).select(
        "column", "n", "missing", "mean", "median", "std", "min", "max", "q1", "q3",
        adjusted_skew().alias("skew"), adjusted_kurtosis().alias("kurtosis"))


def datetime_profile(df: DataFrame) -> DataFrame:
    """column, n, missing, first, last of the date and time columns."""
    rows = []
    for f in df.schema.fields:
        if isinstance(f.dataType, TIME_TYPES):
            c = ref(f.name).cast("timestamp_ntz")
            rows.append(F.struct(F.lit(f.name).alias("column"), F.count(c).alias("n"),
                                 (F.count(F.lit(1)) - F.count(c)).alias("missing"),
                                 F.min(c).alias("first"), F.max(c).alias("last")))
    if not rows:
        raise ValueError("the table has no column of dates or times")
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def top_values(df: DataFrame, columns: list[str] | None = None, k: int = 10,
               counts: DataFrame | None = None) -> DataFrame:
    """column, rank, value, count, pct of all rows, for the k most frequent values of each column."""
    counts = value_counts(df, columns) if counts is None else counts
    return top_of(counts, k).select("column", "rank", F.col("shown").alias("value"), F.col("cnt").alias("count"),
                                    percent(F.col("cnt"), F.lit(df.count())).alias("pct"))


def value_sample(df: DataFrame, columns: list[str], order_by: list[str], k: int = 5) -> DataFrame:
    """column, rank, value: the first k non-null values of each column in the order of ``order_by``."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.substring(ref(c).cast("string"), 1, SHOWN).alias("value"))
                      for c in columns])
    keys = [ref(c).alias(f"_k{i}") for i, c in enumerate(order_by)]
    long = df.select(*keys, F.inline(cells)).where(F.col("value").isNotNull())
    w = W.partitionBy("column").orderBy(*[f"_k{i}" for i in range(len(order_by))], "value")
    return (long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("column", F.col("rank").cast("long").alias("rank"), "value"))


def dataset_summary(df: DataFrame, facts: Facts | None = None) -> DataFrame:
    """One row: sizes, columns per role, column types (``name:type``), missing cells, duplicate rows, logical bytes."""
    facts = facts or Facts(df)
    listed = [F.lit(",".join(facts.with_role(r))).alias(f"{r}_columns") for r in ROLES]
    width = len(df.columns)
    missing = facts.missing.agg(F.sum("missing").alias("missing_cells"))
    size = logical_bytes(df).agg(F.sum("bytes").alias("logical_bytes"))
    one_row = side_by_side(facts.duplicates, missing, size)
    return one_row.select(
        F.col("n_rows").alias("rows"), F.lit(width).cast("long").alias("columns"), *listed,
        F.lit(",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields)).alias("types"),
        "missing_cells", percent(F.col("missing_cells"), F.col("n_rows") * width).alias("missing_pct"),
        "duplicate_rows", percent(F.col("duplicate_rows"), F.col("n_rows")).alias("duplicate_pct"),
        "logical_bytes")


def _samples(df: DataFrame, facts: Facts, order_by: list[str] | None, k: int = 5) -> DataFrame:
    """column, sample: the first values in the order of ``order_by``, or distinct values in the order of their hashes."""
    if order_by:
        names = [f.name for f in df.schema.fields if not isinstance(f.dataType, NESTED_TYPES)]
        rows = value_sample(df, names, order_by, k)
    else:
        w = W.partitionBy("column").orderBy(F.xxhash64("key"), "key")
        rows = facts.counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("column", "rank", F.col("shown").alias("value"))
    listed = F.array_sort(F.collect_list(F.struct("rank", "value")))
    return rows.groupBy("column").agg(F.transform(listed, lambda s: s["value"]).alias("sample"))


def full_profile(df: DataFrame, max_columns: int | None = None, facts: Facts | None = None, order_by: list[str] | None = None) -> DataFrame:
    """One row per column with everything known about it: all columns, or the first ``max_columns`` (``truncated`` tells of more).

    ``sample`` holds five values: the first by ``order_by``, or distinct ones in the order of their hashes.
    """
    facts = (facts or Facts(df)).warm()
    base = facts.columns if max_columns is None else facts.columns.where(F.col("pos") < max_columns)
    tops = top_of(facts.counts, 10)
    tops = tops.groupBy("column").agg(
        F.max(F.when(F.col("rank") == 1, F.col("shown"))).alias("mode"),
        F.max(F.when(F.col("rank") == 1, F.col("cnt"))).alias("mode_count"),
        F.array_sort(F.collect_list(F.struct("rank", F.col("shown").alias("value"), F.col("cnt").alias("count"))))
        .alias("top_values"))
    types = df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema.fields], "column string, type string")
    out = base.join(types, "column").join(tops, "column", "left").join(_samples(df, facts, order_by), "column", "left")
    if facts.with_role("numeric"):
        stats = facts.numbers.select("column", "mean", "median", "std", "min", "max", "q1", "q3",
                                     adjusted_skew().alias("skew"), adjusted_kurtosis().alias("kurtosis"))
        out = out.join(stats, "column", "left")
    else:
        out = out.select("*", *[F.lit(None).cast("double").alias(c) for c in
                                ["mean", "median", "std", "min", "max", "q1", "q3", "skew", "kurtosis"]])
    if any(isinstance(f.dataType, TIME_TYPES) for f in df.schema.fields):
        out = out.join(datetime_profile(df).select("column", "first", "last"), "column", "left")
    else:
        out = out.select("*", F.lit(None).cast("timestamp_ntz").alias("first"),
                         F.lit(None).cast("timestamp_ntz").alias("last"))
    n = F.col("n_rows")
    return out.select(
        "column", "pos", "role", "type", (n - F.col("missing")).alias("count"), "missing",
        percent(F.col("missing"), n).alias("missing_pct"), "n_distinct",
        percent(F.col("n_distinct"), n).alias("distinct_pct"),
        "mean", "median", "std", "min", "max", "q1", "q3", "skew", "kurtosis", "first", "last",
        "mode", "mode_count", "top_values", "sample",
        F.lit(max_columns is not None and len(df.columns) > max_columns).alias("truncated"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    d = duplicate_summary(df)
    return d.select("n_rows", "duplicate_rows", percent(F.col("duplicate_rows"), F.col("n_rows")).alias("duplicate_pct"))
