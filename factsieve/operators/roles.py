"""Column roles: numeric, categorical, datetime, boolean, text (and nested)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factsieve.functions.columns import NESTED_TYPES, NUMERIC_TYPES, TIME_TYPES, string_columns
from factsieve.plans import dates
from factsieve.plans.frequency import value_counts


def schema_roles(df: DataFrame) -> dict[str, str | None]:
    """Roles the types alone decide; None where the text has to be looked at."""
    out: dict[str, str | None] = {}
    for f in df.schema.fields:
        t = f.dataType
        out[f.name] = ("boolean" if isinstance(t, T.BooleanType) else
                       "datetime" if isinstance(t, TIME_TYPES) else
                       "numeric" if isinstance(t, NUMERIC_TYPES) else
                       "nested" if isinstance(t, NESTED_TYPES) else
                       None if isinstance(t, T.StringType) else "text")
    return out


def text_roles(counts: DataFrame) -> DataFrame:
    """column, role, date_format for text columns, from their frequency table (every value weighs with its count).

    A column is a date column if its one format reads enough of the values; ``date_format`` is null for other columns.
    """
    weigh = lambda cond: F.sum(F.when(cond, F.col("cnt")).otherwise(0))
    s = dates.judged(counts, "bare").groupBy("column").agg(
        F.sum("cnt").alias("n"), F.count(F.lit(1)).alias("u"),
        F.sum(F.col("chars") * F.col("cnt")).alias("chars"),
        dates.verdict(dates.votes("cnt")).alias("v"), weigh(F.col("plain")).alias("plain"))
    n, u = F.col("n"), F.col("u")
    datelike = (n >= 3) & (F.col("v.parsed") >= F.greatest(F.lit(3), F.floor(n * 0.7))) & (F.col("plain") / n <= 0.7)
    role = (F.when(datelike, "datetime")
            .when((u / n > 0.9) & (F.col("chars") / n > 24), "text")
            .when((u > 100) & (u / n > 0.5), "text")
            .otherwise("categorical"))
    return s.select("column", role.alias("role"), F.when(datelike, F.col("v.format")).alias("date_format"))


def column_roles(df: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """column, pos, role: one row per column.  A text column without any value is ``text``."""
    return typed_columns(df, counts).select("column", "pos", "role")


def typed_columns(df: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """column, pos, role, date_format (of text columns that hold dates): one row per column."""
    known = schema_roles(df)
    base = df.sparkSession.createDataFrame(
        [(c, i, known[c]) for i, c in enumerate(df.columns)], "column string, pos int, known string")
    texts = string_columns(df)
    if not texts:
        return base.select("column", "pos", F.col("known").alias("role"), F.lit(None).cast("string").alias("date_format"))
    counts = value_counts(df, texts) if counts is None else counts.where(F.col("column").isin(texts))
    return (base.join(text_roles(counts), "column", "left")
            .select("column", "pos", F.coalesce("known", "role", F.lit("text")).alias("role"), "date_format"))


def role_map(df: DataFrame, counts: DataFrame | None = None) -> dict[str, str]:
    known = schema_roles(df)
    if None not in known.values():
        return known
    found = {r["column"]: r["role"] for r in column_roles(df, counts).collect()}
    return {c: found[c] for c in df.columns}


def columns_by_role(df: DataFrame) -> DataFrame:
    """role, n_columns, columns (comma separated in table order)."""
    listed = F.array_sort(F.collect_list(F.struct("pos", "column")))
    return (column_roles(df).groupBy("role")
            .agg(F.count(F.lit(1)).alias("n_columns"), listed.alias("l"))
            .select("role", "n_columns", F.array_join(F.transform("l", lambda s: s["column"]), ",").alias("columns")))
