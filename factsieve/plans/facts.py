"""Facts about one table, each computed once and shared by all reports on it."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factsieve.functions.columns import numeric_columns, string_columns
from factsieve.operators.roles import column_roles
from factsieve.plans.frequency import distinct_counts, value_counts
from factsieve.plans.moments import missing_counts, with_quantiles
from factsieve.plans.rows import duplicate_summary
from factsieve.plans.store import materialize


class Facts:
    """Frequency table, moments, roles and duplicates of ``df``; tables with one row per column or value."""

    def __init__(self, df: DataFrame):
        self.df = df

    def warm(self) -> Facts:
        """Computes the facts that do not depend on each other as concurrent jobs, so that none waits for the tail of another."""
        own = [lambda: self.counts, lambda: self.duplicates, lambda: self.missing]
        if numeric_columns(self.df):
            own.append(lambda: self.numbers)
        with ThreadPoolExecutor(len(own)) as pool:
            list(pool.map(lambda compute: compute(), own))
        return self

    @cached_property
    def missing(self) -> DataFrame:
        return materialize(missing_counts(self.df), "missing")

    @cached_property
    def counts(self) -> DataFrame:
        return materialize(value_counts(self.df), "counts")

    @cached_property
    def roles(self) -> dict[str, str]:
        rows = column_roles(self.df, self.counts if string_columns(self.df) else None).collect()
        found = {r["column"]: r["role"] for r in rows}
        return {c: found[c] for c in self.df.columns}

    def with_role(self, *roles: str) -> list[str]:
        return [c for c, r in self.roles.items() if r in roles]

    @cached_property
    def columns(self) -> DataFrame:
        """column, pos, role, n_rows, missing, n_distinct, top_count: one row per column."""
        roles = self.df.sparkSession.createDataFrame(list(self.roles.items()), "column string, role string")
        joined = (self.missing.join(roles, "column")
                  .join(distinct_counts(self.counts), "column", "left"))
        return materialize(joined.select(
            "column", "pos", "role", "n_rows", "missing",
            F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"),
            F.coalesce("top_count", F.lit(0)).alias("top_count")).coalesce(1), "columns")

    @cached_property
    def numbers(self) -> DataFrame:
        """Moments and quartiles of the numeric columns."""
        names = numeric_columns(self.df)  # exactly the columns of role numeric
        if not names:
            raise ValueError("the table has no column of numbers")
        return materialize(with_quantiles(self.df, names).coalesce(1), "numbers")

    @cached_property
    def n_rows(self) -> int:
        return self.df.count()

    @cached_property
    def duplicates(self) -> DataFrame:
        """One row: n_rows, duplicate_rows."""
        return materialize(duplicate_summary(self.df), "duplicates")
