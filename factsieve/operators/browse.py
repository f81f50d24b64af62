"""Row browsing: search, sort, pages."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factsieve.functions.columns import NESTED_TYPES, NULL_LABEL, group_key, ref
from factsieve.plans.pages import PageIndex


def search_condition(df: DataFrame, text: str, regex: bool = False, null_label: str = NULL_LABEL) -> Column:
    """True where any column, as lower-cased text, holds the search text (or matches the pattern)."""
    wanted = text.strip().lower()
    if not wanted:
        return F.lit(True)
    if regex:
        try:
            re.compile(wanted)
        except re.error as e:
            raise ValueError(f"Bad search pattern: {e}") from e
    tests = []
    for f in df.schema.fields:
        shown = F.to_json(ref(f.name)) if isinstance(f.dataType, NESTED_TYPES) else ref(f.name)
        value = F.lower(group_key(shown, null_label))
        tests.append(value.rlike(wanted) if regex else value.contains(wanted))
    return reduce(lambda a, b: a | b, tests)


def search_rows(df: DataFrame, text: str, regex: bool = False) -> DataFrame:
    return df.where(search_condition(df, text, regex))


def _order(column: str | None, descending: bool, row_key: list[str]) -> list[Column]:
    first = [] if not column else [ref(column).desc_nulls_last() if descending else ref(column).asc_nulls_last()]
    return first + [ref(k).asc_nulls_last() for k in row_key]


def sort_rows(df: DataFrame, column: str, row_key: list[str], descending: bool = False) -> DataFrame:
    """Rows by one column, missing last in both directions, ties by ``row_key``."""
    return df.orderBy(*_order(column, descending, row_key))


def page_counts(df: DataFrame, text: str = "", page_size: int = 25) -> DataFrame:
    """total_rows, filtered_rows, total_pages from one aggregate."""
    size = min(100, max(5, page_size))
    hit = F.count_if(search_condition(df, text))
    return df.agg(F.count(F.lit(1)).alias("total_rows"), hit.alias("filtered_rows")).withColumn(
        "total_pages", F.greatest(F.lit(1), F.ceil(F.col("filtered_rows") / size)).cast("long"))


def page_rows(df: DataFrame, page: int, row_key: list[str], page_size: int = 25, text: str = "",
              column: str | None = None, descending: bool = False) -> DataFrame:
    """One page of the searched and sorted rows; page and size are clamped to what exists.

    For more pages of the same order keep the index of ``page_index``.
    """
    return page_index(df, row_key, text, column, descending).page(page, min(100, max(5, page_size)))


def page_index(df: DataFrame, row_key: list[str], text: str = "", column: str | None = None, descending: bool = False,
               path: str | None = None) -> PageIndex:
    """Writes the searched rows in their order; each page of the index then reads its own slice only.

    ``row_key`` must tell all rows apart.
    """
    found = search_rows(df, text) if text else df
    return PageIndex.build(found, ([(column, descending)] if column else []) + [(k, False) for k in row_key], path=path)
