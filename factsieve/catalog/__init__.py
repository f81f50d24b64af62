"""All registered queries with the SQL that must give the same rows."""

from __future__ import annotations

from factsieve.catalog import (chart_queries, clean_queries, insight_queries, ml_queries, profile_queries, quality_queries, stat_queries,
                               stream_queries)

FAMILIES = (profile_queries, quality_queries, clean_queries, chart_queries, stat_queries, insight_queries, ml_queries, stream_queries)


def _collect(name: str) -> dict:
    out: dict = {}
    for family in FAMILIES:
        out.update(getattr(family, name))
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("ORACLE")
