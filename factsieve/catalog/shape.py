"""Small helpers that bring a result into the shape both engines agree on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factsieve.functions.columns import ref


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded, so that the order of summation does not show; -0.0 becomes 0.0."""
    return df.select(*[
        (F.round(ref(f.name), digits) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType))
        else ref(f.name) for f in df.schema.fields])


def union_sql(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)
