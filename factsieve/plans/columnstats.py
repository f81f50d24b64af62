"""Statistics that fitted operations ask of one table: all numbers in one aggregate, all modes in one, all date formats in one."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factsieve.functions.columns import NUMERIC_TYPES, present
from factsieve.plans import dates
from factsieve.plans.frequency import top_of
from factsieve.plans.moments import moments, with_quantiles


def modes(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """The most frequent value of each column as text, the smallest among ties; columns without values are left out."""
    cells = F.array(*[F.struct(
        F.lit(c).alias("column"), present(df, c).cast("string").alias("key"),
        (present(df, c).cast("double") if isinstance(df.schema[c].dataType, NUMERIC_TYPES) else F.lit(None).cast("double")).alias("num"))
        for c in columns])
    counts = df.select(F.inline(cells)).where("key is not null").groupBy("column", "key", "num").agg(F.count(F.lit(1)).alias("cnt"))
    return {r["column"]: r["key"] for r in top_of(counts.withColumn("shown", F.col("key")), 1).collect()}


class ColumnStatistics:
    """What ``wanted`` names as (kind, column), of kinds ``quartiles``, ``moments``, ``mode`` and ``format``."""

    def __init__(self, df: DataFrame, wanted: Iterable[tuple[str, str]] = ()):
        self.df = df
        of: dict[str, list[str]] = defaultdict(list)
        for kind, column in sorted(set(wanted)):
            of[kind].append(column)
        rows: list = []
        if of["quartiles"]:  # the moments ride along
            rows = with_quantiles(df, sorted({*of["quartiles"], *of["moments"]})).collect()
        elif of["moments"]:
            rows = moments(df, of["moments"]).collect()
        self._numbers = {r["column"]: r.asDict() for r in rows}
        self._modes = modes(df, of["mode"]) if of["mode"] else {}
        self._formats = dates.formats_of(df, of["format"]) if of["format"] else {}

    def number(self, column: str, name: str) -> float | None:
        return self._numbers.get(column, {}).get(name)

    def mode(self, column: str) -> str | None:
        return self._modes.get(column)

    def date_format(self, column: str):
        return self._formats[column]
