"""A written index of pages: the rows in their total order, cut into slices of known counts.

Building it is one range shuffle over all order columns (a hot value is split by the row key) and one write; each slice
is a folder whose rows carry their place in it.  A page then names its slices by a look at the counts and reads only these, so the
first page and the last cost the same, and no rows before the page are read or sorted.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factsieve.functions.columns import ref
from factsieve.plans.store import new_path

ROWS_PER_SLICE = 250_000
_PLACE_BITS = 33  # fixed value: the bits of monotonically_increasing_id that count rows inside a partition


@dataclass(frozen=True)
class PageIndex:
    """Pages of a written order; ``rows`` is their total number."""

    spark: SparkSession
    path: str
    rows: int

    @staticmethod
    def build(df: DataFrame, order: list[tuple[str, bool]], rows: int | None = None, rows_per_slice: int = ROWS_PER_SLICE,
              path: str | None = None) -> PageIndex:
        """Writes the rows of ``df`` to ``path`` in the order of (column, descending) pairs, which must leave no ties; missing values last."""
        spark, path = df.sparkSession, path or new_path(df.sparkSession, "pages")
        rows = df.count() if rows is None else rows
        slices = max(1, math.ceil(rows / rows_per_slice))
        wrapped = df.select(F.struct(*[ref(c) for c in df.columns]).alias("row"), *[ref(c).alias(f"o{i}") for i, (c, _) in enumerate(order)])
        ordered = [F.col(f"o{i}").desc_nulls_last() if down else F.col(f"o{i}").asc_nulls_last() for i, (_, down) in enumerate(order)]
        placed = wrapped.repartitionByRange(slices, *ordered).sortWithinPartitions(*ordered).select(
            F.monotonically_increasing_id().alias("id"), "row").select(
            F.shiftright("id", _PLACE_BITS).alias("slice"), F.col("id").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).alias("place"), "row")
        placed.limit(0).write.parquet(f"{path}/schema")  # an empty order has no slice to read it from
        placed.write.partitionBy("slice").parquet(f"{path}/rows")
        table = PageIndex(spark, path, rows)._rows()
        counts = table.groupBy("slice").agg(F.count(F.lit(1)).alias("n"))
        before = F.sum("n").over(W.orderBy("slice").rowsBetween(W.unboundedPreceding, -1))  # a row per slice
        counts.withColumn("first", F.coalesce(before, F.lit(0))).coalesce(1).write.parquet(f"{path}/slices")
        return PageIndex(spark, path, rows)

    def _rows(self) -> DataFrame:
        schema = self.spark.read.parquet(f"{self.path}/schema").select("place", "row", "slice").schema
        return self.spark.read.schema(schema).parquet(f"{self.path}/rows")

    @staticmethod
    def open(spark: SparkSession, path: str) -> PageIndex:
        """An index written before."""
        return PageIndex(spark, path, spark.read.parquet(f"{path}/slices").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])

    def page(self, number: int, size: int) -> DataFrame:
        """Rows of one page in order; the number is clamped to the pages there are."""
        pages = max(1, math.ceil(self.rows / size))
        low = (min(max(1, number), pages) - 1) * size
        hit = self.spark.read.parquet(f"{self.path}/slices").where((F.col("first") < low + size) & (F.col("first") + F.col("n") > low)).collect()
        table, inside = self._rows(), F.lit(False)
        for r in hit:  # no more slices than rows of a page
            here = F.col("place").between(F.lit(low - r["first"]), F.lit(low + size - 1 - r["first"]))
            inside = inside | ((F.col("slice") == r["slice"]) & here)
        return table.where(F.col("slice").isin([r["slice"] for r in hit]) & inside).orderBy("slice", "place").select("row.*")
