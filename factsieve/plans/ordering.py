"""Global order without a one-partition window.

Rows are cut into slices of the total order.  The slice bounds are taken from a
small sample (as Spark's own range partitioner does) and become literals, so
every pass assigns a row to the same slice.  Bounds are tuples of all order
columns: one hot value in the first column is split by the next columns.
The sample only balances the slices, no result depends on it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factsieve.functions.columns import ref

ROWS_PER_SLICE = 2_000_000
SAMPLES_PER_SLICE = 40


def _slice_count(df: DataFrame, rows: int, rows_per_slice: int) -> int:
    wanted = math.ceil(rows / rows_per_slice)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(1, min(wanted, 8 * parts))


def slice_column(df: DataFrame, order: list[str], rows: int, rows_per_slice: int = ROWS_PER_SLICE) -> Column | None:
    """Slice number of each row in the order of ``order``, or None when one slice is enough."""
    count = _slice_count(df, rows, rows_per_slice)
    if count <= 1:
        return None
    keys = df.select(*[ref(c).alias(f"k{i}") for i, c in enumerate(order)])
    names = keys.columns
    share = min(1.0, count * SAMPLES_PER_SLICE / max(rows, 1))
    sample = keys.sample(share, seed=1).orderBy(*names).collect()
    if not sample:
        return None
    picks = sorted({round(i * len(sample) / count) for i in range(1, count)})
    bounds = []
    for i in picks:
        if i < len(sample) and (not bounds or bounds[-1] != sample[i]):
            bounds.append(sample[i])
    types = {f.name: f.dataType for f in keys.schema.fields}
    table = F.array(*[F.struct(*[F.lit(b[n]).cast(types[n]).alias(n) for n in names]) for b in bounds])
    key = F.struct(*[ref(c).alias(n) for c, n in zip(order, names)])
    steps = [1 << p for p in reversed(range(len(bounds).bit_length()))]
    # binary search: how many bounds lie below the key
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0),
        lambda pos, step: F.when(F.get(table, pos + step - 1) < key, pos + step).otherwise(pos))


def running_total(df: DataFrame, keys: list[str], order: list[str], weight: str, out: str = "before",
                  rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Adds the sum of ``weight`` over the rows that come earlier in ``order`` within ``keys``.

    ``df`` must be a written table with distinct ``order`` values per key.
    Above ``rows_per_slice`` rows the sum is taken inside slices, and each slice
    starts from the total of the slices before it.
    """
    key_cols = [ref(k) for k in keys]
    earlier = (W.unboundedPreceding, -1)
    cut = slice_column(df, keys + order, df.count(), rows_per_slice)
    zero = F.lit(0).cast(df.schema[weight].dataType)
    if cut is None:
        w = W.partitionBy(*key_cols).orderBy(*[ref(c) for c in order]).rowsBetween(*earlier)
        return df.withColumn(out, F.coalesce(F.sum(ref(weight)).over(w), zero))
    sliced = df.withColumn("_slice", cut)
    totals = sliced.groupBy(*key_cols, "_slice").agg(F.sum(ref(weight)).alias("_sum"))
    start = totals.select(
        *key_cols, "_slice",
        F.sum("_sum").over(W.partitionBy(*key_cols).orderBy("_slice").rowsBetween(*earlier)).alias("_start"))
    w = W.partitionBy(*key_cols, "_slice").orderBy(*[ref(c) for c in order]).rowsBetween(*earlier)
    inside = sliced.withColumn("_inside", F.sum(ref(weight)).over(w))
    return (inside.join(start, keys + ["_slice"])
            .withColumn(out, F.coalesce("_inside", zero) + F.coalesce("_start", zero))
            .drop("_slice", "_inside", "_start"))


def carry(df: DataFrame, column: str, order: list[str], forward: bool, partition_by: list[str] | None = None,
          rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Fills nulls of ``column`` with the last earlier (or next later) value in ``order``.

    The backward fill runs over the reversed order, so that both use a growing frame
    (a frame that ends at the last row would be rescanned for every row).
    """
    names, groups = df.columns, [ref(c) for c in partition_by or []]
    ordered = [ref(c).asc() if forward else ref(c).desc() for c in order]
    so_far = (W.unboundedPreceding, W.currentRow)
    cut = slice_column(df, (partition_by or []) + order, df.count(), rows_per_slice)
    if cut is None:
        w = W.partitionBy(*groups).orderBy(*ordered).rowsBetween(*so_far)
        return df.withColumn(column, F.last(ref(column), ignorenulls=True).over(w))
    sliced = df.withColumn("_slice", cut)
    edge = F.max_by if forward else F.min_by
    position = F.struct(*[ref(c) for c in order])
    ends = sliced.groupBy(*groups, "_slice").agg(
        edge(ref(column), F.when(ref(column).isNotNull(), position)).alias("_edge"))
    by_slice = F.col("_slice").asc() if forward else F.col("_slice").desc()
    earlier = W.partitionBy(*groups).orderBy(by_slice).rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(
        *[g.alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_slice").alias("_at"),
        F.last("_edge", ignorenulls=True).over(earlier).alias("_in"))
    w = W.partitionBy(*groups, "_slice").orderBy(*ordered).rowsBetween(*so_far)
    filled = sliced.withColumn(column, F.last(ref(column), ignorenulls=True).over(w))
    same = F.col("_slice") == F.col("_at")
    for i, g in enumerate(groups):
        same = same & g.eqNullSafe(F.col(f"_g{i}"))
    return (filled.join(carried, same)
            .withColumn(column, F.coalesce(ref(column), ref("_in")))
            .select(*[ref(c) for c in names]))
