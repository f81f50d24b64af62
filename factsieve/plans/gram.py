"""Sums of products of all column pairs in one pass.

Every task turns its Arrow batches into matrix products: with X the values (missing ones 0) and M their mask, M'M counts the
complete rows of each pair, X'M and (X*X)'M give the sums of one side over them, X'X the products.  A task hands on one row
per first column, so the plan does not grow with the columns and the shuffle only with their square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factsieve.functions.columns import as_number

SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")
#: A spread below this share of the distance to zero is rounding of a constant.
SAME = 1e-14


def _blocks(width: int, shift: list[float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(SUMS), width, width))
        for batch in batches:
            x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(width)]) if len(batch) else np.zeros((0, width))
            x = x.astype(float) - np.array(shift)
            m = np.isfinite(x)
            x, m = np.where(m, x, 0.0), m.astype(float)
            own, square = x.T @ m, (x * x).T @ m
            for i, part in enumerate((m.T @ m, own, own.T, square, square.T, x.T @ x)):
                total[i] += part
        lists = [pa.ListArray.from_arrays(np.arange(width + 1, dtype=np.int32) * width, pa.array(t.ravel())) for t in total]
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), *lists], ["i", *SUMS])

    return run


def pair_sums(df: DataFrame, columns: list[str]) -> DataFrame:
    """i, j, the six sums over the rows complete in columns i and j, and the shifts that were taken off."""
    width = len(columns)
    numbers = df.select(*[as_number(df, c).alias(f"c{k}") for k, c in enumerate(columns)])
    means = numbers.agg(*[F.avg(c).alias(c) for c in numbers.columns]).first()
    shift = [float(v or 0.0) for v in means]
    rows = numbers.mapInArrow(_blocks(width, shift), "i int, " + ", ".join(f"{s} array<double>" for s in SUMS))
    flat = rows.select("i", F.posexplode(F.arrays_zip(*SUMS)).alias("j", "s")).select("i", "j", "s.*")
    shifts = F.array(*[F.lit(v) for v in shift])
    return (flat.groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in SUMS])
            .withColumns({"mx": F.get(shifts, F.col("i")), "my": F.get(shifts, F.col("j"))}))


def pair_correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """i, j, n, r of all column pairs over their complete rows; r is null where a side is constant."""
    def spread(square: str, total: str, shift: str):
        value = F.try_divide(F.col(square) - F.col(total) * F.try_divide(F.col(total), F.col("n")), F.col("n"))
        floor = F.pow(F.abs(shift) * SAME, F.lit(2))
        return F.when(value > floor, value)

    both = F.try_divide(F.col("sxy") - F.col("sx") * F.try_divide(F.col("sy"), F.col("n")), F.col("n"))
    r = both / F.sqrt(spread("sxx", "sx", "mx")) / F.sqrt(spread("syy", "sy", "my"))
    clipped = F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
    return pair_sums(df, columns).select("i", "j", F.col("n").cast("long").alias("n"), clipped.alias("r"))
