"""Rank correlations of column pairs, without one-task sorts and without comparing all row pairs.

Only rows complete in both columns of a pair count for that pair.

Spearman: a column is ranked once for all its pairs.  The ranks of the distinct values go back to the rows, and all pairs come out of one
pass of masked matrix products.  Where a column has gaps, its partner's ranks are those among the rows that the two share, so such
pairs are ranked by themselves.

Kendall: rows are counted per distinct (x, y) of a pair.  The discordant ones are the inversions between the order by (x, y) and the order by
(y, x), and both orders are cut into slices: see ``discordant_pairs``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factsieve.functions.columns import as_number
from factsieve.plans.gram import pair_correlations
from factsieve.plans.ordering import ROWS_PER_SLICE, running_total
from factsieve.plans.store import materialize

BIG = "decimal(38,0)"
#: Distinct values, of all columns together, that are broadcast with their ranks: 16 MB.
SMALL_VALUES = 1_000_000


def counted_pairs(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """pair, x, y, cnt: distinct complete value pairs of each column pair (written)."""
    names = sorted({c for p in pairs for c in p})
    wide = df.select(*[as_number(df, c).alias(f"c{i}") for i, c in enumerate(names)])
    at = {c: f"c{i}" for i, c in enumerate(names)}
    cells = F.array(*[F.struct(F.lit(i).alias("pair"), F.col(at[x]).alias("x"), F.col(at[y]).alias("y"))
                      for i, (x, y) in enumerate(pairs)])
    rows = wide.select(F.inline(cells)).where("x is not null and y is not null")
    return materialize(rows.groupBy("pair", "x", "y").agg(F.count(F.lit(1)).alias("cnt")), "pairs")


def side_counts(counted: DataFrame) -> DataFrame:
    """pair, side, v, cnt: distinct values of both sides (written)."""
    sides = F.array(F.struct(F.lit("x").alias("side"), F.col("x").alias("v")),
                    F.struct(F.lit("y").alias("side"), F.col("y").alias("v")))
    return materialize(counted.select("pair", "cnt", F.inline(sides)).groupBy("pair", "side", "v")
                       .agg(F.sum("cnt").alias("cnt")), "sides")


def _named(pairs: list[tuple[str, str]], df: DataFrame, spark) -> DataFrame:
    names = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(pairs)], "pair int, x string, y string")
    return names.join(df, "pair", "left")


def mid_rank(before: str, count: str) -> Column:
    """Average rank of ``count`` equal values with ``before`` smaller ones."""
    return (F.col(before) + (F.col(count) + 1) / 2.0).cast("double")


def _own_ranks(df: DataFrame, pairs: list[tuple[str, str]], rows_per_slice: int) -> DataFrame:
    """pair, n, r of pairs with gaps: each is ranked over its complete rows."""
    counted = counted_pairs(df, pairs)
    placed = running_total(side_counts(counted), ["pair", "side"], ["v"], "cnt", "before", rows_per_slice)
    ranks = materialize(placed.select("pair", "side", "v", mid_rank("before", "cnt").alias("rank")), "ranks")

    def of(side: str) -> DataFrame:
        return ranks.where(F.col("side") == side).select("pair", F.col("v").alias(side), F.col("rank").alias(f"r{side}"))

    joined = counted.join(of("x"), ["pair", "x"]).join(of("y"), ["pair", "y"])
    # the mean rank is (n + 1) / 2, so the sums can be taken around it
    total = materialize(counted.groupBy("pair").agg(F.sum("cnt").alias("n")).coalesce(1), "totals")
    mid = (F.col("n") + 1) / 2.0
    a, b, w = F.col("rx") - mid, F.col("ry") - mid, F.col("cnt")
    sums = joined.join(total, "pair").groupBy("pair", "n").agg(
        F.sum(w * a * b).alias("ab"), F.sum(w * a * a).alias("aa"), F.sum(w * b * b).alias("bb"))
    return sums.select("pair", "n", F.try_divide(F.col("ab"), F.sqrt("aa") * F.sqrt("bb")).alias("r"))


def _lookup(known: list, ranked: dict[int, int]) -> callable:
    """Ranks in place of values: by search in the sorted values of a column, or from the column that holds them already."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = known.value
        for batch in batches:
            out = []
            for i, table in enumerate(tables):
                if table is None:
                    out.append(batch.column(ranked[i]).cast(pa.float64()))
                else:
                    values, ranks = table
                    at = np.searchsorted(values, batch.column(ranked[i]).to_numpy(zero_copy_only=False))
                    out.append(pa.array(ranks[at]))
            yield pa.RecordBatch.from_arrays(out, [f"r{i}" for i in range(len(tables))])

    return run


def ranked_columns(df: DataFrame, columns: list[str], rows_per_slice: int = ROWS_PER_SLICE, small_values: int = SMALL_VALUES) -> DataFrame:
    """r0, r1, ...: the rows of ``df`` with the average rank of every value in place of the value (of complete columns).

    The columns with the fewest distinct values, ``small_values`` in all, are looked up in their sorted values, which are broadcast; the cells
    of the others meet their ranks in a join and go back to their rows.
    """
    at = range(len(columns))
    numbers = df.select(*[as_number(df, c).alias(f"c{i}") for i, c in enumerate(columns)])
    cell = lambda i, *more: F.struct(F.lit(i).alias("c"), F.col(f"c{i}").alias("v"), *more)
    values = materialize(numbers.select(F.inline(F.array(*[cell(i) for i in at]))).groupBy("c", "v").agg(F.count(F.lit(1)).alias("cnt")), "values")
    placed = running_total(values, ["c"], ["v"], "cnt", "before", rows_per_slice)
    ranks = materialize(placed.select("c", "v", mid_rank("before", "cnt").alias("rank")), "ranks")
    small, room = [], small_values
    for c, size in sorted(((r["c"], r["count"]) for r in values.groupBy("c").count().collect()), key=lambda r: (r[1], r[0])):
        room -= size
        if room >= 0:
            small.append(c)
    tables = [None] * len(columns)
    found = ranks.where(F.col("c").isin(small)).orderBy("c", "v").toPandas()  # ``small_values`` rows at most
    for i in small:
        own = found[found["c"] == i]
        tables[i] = own["v"].to_numpy(), own["rank"].to_numpy()
    big = [i for i in at if i not in small and values.take(1)]
    if not big:
        wide, ranked = numbers, {i: i for i in at}
    else:
        # the row numbers are written with the rows, so a recomputed task cannot deal other ones
        rows = materialize(numbers.withColumn("row", F.monotonically_increasing_id()), "numbers")
        carried = lambda i: [(F.col(f"c{k}") if i == big[0] else F.lit(None).cast("double")).alias(f"s{k}") for k in small]
        cells = rows.select("row", F.inline(F.array(*[cell(i, *carried(i)) for i in big])))
        back = cells.join(ranks, ["c", "v"]).groupBy("row").agg(
            *[F.max(F.when(F.col("c") == i, F.col("rank"))).alias(f"r{i}") for i in big], *[F.max(f"s{k}").alias(f"s{k}") for k in small])
        wide, ranked = back.drop("row"), {c: p for p, c in enumerate([*big, *small])}
    shared = df.sparkSession.sparkContext.broadcast(tables)
    out = wide.mapInArrow(_lookup(shared, ranked), ", ".join(f"r{i} double" for i in at))
    return materialize(out, "row_ranks") if big else out


def spearman_pairs(df: DataFrame, pairs: list[tuple[str, str]], rows_per_slice: int = ROWS_PER_SLICE,
                   small_values: int = SMALL_VALUES) -> DataFrame:
    """x, y, n, r with average ranks for ties; r is null where a side is constant."""
    names = list(dict.fromkeys(c for p in pairs for c in p))
    seen = df.agg(F.count(F.lit(1)).alias("all"), *[F.count(as_number(df, c)).alias(f"n{i}") for i, c in enumerate(names)]).first()
    complete = [c for i, c in enumerate(names) if seen[f"n{i}"] == seen["all"]]
    once = [(k, x, y) for k, (x, y) in enumerate(pairs) if x in complete and y in complete]
    others = [p for p in pairs if p[0] not in complete or p[1] not in complete]
    found = []
    if once:
        used = [c for c in complete if any(c in p[1:] for p in once)]
        of = {c: i for i, c in enumerate(used)}
        ranks = ranked_columns(df, used, rows_per_slice, small_values)
        wanted = df.sparkSession.createDataFrame([(x, y, of[x], of[y]) for _, x, y in once], "x string, y string, i int, j int")
        r = pair_correlations(ranks, ranks.columns)
        found.append(wanted.join(r, ["i", "j"], "left").select("x", "y", F.coalesce("n", F.lit(0)).alias("n"), "r"))
    if others:
        own = _named(others, _own_ranks(df, others, rows_per_slice), df.sparkSession)
        found.append(own.select("x", "y", F.coalesce("n", F.lit(0)).alias("n"), "r"))
    return found[0].unionByName(found[1]) if len(found) == 2 else found[0]


def inversions(first: np.ndarray, second: np.ndarray, weight: np.ndarray) -> int:
    """Sum of the products of weights of the pairs that the two orders put the other way round.

    ``first`` and ``second`` are the places of each row in two orders without ties.  Rows stand in the first order and are parted by the bits
    of their place in the second one, highest first: two rows differ first in one bit, and there a one before a zero is an inversion.
    """
    count = len(first)
    rows = np.empty(count, np.int64)
    rows[first] = np.arange(count)
    place, w = second[rows], weight[rows].astype(np.int64)
    # sums of products stay below the square of the sum of weights; beyond 64 bits whole numbers of any size take over
    if int(w.sum()) >= 1 << 31:
        w = w.astype(object)
    total = 0
    for bit in reversed(range(max(count - 1, 0).bit_length())):
        one = (place >> bit & 1).astype(bool)
        block = place >> (bit + 1)
        edge = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        size = np.diff(np.append(edge, count))
        ones = np.cumsum(np.where(one, w, 0)) - np.where(one, w, 0)
        total += int((w * (ones - np.repeat(ones[edge], size)))[~one].sum())
        # stable parting of each block: zeros first
        zeros_before = np.cumsum(~one) - ~one
        zeros = np.repeat(np.add.reduceat((~one).astype(np.int64), edge), size)
        begin, inside = np.repeat(edge, size), zeros_before - np.repeat(zeros_before[edge], size)
        to = np.where(one, begin + zeros + (np.arange(count) - begin - inside), begin + inside)
        moved, carried = np.empty_like(place), np.empty_like(w)
        moved[to], carried[to] = place, w
        place, w = moved, carried
    return total


def _places(*keys: np.ndarray) -> np.ndarray:
    """Place of each row in the order by the keys, the last one deciding first."""
    out = np.empty(len(keys[0]), np.int64)
    out[np.lexsort(keys)] = np.arange(len(out))
    return out


def _inside(minus_cells: bool) -> callable:
    """Inversions inside one slice, less those inside its cells if wanted."""
    def run(group: pa.Table) -> pa.Table:
        x, y, w, other = (group.column(c).to_numpy() for c in ("x", "y", "cnt", "other"))
        found = inversions(_places(y, x), _places(x, y), w)
        if minus_cells:
            found -= inversions(_places(y, x, other), _places(x, y, other), w)
        return pa.table({"pair": group.column("pair").slice(0, 1).cast(pa.int32()), "dis": pa.array([str(found)])})

    return run


def discordant_pairs(counted: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """pair, dis: row pairs with a smaller x and a larger y, from (pair, x, y, cnt) with distinct (x, y).

    They are the inversions between the order by (x, y) and the order by (y, x): equal values stand in the same way in both.  The rows are cut into
    slices of the first order and into slices of the second, each of ``rows_per_slice`` rows.  An inversion lies inside a slice of the first
    order, or inside one of the second, or in two cells (first slice, second slice) that differ in both numbers.  The first
    two are counted in numpy, a slice at a time, and what lies in one cell is taken off once; the last is counted over the cells alone.
    """
    rows = counted.count()
    slices = max(1, math.ceil(rows / rows_per_slice))
    if slices == 1:
        found = counted.select("pair", "x", "y", "cnt", F.lit(0).alias("other")).groupBy("pair").applyInArrow(
            _inside(False), "pair int, dis string")
        return found.select("pair", F.col("dis").cast(BIG).alias("dis"))
    # written, so that a lost executor cannot make Spark draw other bounds
    a = materialize(counted.repartitionByRange(slices, "pair", "x", "y").withColumn("xs", F.spark_partition_id()), "by_x")
    b = materialize(a.repartitionByRange(slices, "pair", "y", "x").withColumn("ys", F.spark_partition_id()), "by_y")
    out = "pair int, dis string"
    in_x = b.withColumnRenamed("ys", "other").groupBy("pair", "xs").applyInArrow(_inside(True), out)
    in_y = b.withColumnRenamed("xs", "other").groupBy("pair", "ys").applyInArrow(_inside(False), out)
    cells = materialize(b.groupBy("pair", "xs", "ys").agg(F.sum("cnt").alias("cnt")), "cells")
    between = _between_cells(cells, slices, rows_per_slice)
    found = in_x.unionAll(in_y).select("pair", F.col("dis").cast(BIG).alias("dis")).unionAll(between)
    return found.groupBy("pair").agg(F.sum("dis").cast(BIG).alias("dis"))


def _between_cells(cells: DataFrame, slices: int, rows_per_slice: int) -> DataFrame:
    """pair, dis: weights of two cells with a smaller ``xs`` and a larger ``ys``, bit by bit of ``ys``.

    Two slice numbers differ first in one bit, so per bit and higher bits the ones at a smaller ``xs`` before each zero are a running total.
    """
    bits = F.array(*[F.lit(k) for k in range((slices - 1).bit_length())])
    one = F.expr("shiftright(ys, bit) % 2 = 1")
    tally = cells.select("*", F.explode(bits).alias("bit")).groupBy("pair", "bit", F.expr("shiftright(ys, bit + 1)").alias("prefix"), "xs").agg(
        F.sum(F.when(one, F.col("cnt")).otherwise(0)).alias("ones"), F.sum(F.when(~one, F.col("cnt")).otherwise(0)).alias("zeros"))
    placed = running_total(materialize(tally, "bits"), ["pair", "bit", "prefix"], ["xs"], "ones", "before", rows_per_slice)
    return placed.groupBy("pair").agg(
        F.sum(F.col("before").cast("decimal(19,0)") * F.col("zeros").cast("decimal(18,0)")).cast(BIG).alias("dis"))


def kendall_pairs(df: DataFrame, pairs: list[tuple[str, str]], rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """x, y, n, r (tau-b) and the tie and discordance counts the test needs."""
    counted = counted_pairs(df, pairs)
    sides = side_counts(counted)
    discordant = discordant_pairs(counted, rows_per_slice)
    t = F.col("cnt").cast("double")
    ties = sides.groupBy("pair", "side").agg(
        F.sum(t * (t - 1) / 2).alias("tie"), F.sum(t * (t - 1) * (t - 2)).alias("t0"),
        F.sum(t * (t - 1) * (2 * t + 5)).alias("t1"))
    flat = ties.groupBy("pair").agg(*[
        F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{s}_{c}") for s in "xy" for c in ("tie", "t0", "t1")])
    joint = counted.groupBy("pair").agg(F.sum("cnt").alias("n"), F.sum(t * (t - 1) / 2).alias("both_tie"))
    all_ = joint.join(flat, "pair").join(discordant, "pair", "left")
    n = F.col("n").cast("double")
    pairs_total = n * (n - 1) / 2
    dis = F.coalesce(F.col("dis").cast("double"), F.lit(0.0))
    surplus = pairs_total - F.col("x_tie") - F.col("y_tie") + F.col("both_tie") - 2 * dis
    r = F.try_divide(surplus, F.sqrt(pairs_total - F.col("x_tie")) * F.sqrt(pairs_total - F.col("y_tie")))
    clipped = F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
    out = all_.select("pair", "n", clipped.alias("r"), surplus.alias("surplus"),
                      dis.alias("discordant"), "x_tie", "x_t0", "x_t1", "y_tie", "y_t0", "y_t1")
    return _named(pairs, out, df.sparkSession).drop("pair").withColumn("n", F.coalesce("n", F.lit(0)))
