"""Whole-row fingerprints: duplicate counting without shuffling the rows themselves."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factsieve.functions.columns import ref
from factsieve.plans.store import materialize


def _comparable(c: Column, kind: T.DataType) -> Column:
    """A value whose hash is equal for equal values: maps as sorted entries, -0.0 as 0.0, at any depth."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(c == 0, F.lit(0.0).cast(kind)).otherwise(c)
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(c), lambda e: F.struct(
            _comparable(e["key"], kind.keyType).alias("key"), _comparable(e["value"], kind.valueType).alias("value")))
        return F.array_sort(entries)  # values that hold maps are arrays by now, so entries can be ordered
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _comparable(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_comparable(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return c


def _holds_map(kind: T.DataType) -> bool:
    return isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and _holds_map(kind.elementType) or isinstance(
        kind, T.StructType) and any(_holds_map(f.dataType) for f in kind.fields)


def row_key(df: DataFrame) -> Column:
    """The whole row in a form that can be grouped and compared, equal for equal rows only."""
    return F.struct(*[_comparable(ref(f.name), f.dataType).alias(f"c{i}") for i, f in enumerate(df.schema.fields)])


def distinct_rows(df: DataFrame) -> DataFrame:
    """One of each of the equal rows; columns may hold maps at any depth."""
    if not any(_holds_map(f.dataType) for f in df.schema.fields):
        return df.dropDuplicates()
    names = [f"c{i}" for i in range(len(df.columns))]
    inner = df.toDF(*names)
    return inner.withColumn("_row", row_key(inner)).dropDuplicates(["_row"]).select(*names).toDF(*df.columns)


def fingerprint(df: DataFrame) -> list[Column]:
    """Two independent 64-bit hashes over all columns and over which of them are null."""
    cells = []
    for f in df.schema.fields:
        cells.append(_comparable(ref(f.name), f.dataType))
    nulls = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in cells])
    return [F.xxhash64(nulls, *cells).alias("_h1"), F.xxhash64(F.lit("second"), *reversed(cells), nulls).alias("_h2")]


def duplicate_summary(df: DataFrame, hashed: Callable[[DataFrame], list[Column]] = fingerprint) -> DataFrame:
    """n_rows and duplicate_rows (rows beyond the first of equal ones), one row.

    Sixteen bytes per distinct row cross the network; a row repeated many times collapses before the shuffle.  Rows whose
    fingerprint is found again are then compared whole, so that different rows of one fingerprint do not count as equal.
    """
    hashes = hashed(df)
    copies = materialize(df.select(*hashes).groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("cnt")), "fingerprints")
    again = copies.where("cnt > 1").select("_h1", "_h2")
    met = df.select(*hashes, row_key(df).alias("_row")).join(again, ["_h1", "_h2"], "left_semi")
    different = met.groupBy("_h1", "_h2", "_row").agg(F.count(F.lit(1)).alias("cnt"))
    beyond = different.agg(F.coalesce(F.sum(F.col("cnt") - 1), F.lit(0)).cast("long").alias("duplicate_rows"))
    return side_by_side(copies.agg(F.coalesce(F.sum("cnt"), F.lit(0)).cast("long").alias("n_rows")), beyond)


def side_by_side(*single_rows: DataFrame) -> DataFrame:
    """The columns of several one-row tables in one row."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), single_rows)
    return stacked.agg(*[F.max(ref(c)).alias(c) for c in stacked.columns])
