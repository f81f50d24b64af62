"""Long frequency table (column, value, count): the source of distinct counts, modes and top values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factsieve.functions.columns import INTEGER_TYPES, NESTED_TYPES, PLAIN_NUMBER, REAL_TYPES, digest, finite, ref

SHOWN = 120  # fixed value: displayed values are cut to this length


def _looks(text: Column) -> list[Column]:
    """What the role of a text needs of its whole value: the trimmed text where it may be a date, and whether it is a plain number."""
    bare = F.trim(text)
    return [F.when(F.length(bare) <= SHOWN, bare).alias("bare"), bare.rlike(PLAIN_NUMBER).alias("plain")]  # no date is longer


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, key, shown, chars, num, cnt, bare, plain: one row per distinct non-null value of each column.

    Integers and reals are grouped by their own type (no text cast per row, ties in
    numeric order).  Long texts are grouped by their digest, so the shuffle never
    carries whole documents.  Nested columns are left out.
    """
    columns = df.columns if columns is None else columns
    families: dict[str, list[str]] = {"long": [], "double": [], "string": []}
    for c in columns:
        t = df.schema[c].dataType
        if isinstance(t, NESTED_TYPES):
            continue
        families["long" if isinstance(t, INTEGER_TYPES) else
                 "double" if isinstance(t, REAL_TYPES) else "string"].append(c)
    parts = []
    for kind, names in families.items():
        if not names:
            continue
        if kind == "string":
            cells = [F.struct(F.lit(c).alias("column"), digest(ref(c).cast("string")).alias("key"),
                              F.substring(ref(c).cast("string"), 1, SHOWN).alias("shown"),
                              F.length(ref(c).cast("string")).alias("chars"), *_looks(ref(c).cast("string"))) for c in names]
            counted = (df.select(F.inline(F.array(*cells))).where(F.col("key").isNotNull())
                       .groupBy("column", "key", "shown", "chars", "bare", "plain").agg(F.count(F.lit(1)).alias("cnt")))
            parts.append(counted.select("column", "key", "shown", "chars", F.lit(None).cast("double").alias("num"),
                                        "cnt", "bare", "plain"))
        else:
            cells = [F.struct(F.lit(c).alias("column"),
                              (ref(c).cast("long") if kind == "long" else finite(c)).alias("v")) for c in names]
            counted = (df.select(F.inline(F.array(*cells))).where(F.col("v").isNotNull())
                       .groupBy("column", "v").agg(F.count(F.lit(1)).alias("cnt")))
            parts.append(counted.select("column", F.col("v").cast("string").alias("key"),
                                        F.col("v").cast("string").alias("shown"),
                                        F.lit(None).cast("int").alias("chars"),
                                        F.col("v").cast("double").alias("num"), "cnt",
                                        F.lit(None).cast("string").alias("bare"), F.lit(None).cast("boolean").alias("plain")))
    if not parts:
        return df.sparkSession.createDataFrame([], "column string, key string, shown string, chars int, num double, cnt bigint, bare string, plain boolean")
    return reduce(DataFrame.unionByName, parts)


def top_of(counts: DataFrame, k: int, keys: tuple[str, ...] = ("column",)) -> DataFrame:
    """The k most frequent values per column: count descending, then value ascending; adds ``rank``.

    The row_number filter becomes a per-partition group limit, so no column's
    distinct values travel to one task.
    """
    w = W.partitionBy(*keys).orderBy(F.desc("cnt"), F.asc_nulls_last("num"), "shown", "key")
    return counts.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def distinct_counts(counts: DataFrame) -> DataFrame:
    """column, n_distinct, top_count from a frequency table."""
    return counts.groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"), F.max("cnt").alias("top_count"))
