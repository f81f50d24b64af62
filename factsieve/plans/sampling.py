"""Reproducible samples: rows ordered by a hash of their key, independent of partitioning."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factsieve.functions.columns import hash_number, ref
from factsieve.plans.quantiles import order_statistics
from factsieve.plans.store import materialize


def row_id(key: Sequence[str]) -> Column:
    return F.concat_ws("|", *[ref(k).cast("string") for k in key])


def bottom_k(df: DataFrame, key: Sequence[str], k: int, seed: int) -> DataFrame:
    """The k rows with the smallest hash of their key.

    Only rows below a threshold fitted from the row count are ordered, about k over all tasks, so that the last step does
    not gather k rows of every task.  Should fewer than k lie below it, all rows are ordered.
    """
    digest = F.md5(F.concat(row_id(key), F.lit(f"|{seed}")))
    total = df.count()
    share = (k + 8 * math.sqrt(k) + 20) / max(total, 1)
    if share < 1:
        low = materialize(df.where(F.substring(digest, 1, 13) < f"{int(share * 16 ** 13):013x}"), "sample")
        if low.count() >= k:
            df = low
    return df.orderBy(digest, *[ref(c) for c in key]).limit(k)


def with_hash(df: DataFrame, key: Sequence[str], seed: int, name: str = "_h") -> DataFrame:
    return df.withColumn(name, hash_number(row_id(key), seed))


def hash_ranks(df: DataFrame, by: Column, ranks: list) -> DataFrame:
    """Per class the hash numbers at the given ranks (``_class``, n and one column per rank).

    A class needs no sort and no task of its own: each threshold is an exact order
    statistic of the hash numbers, so a class with a third of all rows is no problem.
    """
    return order_statistics(df.select(by.alias("_class"), "_h"), ["_class"], "_h", ranks)
