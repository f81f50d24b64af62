"""Train/test splits, folds and stratified samples by exact hash ranks, reproducible on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factsieve.functions.columns import group_key, ref
from factsieve.plans.sampling import hash_ranks, with_hash
from factsieve.plans.store import materialize

SEED = 42  # fixed value


def _class(by: str | None) -> Column:
    return F.lit("all") if by is None else group_key(ref(by))


def _below(df: DataFrame, key: list[str], by: str | None, seed: int, share: float, wanted: str) -> DataFrame:
    """Adds ``_in``: whether a row's hash rank within its class is among the first ``wanted`` (SQL text of n)."""
    hashed = with_hash(df, key, seed)
    edge = hash_ranks(hashed, _class(by), [("_edge", share, f"{wanted} - 1")])
    edge = edge.select("_class", F.expr(f"if({wanted} > 0, _edge, -1D) as _edge"))
    joined = hashed.withColumn("_class", _class(by)).join(edge, "_class")
    return joined.withColumn("_in", F.expr("_h <= _edge")).drop("_h", "_edge", "_class")


def split(df: DataFrame, key: list[str], test_size: float = 0.2, by: str | None = None, seed: int = SEED) -> DataFrame:
    """Adds ``is_test``: round(n * test_size) rows of each class."""
    if not 0.1 <= test_size <= 0.4:
        raise ValueError(f"test_size is a share of the rows from 0.1 to 0.4, not {test_size}")
    return _below(df, key, by, seed, test_size, f"cast(round(n * {test_size!r}D) as bigint)").withColumnRenamed("_in", "is_test")


def folds(df: DataFrame, key: list[str], k: int = 5, by: str | None = None, seed: int = SEED) -> DataFrame:
    """Adds ``fold``: k equal runs of the hash order within each class."""
    hashed = materialize(with_hash(df, key, seed), "hashed")  # three passes read the hashes
    edges = hash_ranks(hashed, _class(by), [(f"_e{i}", i / k, f"ceil(n * {i} / {k})") for i in range(1, k)])
    joined = hashed.withColumn("_class", _class(by)).join(edges, "_class")
    fold = " + ".join(f"cast(_h >= _e{i} as int)" for i in range(1, k))
    return joined.withColumn("fold", F.expr(fold)).drop("_h", "_class", "n", *[f"_e{i}" for i in range(1, k)])


def stratified_sample(df: DataFrame, key: list[str], max_rows: int, by: str | None = None, seed: int = SEED) -> DataFrame:
    """At most about ``max_rows`` rows, each class in proportion and with at least one row."""
    total = df.count()
    if total <= max_rows:
        return df
    kept = _below(df, key, by, seed, max_rows / total, f"cast(greatest(1, floor(n * {max_rows} / {total})) as bigint)")
    return kept.where("_in").drop("_in")
