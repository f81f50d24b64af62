"""Least squares on all folds from one pass of sums of products.

Every fold's training set is all rows less its own, and so are its sums: each task adds up, for each fold, the products of all pairs of
prepared columns, and a fold is trained on the total less its own sums and scored on its own sums alone.  No row is visited for
a single fold, nothing is predicted, and the driver solves systems of as many unknowns as there are features.

A fold's features are those that ``Features`` fits on its training rows (medians, categories, most frequent label).  They are linear in
columns that all folds share: a number with 0 for a gap, the flag of the gap, the flags of the labels.  So a fold's sums follow
from the shared ones by a small matrix.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factsieve.functions.columns import as_number, quoted, ref
from factsieve.operators.features import MAX_CATEGORIES, is_number_feature, raw_number
from factsieve.plans.frequency import top_of
from factsieve.plans.quantiles import quantiles
from factsieve.plans.store import materialize

#: Directions whose share of the largest spread is below this do not vary in the training rows.
FLAT = 1e-10


def _medians(df: DataFrame, columns: list[str], k: int) -> dict[tuple[int, str], float]:
    """The median of each column over the training rows of each fold."""
    if not columns:
        return {}
    plain = df.select("fold", *[F.expr(f"{raw_number(df, c)} as {quoted(c)}") for c in columns])
    cells = plain.unpivot(["fold"], [ref(c) for c in columns], "column", "value").where("value is not null")
    held = F.explode(F.array(*[F.lit(i) for i in range(k)]))
    trained = cells.withColumn("held", held).where("held <> fold").select(F.concat_ws(":", "held", "column").alias("key"), "value")
    found = quantiles(trained, ["key"], "value", {"m": 0.5}).collect()
    return {(int(r["key"].split(":", 1)[0]), r["key"].split(":", 1)[1]): r["m"] for r in found}


def _labels(df: DataFrame, columns: list[str], k: int) -> dict[tuple[int, str], list[str]]:
    """The most frequent labels of each column in the training rows of each fold, the first ones first; one more than are kept."""
    if not columns:
        return {}
    cells = F.array(*[F.struct(F.lit(c).alias("column"), ref(c).cast("string").alias("key")) for c in columns])
    counts = df.select("fold", F.inline(cells)).where("key is not null").groupBy("column", "key").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("fold") == i).alias(f"n{i}") for i in range(k)])
    trained = F.explode(F.array(*[F.struct(F.lit(i).alias("held"), (F.col("n") - F.col(f"n{i}")).alias("cnt")) for i in range(k)]))
    rows = counts.withColumn("t", trained).select("t.*", "column", "key", F.col("key").alias("shown"), F.lit(None).cast("double").alias("num"))
    out: dict[tuple[int, str], list[str]] = {}
    for r in sorted(top_of(rows.where("cnt > 0"), MAX_CATEGORIES + 1, ("held", "column")).collect(), key=lambda r: r["rank"]):
        out.setdefault((r["held"], r["column"]), []).append(r["key"])
    return out


def _products(width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, width, width))
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            fold = batch.column(0).to_numpy(zero_copy_only=False)
            for i in range(k):
                part = x[fold == i]
                total[i] += part.T @ part
        rows = pa.ListArray.from_arrays(np.arange(k * width + 1, dtype=np.int32) * width, pa.array(total.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k), width), pa.int32()),
                                          pa.array(np.tile(np.arange(width), k), pa.int32()), rows], ["fold", "i", "s"])

    return run


def _solve(sums: np.ndarray) -> np.ndarray:
    """Intercept and coefficients of the last column on the others (the first is 1): the shortest solution in standard units."""
    n, mean = sums[0, 0], sums[0] / sums[0, 0]
    spread = sums - n * np.outer(mean, mean)
    scale = np.sqrt(np.clip(np.diag(spread), 0, None) / n)[1:-1]
    varies = scale > FLAT * np.maximum(1.0, np.abs(mean[1:-1]))
    unit = np.where(varies, scale, 1.0)
    left = np.where(np.outer(varies, varies), spread[1:-1, 1:-1] / np.outer(unit, unit), 0.0)
    b = np.linalg.pinv(left, rcond=FLAT, hermitian=True) @ np.where(varies, spread[1:-1, -1] / unit, 0.0) / unit
    return np.concatenate([[mean[-1] - b @ mean[1:-1]], b])


def fold_scores(folded: DataFrame, target: str, features: list[str], k: int) -> DataFrame:
    """fold, n_train, n_test, n_features, mse, rmse, r2 of least squares with an intercept: one row per fold with rows.

    ``folded`` has the columns, and ``fold`` from 0 to k - 1 (``splits.folds``).  Rows without a target are left out; r2 is null where the
    target of a fold's rows does not vary.  Where features depend on each other the shortest solution is taken.
    """
    y = as_number(folded, target)
    numbers = [c for c in features if is_number_feature(folded, c)]
    texts = [c for c in features if c not in numbers and isinstance(folded.schema[c].dataType, (T.StringType, T.BooleanType))]
    # folds are hashed and joined once; every later pass reads these narrow rows
    df = materialize(folded.where(y.isNotNull() & F.col("fold").isNotNull()).select(
        F.col("fold").cast("int").alias("fold"), y.alias("_target"), *[F.expr(raw_number(folded, c)).alias(c) for c in numbers],
        *[ref(c).cast("string").alias(c) for c in texts]), "fold_rows")
    y = F.col("_target")
    value = {c: f"({raw_number(df, c)})" for c in numbers}
    first = df.agg(F.avg(y), *[F.expr(f"{e}({value[c]})") for c in numbers for e in ("avg", "count")], F.count(F.lit(1))).first()
    if not first[-1]:
        return df.sparkSession.createDataFrame([], "fold int, n_train long, n_test long, n_features int, mse double, rmse double, r2 double")
    level, total = float(first[0]), first[-1]
    centre = {c: float(first[1 + 2 * i] or 0.0) for i, c in enumerate(numbers)}
    gaps = [c for i, c in enumerate(numbers) if first[2 + 2 * i] < total]
    medians, labels = _medians(df, gaps, k), _labels(df, texts, k)

    shared: dict[tuple, Column] = {("one",): F.lit(1.0)}
    for c in numbers:
        shared["x", c] = F.expr(f"coalesce({value[c]} - double('{centre[c]!r}'), 0D)")
        if c in gaps:
            shared["gap", c] = F.expr(f"cast({value[c]} is null as double)")
    for c in texts:
        text = ref(c).cast("string")
        shared["gap", c] = text.isNull().cast("double")
        for v in sorted({v for i in range(k) for v in labels.get((i, c), [])}):
            shared["is", c, v] = F.coalesce(text == F.lit(v), F.lit(False)).cast("double")
    shared["y",] = y - F.lit(level)
    at, width = {name: i for i, name in enumerate(shared)}, len(shared)
    rows = df.select(F.col("fold").cast("int").alias("fold"), F.array(*shared.values()).alias("x")).mapInArrow(
        _products(width, k), "fold int, i int, s array<double>")
    summed = rows.select("fold", "i", F.posexplode("s").alias("j", "v")).groupBy("fold", "i", "j").agg(F.sum("v").alias("v")).toPandas()
    sums = np.zeros((k, width, width))
    sums[summed["fold"], summed["i"], summed["j"]] = summed["v"]

    unit = np.eye(width)

    def features_of(held: int) -> np.ndarray:
        out = [unit[at["one",]]]
        for c in numbers:
            if c not in gaps:
                out.append(unit[at["x", c]])
            elif medians.get((held, c)) is not None:
                out.append(unit[at["x", c]] + (medians[held, c] - centre[c]) * unit[at["gap", c]])
        for c in texts:
            ranked = labels.get((held, c), [])
            if not ranked:
                continue
            pooled = len(ranked) > MAX_CATEGORIES
            kept = ranked[:MAX_CATEGORIES - 1] if pooled else ranked
            flags = [unit[at["is", c, v]] + (unit[at["gap", c]] if v == ranked[0] else 0.0) for v in sorted(kept)]
            out += flags + ([unit[at["one",]] - sum(flags)] if pooled else [])
        return np.array(out + [unit[at["y",]]])

    result = []
    for held in range(k):
        own, rest = sums[held], sums.sum(0) - sums[held]
        n, left = float(own[0, 0]), float(rest[0, 0])
        if not n or not left:
            continue
        shape = features_of(held)
        error = np.concatenate([-_solve(shape @ rest @ shape.T), [1.0]])
        mine = shape @ own @ shape.T
        wrong, spread = max(float(error @ mine @ error), 0.0), float(mine[-1, -1] - mine[0, -1] ** 2 / n)
        result.append((held, int(round(left)), int(round(n)), len(shape) - 2, wrong / n, math.sqrt(wrong / n),
                       1 - wrong / spread if spread > 0 else None))
    return df.sparkSession.createDataFrame(result, "fold int, n_train long, n_test long, n_features int, mse double, rmse double, r2 double")
