"""Neighbours and candidate splits come from all training rows, however many there are."""

import datetime

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from factsieve.operators import forest, ml, neighbors
from factsieve.streaming import streams

ONE = {"maxDepth": 4, "maxBins": 32, "seed": 42, "minInstancesPerNode": 1, "minInfoGain": 0.0}


def points(rows, width=3, seed=5, values=9):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, values, (rows, width)) * 0.37 + (rng.random((rows, width)) < 0.5) * rng.random((rows, width))
    return x, rng.integers(0, 4, rows)


def test_every_training_row_is_compared(spark):
    df = spark.range(30_000).select("id", F.col("id").cast("double").alias("x"), F.when(F.xxhash64("id") % 2 == 0, "a").otherwise("b").alias("label"))
    run = ml.train_models(df, "label", "classification", ["id"], models=["knn"], cv=0, params={"knn": {"k": 1}})
    assert run.results.first()["n_train"] == run.best_model.model.rows == 24_000
    train = df.join(ml.split(df, ["id"], 0.2, "label").where("not is_test").select("id"), "id").orderBy("id").limit(900)
    got = run.best_model.predict(train).where("label = prediction and probabilities[label] = 1")
    assert got.count() == 900  # its own nearest row, also beyond 20,000
    few = neighbors.knn_predict(df, df.where("id < 900"), ["x"], "label", ["id"], 1, max_train_rows=300)
    assert few.join(df.select(F.col("id").cast("string").alias("id"), "label"), "id").where("label = prediction").count() < 700  # a sample on request


@pytest.mark.parametrize("k", [1, 7, 500])
def test_blocks_of_all_tasks_give_the_nearest_of_all(spark, monkeypatch, k):
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 16)
    (known, codes), (asked, _) = points(300), points(90, seed=6)
    rows = spark.createDataFrame([(float(c), Vectors.dense(x)) for c, x in zip(codes, known)], ["label", "features"]).repartition(7)
    model = neighbors.Neighbors.fit(rows, 4, k)
    day = datetime.datetime(2024, 3, 31, 2, 30)
    kept = [(i, None if i % 7 == 0 else f"t{i}", day + datetime.timedelta(hours=i), [i] * (i % 3), {"a": i}, Vectors.dense(x)) for i, x in enumerate(asked)]
    df = spark.createDataFrame(kept, ["row.id", "t", "d", "a", "m", "features"])
    assert model.known.count() > 15
    got = {r[0]: r for r in model.transform(df.repartition(3)).select("*", vector_to_array("probability").alias("p")).collect()}
    near = np.array([np.lexsort((codes, ((known - x) ** 2).sum(1).round(12)))[:k] for x in asked])
    for i, row in enumerate(kept):
        shares = np.bincount(codes[near[i]], minlength=4) / len(near[i])
        assert tuple(got[i][:5]) == row[:5] and got[i]["p"] == pytest.approx(list(shares)) and got[i]["prediction"] == shares.argmax()
    assert len(got) == 90 and model.transform(df.limit(0)).count() == 0
    assert model.transform(df.select("features")).count() == 90
    with pytest.raises(ValueError):
        neighbors.Neighbors.fit(rows.limit(0), 4)


def test_neighbours_are_found_on_streams_and_after_loading(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 16)
    x, codes = points(200)
    df = spark.createDataFrame([(i, *map(float, v), "pqrs"[c]) for i, (v, c) in enumerate(zip(x, codes))], "id long, a double, b double, c double, label string")
    model = ml.train_models(df, "label", "classification", ["id"], models=["knn"], cv=0).best_model
    want = {r["id"]: (r["prediction"], r["probabilities"]) for r in model.predict(df, ["id"]).collect()}
    loaded = ml.TrainedModel.load(spark, model.save(spark, str(tmp_path / "m")))
    assert want == {r["id"]: (r["prediction"], r["probabilities"]) for r in loaded.predict(df, ["id"]).collect()}
    df.coalesce(2).write.parquet(str(tmp_path / "in"))
    live = streams.read_files(spark, str(tmp_path / "in"), "*.parquet", df.schema)
    assert want == {r["id"]: (r["prediction"], r["probabilities"]) for r in streams.run_available(loaded.predict(live, ["id"])).collect()}


def shares(values, bins):
    """Midpoints between all values, or those nearest to equal shares of the rows."""
    found, counts = np.unique(values, return_counts=True)
    if len(found) <= bins:
        return (found[:-1] + found[1:]) / 2
    stride = len(values) / bins
    out, target, ends = [], stride, np.cumsum(counts)
    for i in range(1, len(found)):
        if abs(ends[i - 1] - target) < abs(ends[i] - target):
            out.append((found[i - 1] + found[i]) / 2)
            target += stride
    return np.array(out)


@pytest.mark.parametrize("values", [1 << 18, 300])
def test_candidate_splits_are_those_of_all_rows(spark, monkeypatch, values):
    monkeypatch.setattr(forest, "VALUES", values)  # few: the ranges are divided in rounds
    rng = np.random.default_rng(3)
    rows = 14_000
    x = np.stack([rng.normal(size=rows), np.where(rng.random(rows) < 0.4, 0.0, rng.exponential(1, rows)), rng.integers(0, 3, rows),
                  rng.integers(0, 90, rows), 10.0 ** rng.uniform(-200, 200, rows), np.full(rows, 2.5)], 1)
    x[:40] = x[40]  # rows that are the same count each
    y = (x[:, 0] > 0.123).astype(float)
    df = spark.createDataFrame([(float(c), Vectors.dense(v)) for c, v in zip(y, x)], ["label", "features"])
    made = forest.Forest.fit(df.repartition(5), 2, ONE)
    for f in range(x.shape[1]):
        assert list(made.cuts[f]) == list(shares(x[:, f], 32))
