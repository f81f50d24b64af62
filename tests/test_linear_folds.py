import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factsieve.operators import ml, splits
from factsieve.operators.features import Features
from factsieve.operators.linear import fold_scores


def table(spark, n=400, labels=3):
    rnd = random.Random(5)
    data = []
    for i in range(n):
        x, z = rnd.gauss(1e4, 3), rnd.random()
        c = f"c{min(int(rnd.expovariate(0.5)), labels - 1)}"
        data.append((i, x, None if rnd.random() < 0.2 else z, None if rnd.random() < 0.1 else c, rnd.random() < 0.3,
                     2 * x - 5 * z + len(c) * 3 + int(c[1:]) + rnd.gauss(0, 1)))
    return spark.createDataFrame(data, "id bigint, x double, z double, c string, b boolean, y double")


def brute(folded, features, k):
    """Each fold by itself: features fitted on its training rows, shortest solution in standard units, errors of its own rows."""
    out = {}
    for i in range(k):
        train, test = folded.where(F.col("fold") != i), folded.where(F.col("fold") == i)
        fitted = Features.fit(train, features)
        a, b = (np.array([list(r) for r in fitted.table(d, ["y"]).collect()], float) for d in (train, test))
        mean = a.mean(0)
        scale = np.where(a[:, 1:].std(0) > 0, a[:, 1:].std(0), 1.0)
        w = np.linalg.lstsq((a[:, 1:] - mean[1:]) / scale, a[:, 0] - mean[0], rcond=1e-8)[0] / scale
        e = b[:, 0] - mean[0] - (b[:, 1:] - mean[1:]) @ w
        out[i] = (len(a), len(b), (e ** 2).mean(), 1 - (e ** 2).mean() / b[:, 0].var())
    return out


@pytest.mark.parametrize("labels", [3, 60])
def test_folds_equal_training_each_by_itself(spark, labels):
    df = splits.folds(table(spark, 400, labels), ["id"], 2).cache()
    got = {r["fold"]: r for r in fold_scores(df, "y", ["x", "z", "c", "b"], 2).collect()}
    want = brute(df, ["x", "z", "c", "b"], 2)
    assert set(got) == set(want)
    for i, (n_train, n_test, mse, r2) in want.items():
        assert (got[i]["n_train"], got[i]["n_test"]) == (n_train, n_test)
        assert got[i]["r2"] == pytest.approx(r2, abs=1e-6) and got[i]["mse"] == pytest.approx(mse, rel=1e-6)


def test_gaps_constants_and_empty_tables(spark):
    df = table(spark, 60).withColumn("fold", (F.col("id") % 3).cast("int")).withColumn("same", F.lit(7.0)).withColumn(
        "none", F.lit(None).cast("double")).withColumn("no_label", F.lit(None).cast("string"))
    got = fold_scores(df, "y", ["x", "same", "none", "no_label"], 3).orderBy("fold").collect()
    plain = fold_scores(df, "y", ["x"], 3).orderBy("fold").collect()
    assert [r["r2"] for r in got] == pytest.approx([r["r2"] for r in plain])
    assert all(r["r2"] is None for r in fold_scores(df.withColumn("y", F.lit(1.0)), "y", ["x"], 3).collect())
    assert fold_scores(df.where("id < 0"), "y", ["x", "z", "c"], 3).count() == 0
    one = fold_scores(df.where("fold = 0"), "y", ["x"], 3)  # nothing is left to train on
    assert one.count() == 0


def test_training_uses_the_folds(spark):
    df = table(spark).drop("b")
    run = ml.train_models(df, "y", "regression", ["id"], models=["linear"], cv=2)
    got = run.results.first()
    folded = splits.folds(df, ["id"], 2)
    marks = [v[3] for v in brute(folded, ["x", "z", "c"], 2).values()]
    assert got["error"] is None and got["cv_mean"] == pytest.approx(np.mean(marks), abs=1e-6)
    assert got["cv_std"] == pytest.approx(np.std(marks), abs=1e-6)


def test_folds_are_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def fold_of(i):
        seen.add(1)
        return i % 2

    df = table(spark, 200).withColumn("fold", F.udf(fold_of, "int").asNondeterministic()("id"))
    assert fold_scores(df, "y", ["x", "z", "c", "b"], 2).count() == 2 and seen.value == 200
