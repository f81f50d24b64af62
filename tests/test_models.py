import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factsieve.operators import ml, splits
from factsieve.operators.features import OTHER, Features
from factsieve.operators.neighbors import knn_predict
from factsieve.plans import quantiles
from factsieve.streaming import streams


def rows(spark, n=240):
    rnd = random.Random(2)
    data = [(i, i / 10.0 + rnd.random(), None if i % 9 == 0 else rnd.random(), f"c{i % 3}", "yes" if i % 240 > 120 else "no") for i in range(n)]
    return spark.createDataFrame(data, "id bigint, x double, z double, c string, target string")


def test_features_pool_rare_categories_and_fill(spark):
    data = [(i, f"v{i % 40:02d}" if i % 3 else "v00", None if i % 5 == 0 else float(i)) for i in range(400)]
    df = spark.createDataFrame(data, "id int, c string, x double")
    f = Features.fit(df, ["c", "x"])
    assert len(f.names) == 1 + 29 + 1 and f.names[-1] == f"c_{OTHER}"
    t = f.table(df, ["id"])
    s = t.agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).first()
    assert s["m"] == pytest.approx(0, abs=1e-9) and s["s"] == pytest.approx(1)
    unseen = f.table(spark.createDataFrame([(1, None, None)], "id int, c string, x double"), ["id"]).first()
    assert unseen["c_v00"] == 1.0
    assert Features.from_json(f.to_json()).names == f.names


@pytest.mark.parametrize("parts", [1, 7])
def test_split_and_folds_are_exact_per_class(spark, monkeypatch, parts):
    monkeypatch.setattr(quantiles, "WHOLE_GROUP", 20)
    df = rows(spark).repartition(parts)
    s = splits.split(df, ["id"], 0.2, "c")
    assert {r["c"]: r["k"] for r in s.where("is_test").groupBy("c").agg(F.count("*").alias("k")).collect()} == {"c0": 16, "c1": 16, "c2": 16}
    picked = sorted(r["id"] for r in s.where("is_test").select("id").collect())
    assert picked[:3] == sorted(r["id"] for r in splits.split(rows(spark), ["id"], 0.2, "c").where("is_test").collect())[:3]
    f = splits.folds(df, ["id"], 5, "c").groupBy("c", "fold").count().collect()
    assert len(f) == 15 and {r["count"] for r in f} == {16}
    assert splits.stratified_sample(df, ["id"], 30, "c").groupBy("c").count().select("count").distinct().collect()[0][0] == 10


def test_knn_matches_brute_force(spark):
    rnd = np.random.default_rng(4)
    pts, labels = rnd.normal(size=(90, 3)), rnd.integers(0, 3, 90)
    data = [(i, *map(float, pts[i]), f"l{labels[i]}") for i in range(90)]
    df = spark.createDataFrame(data, "id bigint, a double, b double, c double, label string")
    train, test = df.where("id < 70"), df.where("id >= 70")
    got = {int(r["id"]): r["prediction"] for r in knn_predict(train, test, ["a", "b", "c"], "label", ["id"]).collect()}
    scaled = (pts - pts[:70].mean(0)) / pts[:70].std(0)
    for i in range(70, 90):
        near = np.argsort(((scaled[:70] - scaled[i]) ** 2).sum(1), kind="stable")[:5]
        votes = [f"l{labels[j]}" for j in near]
        assert got[i] == min(set(votes), key=lambda v: (-votes.count(v), v))


def test_targets_are_checked(spark):
    df = rows(spark)
    for target, task in (("nope", "regression"), ("x", "what"), ("target", "regression"), ("id", "classification")):
        with pytest.raises(ValueError):
            ml.check_target(df, target, task)
    with pytest.raises(ValueError):
        ml.check_target(df.limit(10), "x", "regression")
    with pytest.raises(ValueError):
        splits.split(df, ["id"], 0.9)
    with pytest.raises(ValueError):
        ml.train_models(df, "target", "classification", ["id"], models=["what"])


def test_training_prediction_and_saved_models(spark, tmp_path):
    df = rows(spark)
    run = ml.train_models(df, "target", "classification", ["id"], models=["logistic", "decision_tree", "knn"], cv=2,
                          params={"logistic": {"maxIter": 20}, "decision_tree": {"maxDepth": 4}})
    table = {r["model"]: r for r in run.results.collect()}
    assert set(table) == {"logistic", "decision_tree", "knn"} and all(r["error"] is None for r in table.values())
    assert table["decision_tree"]["accuracy"] > 0.9 and 0 <= table["logistic"]["roc_auc"] <= 1
    assert table["decision_tree"]["cv_mean"] > 0.9 and sum(r["best"] for r in table.values()) == 1
    model = run.fitted["decision_tree"]
    assert model.importance()[0][0] == "x"
    loaded = ml.TrainedModel.load(spark, model.save(spark, str(tmp_path / "m")))
    a = {r["id"]: r["prediction"] for r in model.predict(df, ["id"]).collect()}
    assert a == {r["id"]: r["prediction"] for r in loaded.predict(df, ["id"]).collect()}
    near = run.fitted["knn"]
    again = ml.TrainedModel.load(spark, near.save(spark, str(tmp_path / "near")))
    texts = df.select("id", *[F.col(c).cast("string").alias(c) for c in df.columns if c != "id"])  # numbers as text are read as numbers
    first, second = ({r["id"]: (r["prediction"], sum(r["probabilities"].values())) for r in m.predict(d, ["id"]).collect()}
                     for m, d in ((near, df), (again, texts)))
    assert first == second and all(abs(p - 1) < 1e-3 for _, p in first.values())
    # the same model on a stream
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    live = streams.read_files(spark, str(tmp_path / "in"), "*.parquet", df.schema)
    assert a == {r["id"]: r["prediction"] for r in streams.run_available(loaded.predict(live, ["id"]).select("id", "prediction")).collect()}


def test_regression_and_failures_side_by_side(spark):
    df = rows(spark).drop("target")
    run = ml.train_models(df, "x", "regression", ["id"], models=["linear", "random_forest"], cv=0,
                          params={"random_forest": {"numTrees": -1}})
    got = {r["model"]: r for r in run.results.collect()}
    assert got["random_forest"]["error"] and got["linear"]["error"] is None and run.best == "linear"
    assert ml.importance_table(spark, run.best_model).count() > 0
