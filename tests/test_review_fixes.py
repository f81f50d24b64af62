"""One meaning of missing, complete results at every size, one-pass correlations, date shapes, charts by declared options."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from factsieve.functions.columns import parse_time
from factsieve.operators import charts, clean, metrics, roles, stats
from factsieve.plans import gram, rows, sampling
from factsieve.sources import files

NAN, INF = float("nan"), float("inf")


def test_nan_and_infinity_are_missing_in_cleaning(spark):
    df = spark.createDataFrame([(1, 1.0), (2, NAN), (3, 1.0), (4, INF), (5, None), (6, 4.0)], "id long, v double")

    def after(**op):
        return [r.v for r in clean.apply_operation(df, op).orderBy("id").collect()]

    assert after(op="drop_rows_missing", columns=["v"]) == [1.0, 1.0, 4.0]
    assert after(op="fill_missing", column="v", strategy="mode") == [1.0, 1.0, 1.0, 1.0, 1.0, 4.0]
    assert after(op="fill_missing", column="v", strategy="zero") == [1.0, 0.0, 1.0, 0.0, 0.0, 4.0]
    assert after(op="fill_missing", column="v", strategy="ffill", order_by=["id"]) == [1.0, 1.0, 1.0, 1.0, 1.0, 4.0]
    with pytest.raises(ValueError):
        clean.apply_operation(df.select(F.col("id").cast("string").alias("t")), {"op": "fill_missing", "column": "t", "strategy": "mean"})


def test_confusion_matrix_keeps_missing_labels(spark):
    df = spark.createDataFrame([("a", "a"), ("a", None), (None, "b"), ("b", "b")], "y string, p string")
    got = {(r.label, r.prediction): r["count"] for r in metrics.confusion_matrix(df, "y", "p").collect()}
    assert sum(got.values()) == 4 and got["a", "nan"] == 1 and got["nan", "b"] == 1 and got["nan", "nan"] == 0
    with pytest.raises(ValueError):
        metrics.confusion_matrix(df, "y", "p", max_labels=2)


def test_duplicates_with_maps_and_nested_zeros(spark):
    df = spark.createDataFrame([({"a": 1, "b": 2}, [0.0]), ({"b": 2, "a": 1}, [-0.0]), ({"a": 1}, [0.0])], "m map<string,int>, x array<double>")
    row = rows.duplicate_summary(df).first()
    assert (row.n_rows, row.duplicate_rows) == (3, 1)


def test_anova_takes_all_groups(spark):
    df = spark.createDataFrame([(f"g{i:02d}", float(i + j)) for i in range(15) for j in range(3)], "g string, v double")
    got = stats.anova(df, "v", "g").first()
    assert got.groups == 15 and not got.truncated
    assert stats.anova(df, "v", "g", max_groups=12).first().truncated


def test_correlations_of_many_columns_in_one_pass(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 60)) * 10.0 ** rng.integers(-3, 4, 60) + 1000
    x[:, 7] = 3.14159
    x[rng.random(x.shape) < 0.1] = np.nan
    names = [f"c{i}" for i in range(60)]
    df = spark.createDataFrame([[None if math.isnan(v) else float(v) for v in r] for r in x], ", ".join(f"{c} double" for c in names))
    table = gram.pair_correlations(df.repartition(3), names)
    assert len(table._jdf.queryExecution().optimizedPlan().toString()) < 60_000
    got = {(r.i, r.j): (r.n, r.r) for r in table.collect()}
    for i, j in [(0, 1), (3, 50), (20, 20), (7, 8), (59, 0)]:
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        n, r = got[i, j]
        assert n == both.sum()
        if 7 in (i, j):
            assert r is None
        else:
            assert r == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-9)


def test_roles_look_at_whole_values(spark):
    padded = [(" " * 60 + f"2024-01-{d:02d}" + " " * 90,) for d in range(1, 11)]
    assert roles.role_map(spark.createDataFrame(padded, "t string")) == {"t": "datetime"}


def test_date_shapes(spark):
    want = "2024-05-13 17:04:00"
    texts = ["2024-05-13T17:04:00", "2024/5/13 17:04", "13/5/2024 17:04", "13/05/2024 17:04:00", "5/13/2024 5:04 PM", "05/13/2024 05:04:00 PM"]
    days = ["20240513", "13 May 2024", "13 September 2024", "May 13, 2024", "13.5.2024", "13-May-2024"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts + days)], "i long, t string")
    got = [str(r.d) for r in df.select("i", parse_time("t").alias("d")).orderBy("i").collect()]
    assert got[:len(texts)] == [want] * len(texts)
    assert [g[8:10] for g in got[len(texts):]] == ["13"] * len(days)


def test_files_of_one_folder_are_read_each_in_its_way(spark, tmp_path):
    folder = tmp_path / "mixed"
    folder.mkdir()
    (folder / "a.csv").write_bytes("id,name\n1,café\n2,b\n".encode())
    (folder / "b.csv").write_bytes("name;id\ncafé;3\n\"x;y\";4\n".encode("latin-1"))
    got = {(r.id, r.name) for r in files.read_csv(spark, str(folder)).collect()}
    assert got == {(1, "café"), (2, "b"), (3, "café"), (4, "x;y")}
    with pytest.raises(ValueError):
        files.read_csv(spark, str(folder / "a.xlsx"))


def test_samples_and_charts(spark):
    df = spark.range(20_000).select("id", (F.col("id") % 5).alias("g"), F.col("id").cast("double").alias("v"))
    assert {r.id for r in sampling.bottom_k(df, ["id"], 50, 7).collect()} == {
        r.id for r in df.orderBy(F.md5(F.concat(sampling.row_id(["id"]), F.lit("|7")))).limit(50).collect()}
    assert charts.build_chart(df, {"type": "histogram", "y": "v", "bins": "10"}).count() == 10
    assert charts.build_chart(df, {"x": "g", "y": "v", "agg": "Sum", "group": None}).count() == 5
    with pytest.raises(ValueError):
        charts.build_chart(df, {"type": "radar"})
