import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from factsieve.functions import special
from factsieve.functions.columns import parse_time, strip, title_case
from factsieve.operators import browse, charts, eda, insights, metrics, profile, quality, report, roles, stats, trends
from factsieve.operators.clean import Recipe, apply_operation
from factsieve.plans.facts import Facts
from factsieve.sources import files, tables


def sales(spark, n=240):
    """Sales-like rows with the usual defects."""
    rows = []
    for i in range(n):
        region = " north " if i % 20 == 0 else ["North", "South", "East", "West"][i % 4]
        revenue = None if i % 8 == 3 else 4000.0 if i in (5, 99) else 100.0 + i + (i % 7)
        rows.append((f"2023-{i % 12 + 1:02d}-{i % 28 + 1:02d}", region, ["Online", "Retail"][i % 2], revenue, i % 50, i % 10 == 0, "EUR", None))
    return spark.createDataFrame(rows, "date string, region string, channel string, revenue double, units int, churned boolean, "
                                       "currency string, note string")


def test_roles(spark):
    assert roles.role_map(sales(spark)) == {
        "date": "datetime", "region": "categorical", "channel": "categorical", "revenue": "numeric", "units": "numeric",
        "churned": "boolean", "currency": "categorical", "note": "text"}
    ids = spark.createDataFrame([(str(i), f"some rather long free text number {i}", [1]) for i in range(300)], "id string, t string, a array<int>")
    assert roles.role_map(ids) == {"id": "text", "t": "text", "a": "nested"}


def test_odd_column_names_pass_through_all_reports(spark):
    df = sales(spark).toDF("the date", "re.gion", "ch`annel", "rev enue", "units", "churned", "cur-rency", "note")
    full = {r["column"]: r for r in profile.full_profile(df).collect()}
    assert full["rev enue"]["missing"] == 30 and full["re.gion"]["n_distinct"] == 5
    q = quality.Quality(df)
    assert {r["column"] for r in q.columns().collect()} == set(df.columns)
    assert insights.insights(df).count() > 0
    assert report.report_facts(df).where("section = 'describe'").count() == 8
    assert apply_operation(df, {"op": "fill_missing", "column": "rev enue", "strategy": "mean"}).where("`rev enue` is null").count() == 0


@pytest.mark.parametrize("parts", [1, 17])
def test_quality_rules(spark, parts):
    q = quality.Quality(sales(spark).unionByName(sales(spark).limit(3)).repartition(parts))
    flags = {r["column"]: set(filter(None, r["flags"].split(","))) for r in q.columns().collect()}
    assert flags["note"] == {"empty_column"}
    assert {"whitespace", "case_inconsistent"} <= flags["region"]
    assert flags["currency"] == {"constant"}
    assert "missing" in flags["revenue"]
    kinds = {r["kind"]: r["severity"] for r in q.issues().collect()}
    assert kinds["duplicate_rows"] == "medium" and kinds["empty"] == "high" and kinds["missing"] == "medium"
    score = q.score().first()["score"]
    assert 5 <= score <= 100


def test_empty_and_tiny_frames(spark):
    empty = spark.createDataFrame([], "a double, b string")
    with pytest.raises(ValueError):
        tables.check_table(empty)
    one = spark.createDataFrame([(1.0, "x")], "a double, b string")
    p = {r["column"]: r for r in profile.full_profile(one).collect()}
    assert p["a"]["median"] == 1.0 and p["a"]["std"] is None and p["a"]["skew"] is None
    assert eda.univariate_numeric(one, "a").first()["std"] == 0.0
    constant = spark.createDataFrame([(2.0, float(i)) for i in range(6)], "a double, b double")
    assert eda.correlation_pairs(constant).first()["r"] is None
    assert {r["outliers"] for r in quality.iqr_outliers(constant, ["a", "b"]).collect()} == {0}


def test_nan_and_infinity_are_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "x double")
    assert profile.missing_by_column(df).first()["missing"] == 3
    assert tables.normalize(df).where("x is null").count() == 3


def test_browse(spark):
    df = sales(spark).withColumn("id", F.monotonically_increasing_id())
    assert browse.search_rows(df, "NORTH").count() == browse.search_rows(df, "n.rth", regex=True).count() > 0
    with pytest.raises(ValueError):
        browse.search_rows(df, "(", regex=True)
    last = browse.sort_rows(df, "revenue", ["id"], descending=True).collect()[-1]
    assert last["revenue"] is None
    assert browse.page_rows(df, 999, ["id"], page_size=100).count() == 40
    assert browse.page_counts(df, "no such text").first().asDict() == {"total_rows": 240, "filtered_rows": 0, "total_pages": 1}


def test_expressions(spark):
    df = spark.createDataFrame([("\t o'neil foo-bar x2y \n",)], "s string")
    r = df.select(title_case(strip(F.col("s"))).alias("t")).first()
    assert r["t"] == "O'Neil Foo-Bar X2Y"
    times = spark.createDataFrame([("2024-01-05",), ("1/5/2024",), ("13/02/2024",), ("Jan 5, 2024",), ("2024-01-05T10:11:12",), ("12.5",), ("x",)], "s string")
    got = [r[0] for r in times.select(parse_time("s")).collect()]
    assert got == [datetime(2024, 1, 5), datetime(2024, 1, 5), datetime(2024, 2, 13), datetime(2024, 1, 5), datetime(2024, 1, 5, 10, 11, 12), None, None]


@pytest.mark.parametrize("op", [
    {"op": "drop_column", "columns": ["zzz"]}, {"op": "fill_missing", "column": "zzz"},
    {"op": "fill_missing", "column": "region", "strategy": "mean"}, {"op": "fill_missing", "column": "revenue", "strategy": "what"},
    {"op": "fill_missing", "column": "revenue", "strategy": "ffill"}, {"op": "rename_column", "old": "region", "new": " "},
    {"op": "rename_column", "old": "region", "new": "units"}, {"op": "convert_dtype", "column": "units", "dtype": "what"},
    {"op": "standardize_case", "column": "region", "case": "what"}, {"op": "scale_numeric", "column": "units", "method": "log"},
    {"op": "scale_numeric", "column": "units", "method": "what"}, {"op": "encode_categorical", "column": "date", "method": "onehot"},
    {"op": "encode_categorical", "column": "region", "method": "what"}, {"op": "what"}])
def test_bad_operations_are_refused(spark, op):
    with pytest.raises(ValueError):
        apply_operation(sales(spark), op)


def test_recipe_undo_and_refit(spark):
    df = sales(spark)
    recipe = Recipe([{"op": "trim_whitespace", "columns": ["region"]}, {"op": "standardize_case", "column": "region", "case": "title"},
                     {"op": "encode_categorical", "column": "channel", "method": "onehot"}, {"op": "drop_column", "columns": "note"}])
    out = recipe.fit(df).transform(df)
    assert {"channel_Online", "channel_Retail"} <= set(out.columns) and "note" not in out.columns
    assert {r[0] for r in out.select("region").distinct().collect()} == {"North", "South", "East", "West"}
    assert "note" in recipe[:-1].fit(df).transform(df).columns
    assert recipe[:0].fit(df).transform(df).columns == df.columns


def test_convert_keeps_only_whole_numbers(spark):
    df = spark.createDataFrame([("12",), (" 7 ",), ("1.5",), ("12d",), ("nan",), ("1e2",), (None,)], "s string")
    ints = [r[0] for r in apply_operation(df, {"op": "convert_dtype", "column": "s", "dtype": "int"}).collect()]
    assert ints == [12, 7, None, None, None, 100, None]
    nums = [r[0] for r in apply_operation(df, {"op": "convert_dtype", "column": "s", "dtype": "numeric"}).collect()]
    assert nums == [12.0, 7.0, 1.5, None, None, 100.0, None]


def test_charts(spark):
    df = sales(spark)
    h = charts.histogram(df, "units", 5)
    assert h.agg(F.sum("count")).first()[0] == 240 and h.count() == 5
    flat = spark.createDataFrame([(3.0,)] * 4, "x double")
    assert [r["count"] for r in charts.histogram(flat, "x", 5).orderBy("bin").collect()] == [0, 0, 4, 0, 0]
    with pytest.raises(ValueError):
        charts.pie(df, "date")
    with pytest.raises(ValueError):
        charts.build_chart(df, {"type": "what", "x": "units"})
    months = charts.build_chart(df, {"type": "line", "x": "date", "y": "revenue", "agg": "sum"})
    assert months.count() == 12
    gap = spark.createDataFrame([(datetime(2024, 1, 1), 1.0), (datetime(2024, 1, 4), 2.0)], "t timestamp_ntz, y double")
    assert [r["y"] for r in charts.time_series(gap, "t", "y", "sum").orderBy("period").collect()] == [1.0, 0.0, 0.0, 2.0]
    assert [r["y"] for r in charts.time_series(gap, "t", "y", "mean").orderBy("period").collect()] == [1.0, None, None, 2.0]


def test_special_functions():
    assert float(special.t_two_sided(2.0, 10)) == pytest.approx(0.07338803477074037, rel=1e-10)
    assert special.t_quantile(0.95, 10) == pytest.approx(2.2281388519649385, rel=1e-9)
    assert special.gamma_tail(0.5, 3.841458820694124 / 2) == pytest.approx(0.05, rel=1e-9)
    assert float(special.beta_cdf(2.0, 3.0, 0.5)) == pytest.approx(0.6875, rel=1e-12)
    # six of the 24 orders of four elements have at most ... inversions: 1 + 3 of 24, both tails
    assert special.kendall_exact(4, 1) == pytest.approx(2 * 4 / 24)
    assert special.kendall_exact(4, 3) == 1.0


def test_tests_match_known_values(spark):
    rows = [("a", v) for v in (3.0, 4.0, 5.0, 6.0)] + [("b", v) for v in (6.0, 7.0, 8.0, 9.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    t = stats.ttest(df, "v", "g", "a", "b").first()
    assert t["t_stat"] == pytest.approx(-3.2863353) and t["dof"] == pytest.approx(6) and t["p_value"] == pytest.approx(0.016687, abs=1e-5)
    f = stats.anova(df, "v", "g").first()
    assert f["f_stat"] == pytest.approx(10.8) and f["p_value"] == pytest.approx(t["p_value"], rel=1e-9)
    ci = stats.confidence_interval(df, "v").first()
    assert (ci["ci_low"] + ci["ci_high"]) / 2 == pytest.approx(6.0)
    yates = spark.createDataFrame([("x", "p")] * 10 + [("x", "q")] * 20 + [("y", "p")] * 30 + [("y", "q")] * 40, "a string, b string")
    c = stats.chi_square(yates, "a", "b").first()
    assert c["chi2"] == pytest.approx(0.4464286, abs=1e-6) and c["dof"] == 1
    line = spark.createDataFrame([(float(i), 2.0 * i) for i in range(10)], "x double, y double")
    assert stats.correlation(line, "x", "y").first()["p_value"] == 0.0
    assert stats.correlation(line, "x", "y", "kendall").first()["p_value"] == pytest.approx(2 / math.factorial(10))
    for bad in (lambda: stats.ttest(df, "v", "g", "b", "b"), lambda: stats.confidence_interval(df, "v", 0.4),
                lambda: stats.descriptive(df, ["g"]), lambda: stats.chi_square(df, "g", "g") and stats.anova(df, "g", "v")):
        if bad is not None:
            with pytest.raises(ValueError):
                bad()


def test_trend_ignores_the_order_of_equal_times(spark):
    rows = [(datetime(2024, 1, 1 + i // 4), float(i)) for i in range(12)]
    for parts in (1, 5):
        t = trends.trend_thirds(spark.createDataFrame(rows, "t timestamp_ntz, y double").repartition(parts), "t", ["y"]).first()
        assert t["n"] == 12 and t["early_mean"] == pytest.approx(1.5) and t["recent_mean"] == pytest.approx(9.5)
    tied = [(datetime(2024, 1, 1), float(i)) for i in range(9)]
    t = trends.trend_thirds(spark.createDataFrame(tied, "t timestamp_ntz, y double"), "t", ["y"]).first()
    assert t["early_mean"] == pytest.approx(4.0) and t["direction"] == "flat"


def test_facts_are_written_once(spark):
    facts = Facts(sales(spark))
    assert facts.columns is facts.columns and facts.numbers is facts.numbers
    assert facts.columns.count() == 8


def test_metrics(spark):
    df = spark.createDataFrame([("a", "a", True, 0.9), ("a", "b", True, 0.4), ("b", "b", False, 0.4), ("c", "b", False, 0.1)],
                               "label string, prediction string, y boolean, s double")
    m = metrics.classification_metrics(df, "label", "prediction").first()
    assert m["accuracy"] == 0.5 and m["recall"] == 0.5 and m["precision"] == pytest.approx((2 * 1 + 1 / 3) / 4)
    assert metrics.confusion_matrix(df, "label", "prediction").count() == 9
    assert metrics.roc_auc(df, "y", "s").first()["roc_auc"] == pytest.approx(0.875)
    assert metrics.roc_auc(df, "y", "s", rows_per_slice=1).first()["roc_auc"] == pytest.approx(0.875)


def test_csv_inputs(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x;y;z\n1;"a;b";2\n3;c;4\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text("only\n1\n2\n", encoding="utf-8")
    (tmp_path / "c.csv").write_bytes("naïve\nété,1\n".encode("latin-1"))
    found = {r["file"].rsplit("/", 1)[-1]: (r["delimiter"], r["columns"]) for r in files.detect_delimiters(spark, str(tmp_path)).collect()}
    assert found["a.csv"] == (";", 3) and found["b.csv"] == (",", 1)
    codes = {r["file"].rsplit("/", 1)[-1]: r["encoding"] for r in files.detect_encodings(spark, str(tmp_path)).collect()}
    assert codes == {"a.csv": "utf-8", "b.csv": "utf-8", "c.csv": "iso-8859-1"}
    (tmp_path / "d.csv").write_text(' id ,note,note,\n1,"two\nlines",x,\n2,"he said ""hi""",y,\n', encoding="utf-8")
    df = files.read_csv(spark, str(tmp_path / "d.csv"))
    assert df.columns == ["id", "note", "note_1", "column_4"] and df.count() == 2
    with pytest.raises(ValueError):
        files.check_path("x.exe")
    (tmp_path / "e.csv").write_text("a,b\n", encoding="utf-8")
    with pytest.raises(ValueError):
        files.read_csv(spark, str(tmp_path / "e.csv"), delimiter=",")
