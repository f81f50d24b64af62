"""Column-wise date formats, page indexes, and whole-row equality with maps."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from factsieve.operators import browse, roles
from factsieve.operators.clean import Recipe
from factsieve.plans import dates
from factsieve.plans.pages import PageIndex
from factsieve.plans.rows import distinct_rows, duplicate_summary
from factsieve.sources import tables


def column(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")


def typed(spark, values):
    return [r.t for r in tables.load(column(spark, values)).orderBy("i").collect()]


def verdict(spark, values):
    r = dates.date_formats(column(spark, values), ["t"]).first()
    return r.format, r.parsed, r.unread, r.status, r.rival


def day(y, m, d, *clock):
    return dt.datetime(y, m, d, *clock)


def test_day_first_column_is_read_day_first(spark):
    values = ["01/02/2024", "05/02/2024", "13/02/2024", "28/02/2024", None, " 03/04/2024 "]
    assert typed(spark, values) == [day(2024, 2, 1), day(2024, 2, 5), day(2024, 2, 13), day(2024, 2, 28), None, day(2024, 4, 3)]
    assert verdict(spark, values) == ("day/month/year", 5, 0, "clear", "month/day/year")


def test_month_first_and_ambiguous_columns(spark):
    assert typed(spark, ["02/01/2024", "02/05/2024", "02/13/2024"]) == [day(2024, 2, 1), day(2024, 2, 5), day(2024, 2, 13)]
    assert verdict(spark, ["01/02/2024", "05/06/2024", "07/08/2024"]) == ("month/day/year", 3, 0, "ambiguous", "day/month/year")
    assert verdict(spark, ["01.02.2024", "05.06.2024"]) == ("day.month.year", 2, 0, "ambiguous", "month.day.year")
    assert verdict(spark, ["01-02-2024", "05-26-2024"]) == ("month-day-year", 2, 0, "clear", "day-month-year")


def test_mixed_columns_say_so_and_keep_one_format(spark):
    two = ["13/02/2024", "14/02/2024", "15/02/2024", "16/02/2024", "02/17/2024"]
    assert verdict(spark, two) == ("day/month/year", 4, 1, "mixed", "month/day/year")
    assert typed(spark, two)[-1] is None
    shapes = ["2024-02-13", "2024-02-14 10:30:00", "2024-02-15T01:02:03", "14.02.2024"]
    assert verdict(spark, shapes) == ("year-month-day", 3, 1, "mixed", None)
    assert typed(spark, shapes) == [day(2024, 2, 13), day(2024, 2, 14, 10, 30), day(2024, 2, 15, 1, 2, 3), None]
    assert verdict(spark, ["2024-02-13", "2024-02-30", "no"]) == ("year-month-day", 1, 2, "clear", None)


def test_times_months_by_name_and_no_dates(spark):
    assert typed(spark, ["31/12/2023 23:59", "01/01/2024 00:00:30", "02/01/2024"]) == [
        day(2023, 12, 31, 23, 59), day(2024, 1, 1, 0, 0, 30), day(2024, 1, 2)]
    assert typed(spark, ["1/31/2024 1:05 PM", "12/1/2024 12:00:01 AM", "2/1/2024 9:00 AM"]) == [
        day(2024, 1, 31, 13, 5), day(2024, 12, 1, 0, 0, 1), day(2024, 2, 1, 9)]
    assert typed(spark, ["3 Mar 2024", "14 Apr 2024 08:00", "1 May 2024"]) == [day(2024, 3, 3), day(2024, 4, 14, 8), day(2024, 5, 1)]
    assert typed(spark, ["20240131", "20240201", "20240202"]) == ["20240131", "20240201", "20240202"]  # plain numbers stay text
    assert verdict(spark, ["x", "1.5", "2024"]) == (None, 0, 3, "none", None)
    assert verdict(spark, [None, None]) == (None, 0, 0, "none", None)
    assert dates.date_formats(spark.range(3)).count() == 0


def test_every_format_reads_its_own_writing(spark):
    when = day(2021, 11, 23, 0, 0)
    one = spark.createDataFrame([(when,)], "d timestamp_ntz")
    for f in dates.FORMATS:
        pattern = (f.pattern or "yyyy-MM-dd").replace("[ H:mm[:ss]]", "").replace("[:ss]", ":ss").replace("y/", "yyyy/") if f.pattern else "yyyy-MM-dd"
        text = one.select(F.date_format("d", pattern).alias("t"))
        got = text.select(dates.read("t", f.name).alias("v"), "t").first()
        assert got.v == when, (f.name, got.t)


def test_fitted_formats_hold_for_new_rows(spark):
    old, new = column(spark, ["13/02/2024", "01/02/2024"]), column(spark, ["03/04/2024", "04/13/2024"])
    fitted = Recipe([{"op": "convert_dtype", "column": "t", "dtype": "datetime"}]).fit(old)
    assert [r.t for r in fitted.transform(new).orderBy("i").collect()] == [day(2024, 4, 3), None]
    assert {r["column"]: r["role"] for r in roles.column_roles(column(spark, ["13/02/2024"] * 3)).collect()} == {"i": "numeric", "t": "datetime"}


def page_table(spark, n=2000):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, 1.5, 2.0, 7.25]), rng.choice(["hot", "hot", "cold", None]), i) for i in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k long, v double, slice string, `a place` int")


@pytest.mark.parametrize("descending", [False, True])
def test_pages_are_the_sorted_rows(spark, descending):
    df = page_table(spark)
    want = [tuple(r) for r in browse.sort_rows(df, "v", ["k"], descending).collect()]
    index = PageIndex.build(df, [("v", descending), ("k", False)], rows_per_slice=150)
    got = []
    for number in range(1, 22):
        got += [tuple(r) for r in index.page(number, 100).collect()]
    assert got[:2000] == want and got[2000:] == want[1900:]  # pages beyond the last are the last
    again = PageIndex.open(spark, index.path)
    assert again.rows == 2000 and [tuple(r) for r in again.page(7, 30).collect()] == want[180:210]


def test_a_page_reads_its_slice_only(spark):
    index = PageIndex.build(page_table(spark), [("k", False)], rows_per_slice=200)
    plans = []
    for number in (1, 60):
        page = index.page(number, 25)
        plan = page._jdf.queryExecution().executedPlan().toString()
        assert "Offset" not in plan and "Exchange hashpartitioning" not in plan
        plans.append(plan.count("Scan parquet"))
        assert "PartitionFilters: [slice" in plan or "PartitionFilters: [isnotnull(slice" in plan
    assert plans[0] == plans[1]


def test_pages_of_searched_and_empty_tables(spark):
    df = page_table(spark)
    found = browse.page_rows(df, 2, ["k"], 50, "cold", "v", True)
    want = browse.sort_rows(browse.search_rows(df, "cold"), "v", ["k"], True).collect()[50:100]
    assert [tuple(r) for r in found.collect()] == [tuple(r) for r in want]
    assert browse.page_rows(df, 3, ["k"], 50, "no such text").count() == 0


def test_distinct_rows_with_maps_at_any_depth(spark):
    kind = "id int, m map<string,map<string,int>>, s struct<a:array<map<int,string>>>"
    rows = [(1, {"x": {"p": 1, "q": 2}, "y": {}}, ([{1: "a", 2: "b"}],)), (1, {"y": {}, "x": {"q": 2, "p": 1}}, ([{2: "b", 1: "a"}],)),
            (1, {"x": {"p": 1, "q": 3}, "y": {}}, ([{1: "a", 2: "b"}],)), (1, None, None), (1, None, None), (1, {}, None)]
    df = spark.createDataFrame(rows, kind)
    assert distinct_rows(df).count() == 4 and distinct_rows(df).schema == df.schema
    assert Recipe([{"op": "remove_duplicates"}]).fit(df).transform(df).count() == 4
    assert tuple(duplicate_summary(df).first()) == (6, 2)
    assert distinct_rows(spark.createDataFrame([(1.0, "a"), (1.0, "a"), (0.0, "a"), (-0.0, "a")], "x double, y string")).count() == 2


def test_colliding_fingerprints_do_not_count_as_duplicates(spark):
    df = spark.createDataFrame([(i % 40, "x") for i in range(100)], "a int, b string")
    same = lambda d: [F.lit(1).alias("_h1"), (F.col("a") % 3).cast("long").alias("_h2")]
    assert tuple(duplicate_summary(df, same).first()) == (100, 60) == tuple(duplicate_summary(df).first())
    assert tuple(duplicate_summary(df.limit(0)).first()) == (0, 0)
