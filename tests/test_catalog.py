"""Every query has a stable name; a share of them is compared with DuckDB at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
COMPARED = ["numeric_profile", "quality_issues", "clean_recipe", "corr_matrix_kendall", "chart_box_grouped", "timeseries_week", "welch_ttest",
            "chi_square", "cv_folds", "stream_clean"]


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 120


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("name", COMPARED)
def test_query_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from tools.check_oracle import TABLES, frame
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = entry.queries()[name](spark, SF).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert frame(got) == frame(want)
