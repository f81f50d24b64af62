"""Rank correlations: columns ranked once, inversions counted by slices, against brute force."""

import random
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factsieve.operators import eda
from factsieve.plans.ranks import _places, discordant_pairs, inversions, kendall_pairs, spearman_pairs


def brute(rows):
    """Weight of the pairs with a smaller x and a larger y."""
    return sum(a[2] * b[2] for a in rows for b in rows if a[0] < b[0] and a[1] > b[1])


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.tuples(st.integers(0, 9), st.integers(0, 9)), st.integers(1, 2 ** 40), max_size=40))
def test_inversions_are_the_discordant_pairs(table):
    rows = [(*k, n) for k, n in table.items()]
    x, y, w = (np.array([r[i] for r in rows], np.int64) for i in range(3))
    assert inversions(_places(y, x), _places(x, y), w) == brute(rows)


@pytest.mark.parametrize("rows_per_slice", [3, 17, 64, 10_000])
def test_discordant_pairs_in_slices(spark, rows_per_slice):
    rng = random.Random(rows_per_slice)
    rows, want = [], {}
    for pair in range(3):
        # the third has one x for a third of its rows
        cells = {(float(rng.randrange(12)) if pair < 2 or rng.random() > 0.3 else 5.0, float(rng.randrange(-20, 20))): rng.choice([1, 2, 2 ** 33]) for _ in range(90)}
        want[pair] = brute([(*k, n) for k, n in cells.items()])
        rows += [(pair, x, y, n) for (x, y), n in cells.items()]
    counted = spark.createDataFrame(rows, "pair int, x double, y double, cnt long").repartition(4)
    assert {r["pair"]: int(r["dis"]) for r in discordant_pairs(counted, rows_per_slice).collect()} == want


def table(n=120, gaps=True):
    rng = np.random.default_rng(5)
    base = rng.normal(size=n)
    p = pd.DataFrame({"a": base, "b": np.round(base + rng.normal(size=n), 1), "c": rng.integers(0, 4, n).astype(float),
                      "d": np.where(rng.random(n) < 0.4, 0.0, -base), "e": np.ones(n), "f": base * 2})
    if gaps:
        p.loc[rng.random(n) < 0.2, "f"] = None
    return p


@pytest.mark.parametrize("gaps, rows_per_slice, small_values", [(False, 40, 0), (False, 10_000, 150), (True, 40, 10), (True, 10_000, 10_000)])
def test_spearman_of_complete_columns_and_of_columns_with_gaps(spark, gaps, rows_per_slice, small_values):
    p = table(gaps=gaps)
    df = spark.createDataFrame(p.astype(object).where(p.notna(), None), ", ".join(f"{c} double" for c in p)).repartition(3)
    pairs = list(combinations(p, 2))
    got = {(r["x"], r["y"]): (r["n"], r["r"]) for r in spearman_pairs(df, pairs, rows_per_slice, small_values).collect()}
    assert list(sorted(got)) == pairs
    for x, y in pairs:
        both = p[[x, y]].dropna()
        assert got[x, y][0] == len(both)
        if "e" in (x, y):
            assert got[x, y][1] is None
        else:
            assert got[x, y][1] == pytest.approx(both.rank().corr().iloc[0, 1], abs=1e-12)


def test_rank_correlations_of_small_tables(spark):
    for rows in ([], [(1.0, 2.0)], [(None, 1.0), (None, 2.0)], [(float("nan"), 1.0), (1.0, float("inf"))]):
        df = spark.createDataFrame(rows, "x double, y double")
        for how in (spearman_pairs, kendall_pairs):
            row = how(df, [("x", "y")]).first()
            assert row["r"] is None and row["n"] == (1 if rows == [(1.0, 2.0)] else 0)
    signs = spark.createDataFrame([(0.0, 1.0), (-0.0, 1.0), (1.0, 2.0)], "x double, y double")
    assert spearman_pairs(signs, [("x", "y")]).first()["r"] == pytest.approx(1.0)
    assert kendall_pairs(signs, [("x", "y")]).first()["r"] == pytest.approx(1.0)


def test_matrix_takes_as_many_jobs_for_any_number_of_columns(spark):
    rng = np.random.default_rng(1)
    jobs = {}
    for method in ("spearman", "kendall"):
        for width in (3, 25):
            df = spark.createDataFrame(pd.DataFrame(rng.normal(size=(60, width)), columns=[f"v{i}" for i in range(width)]))
            group = f"{method}-{width}"
            spark.sparkContext.setJobGroup(group, group)
            assert eda.correlation_matrix(df, method).count() == width * width
            jobs[group] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setJobGroup("", "")
        assert jobs[f"{method}-25"] <= jobs[f"{method}-3"] + 2
