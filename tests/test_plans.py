"""Order, quantiles, ranks: the distributed paths against brute force, with tiny slices and brackets forced."""

import math
import random
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factsieve.plans import quantiles as q
from factsieve.plans.frequency import distinct_counts, top_of, value_counts
from factsieve.plans.moments import adjusted_kurtosis, adjusted_skew, moments
from factsieve.plans.ordering import carry, running_total
from factsieve.plans.ranks import kendall_pairs, spearman_pairs
from factsieve.plans.rows import duplicate_summary
from factsieve.plans.sampling import bottom_k
from factsieve.plans.store import materialize

SLOW = dict(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def hot_frame(n=900, seed=3):
    """Two groups; a third of all rows share one value."""
    rnd = random.Random(seed)
    return [("big" if i % 5 else "small", 7.0 if i % 3 == 0 else round(rnd.gauss(0, 5), 2)) for i in range(n)]


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_quantiles_match_numpy_in_brackets_and_slices(spark, monkeypatch, parts):
    monkeypatch.setattr(q, "WHOLE_GROUP", 50)
    rows = hot_frame()
    df = spark.createDataFrame(rows, "g string, v double").repartition(parts)
    got = {r["g"]: r for r in q.quantiles(df, ["g"], "v", {"a": 0.05, "b": 0.5, "c": 0.93}, rows_per_slice=20).collect()}
    for g in ("big", "small"):
        want = np.quantile([v for k, v in rows if k == g], [0.05, 0.5, 0.93])
        assert [got[g]["a"], got[g]["b"], got[g]["c"]] == pytest.approx(list(want))
        assert got[g]["n"] == sum(k == g for k, _ in rows)


@given(st.lists(st.one_of(st.none(), st.integers(-5, 5), st.floats(-1e6, 1e6)), min_size=1, max_size=40))
@settings(**SLOW)
def test_quantiles_match_pandas_on_random_values(spark, values):
    s = pd.Series([None if v is None else float(v) for v in values], dtype=float)
    df = spark.createDataFrame([("k", None if v is None else float(v)) for v in values], "g string, v double")
    got = q.quantiles(df, ["g"], "v", {"lo": 0.25, "mid": 0.5, "hi": 0.75}).collect()
    if s.dropna().empty:
        assert got[0]["n"] == 0 and got[0]["mid"] is None
    else:
        assert [got[0]["lo"], got[0]["mid"], got[0]["hi"]] == pytest.approx(list(s.quantile([0.25, 0.5, 0.75])), rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("rows_per_slice", [7, 10_000])
def test_running_total_over_slices(spark, rows_per_slice):
    rows = [(f"k{i % 3}", i // 3 * 2, i % 5 + 1) for i in range(300)]
    df = materialize(spark.createDataFrame(rows, "k string, o int, w bigint").repartition(5))
    got = {(r["k"], r["o"]): r["before"] for r in running_total(df, ["k"], ["o"], "w", rows_per_slice=rows_per_slice).collect()}
    for k, o, _ in rows:
        assert got[k, o] == sum(w for a, b, w in rows if a == k and b < o)


@pytest.mark.parametrize("forward", [True, False])
@pytest.mark.parametrize("groups", [None, ["g"]])
@pytest.mark.parametrize("rows_per_slice", [11, 10_000])
def test_carry_over_slices_matches_pandas(spark, forward, groups, rows_per_slice):
    rnd = random.Random(5)
    # the first order column is hot: a third of the rows share it, the second one splits them
    rows = [(i, 1 if i % 3 == 0 else i, None if i % 4 == 0 else f"g{i % 2}", rnd.choice([None, None, None, float(i)])) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, a int, g string, v double").repartition(6)
    got = {r["id"]: r["v"] for r in carry(df, "v", ["a", "id"], forward, groups, rows_per_slice).collect()}
    p = pd.DataFrame(rows, columns=["id", "a", "g", "v"]).sort_values(["a", "id"])
    p["g"] = p["g"].fillna("none")
    s = p.groupby("g")["v"] if groups else p["v"]
    p["v"] = s.ffill() if forward else s.bfill()
    for i, v in zip(p["id"], p["v"]):
        assert (got[i] is None and math.isnan(v)) or got[i] == v


def paired(n=120, seed=9, null=True):
    rnd = random.Random(seed)
    rows = []
    for _ in range(n):
        x = rnd.randint(0, 9)
        rows.append((None if null and rnd.random() < 0.1 else float(x), None if null and rnd.random() < 0.1 else float(x + rnd.randint(0, 6)),
                     float(rnd.randint(0, 30))))
    return rows


def tau_b(pairs):
    c = d = tx = ty = 0
    for (a, b), (e, f) in combinations(pairs, 2):
        s = (a - e) * (b - f)
        c, d = c + (s > 0), d + (s < 0)
        tx, ty = tx + (a == e), ty + (b == f)
    n0 = len(pairs) * (len(pairs) - 1) / 2
    return (c - d) / math.sqrt((n0 - tx) * (n0 - ty)), d


@pytest.mark.parametrize("rows_per_slice", [13, 10_000])
def test_rank_correlations_are_pairwise_complete(spark, rows_per_slice):
    rows = paired()
    df = spark.createDataFrame(rows, "x double, y double, z double").repartition(3)
    pairs = [("x", "y"), ("x", "z"), ("y", "z")]
    p = pd.DataFrame(rows, columns=["x", "y", "z"])
    for r in spearman_pairs(df, pairs, rows_per_slice).collect():
        both = p[[r["x"], r["y"]]].dropna()
        assert r["n"] == len(both)
        assert r["r"] == pytest.approx(both.rank().corr().iloc[0, 1])
    for r in kendall_pairs(df, pairs, rows_per_slice).collect():
        both = p[[r["x"], r["y"]]].dropna()
        tau, dis = tau_b(list(both.itertuples(index=False, name=None)))
        assert r["r"] == pytest.approx(tau)
        assert r["discordant"] == dis


def test_constant_side_has_no_rank_correlation(spark):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(5)], "x double, y double")
    assert spearman_pairs(df, [("x", "y")]).first()["r"] is None
    assert kendall_pairs(df, [("x", "y")]).first()["r"] is None


def test_moments_match_pandas(spark):
    rnd = random.Random(1)
    p = pd.DataFrame({"a": [rnd.gauss(0, 1) for _ in range(50)], "b": [float(i % 3) for i in range(50)], "c": [2.0] * 50})
    p.loc[3, "a"] = None
    got = {r["column"]: r for r in moments(spark.createDataFrame(p), ["a", "b", "c"])
           .withColumns({"skew": adjusted_skew(), "kurt": adjusted_kurtosis()}).collect()}
    for c in p:
        assert got[c]["mean"] == pytest.approx(p[c].mean())
        assert got[c]["std"] == pytest.approx(p[c].std())
        assert got[c]["skew"] == pytest.approx(p[c].skew())
        assert got[c]["kurt"] == pytest.approx(p[c].kurt())
        assert got[c]["missing"] == p[c].isna().sum()


def test_value_counts_keep_long_texts_apart(spark):
    base = "x" * 200
    rows = [(base + "a", 1), (base + "a", 1), (base + "b", 2), (None, 3)]
    counts = value_counts(spark.createDataFrame(rows, "t string, n int"))
    found = {r["column"]: r["n_distinct"] for r in distinct_counts(counts).collect()}
    assert found == {"t": 2, "n": 3}
    top = top_of(counts, 1).where("column = 't'").first()
    assert top["cnt"] == 2 and len(top["shown"]) == 120 and top["chars"] == 201


def test_duplicates_tell_null_positions_and_zero_signs(spark):
    rows = [("a", None, 0.0), (None, "a", 0.0), ("a", None, -0.0), ("a", None, 0.0)]
    d = duplicate_summary(spark.createDataFrame(rows, "x string, y string, z double")).first()
    assert (d["n_rows"], d["duplicate_rows"]) == (4, 2)


def test_sample_does_not_depend_on_partitions(spark):
    df = spark.range(500).select(F.col("id"))
    picks = [sorted(r["id"] for r in bottom_k(df.repartition(p), ["id"], 20, 7).collect()) for p in (1, 3, 17)]
    assert picks[0] == picks[1] == picks[2] and len(picks[0]) == 20
