"""Registered queries: exploration and chart aggregates."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from factsieve.catalog.inputs import WITH_BASE, WITH_DIRTY, dirty_base, dirty_orders, table
from factsieve.catalog.shape import rounded, union_sql
from factsieve.operators import charts, eda

LINE = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
RANKED = ["l_linenumber", "l_quantity", "l_discount", "l_tax"]
AGGS = {"mean": "avg(y)", "sum": "coalesce(sum(y), 0)", "median": "median(y)", "min": "min(y)", "max": "max(y)",
        "count": "count(y)"}


def pair_sql(columns: list[str], source: str, corr) -> str:
    return union_sql([f"SELECT '{x}' AS x, '{y}' AS y, {corr(x, y)} AS r FROM {source}" for x, y in combinations(columns, 2)])


def matrix_sql(columns: list[str], source: str, corr) -> str:
    return (f"WITH u AS ({pair_sql(columns, source, corr)}) SELECT x, y, round(r, 4) AS r FROM u UNION ALL SELECT y, x, round(r, 4) FROM u "
            + "".join(f" UNION ALL SELECT '{c}', '{c}', 1.0::DOUBLE" for c in columns))


def spearman(x: str, y: str) -> str:
    return f"""(SELECT corr(a, b) FROM (SELECT
  rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0 AS a,
  rank() OVER (ORDER BY {y}) + (count(*) OVER (PARTITION BY {y}) - 1) / 2.0 AS b FROM lineitem))"""


def kendall(x: str, y: str, source: str = "lineitem") -> str:
    return f"""(WITH c AS (SELECT {x} AS x, {y} AS y, count(*)::DOUBLE AS k FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY 1, 2),
  p AS (SELECT sum(CASE WHEN (a.x - b.x) * (a.y - b.y) > 0 THEN a.k * b.k WHEN (a.x - b.x) * (a.y - b.y) < 0 THEN -a.k * b.k ELSE 0 END) / 2 AS s FROM c a, c b),
  n AS (SELECT sum(k) AS n FROM c), tx AS (SELECT sum(k * (k - 1) / 2) AS t FROM (SELECT sum(k) AS k FROM c GROUP BY x)),
  ty AS (SELECT sum(k * (k - 1) / 2) AS t FROM (SELECT sum(k) AS k FROM c GROUP BY y))
  SELECT s / (sqrt(n * (n - 1) / 2 - tx.t) * sqrt(n * (n - 1) / 2 - ty.t)) FROM p, n, tx, ty)"""


def flat(corr):
    """Scalar subqueries need one row, not one per input row."""
    return lambda columns: (f"WITH u AS (" + union_sql(
        [f"SELECT '{x}' AS x, '{y}' AS y, {corr(x, y)} AS r" for x, y in combinations(columns, 2)])
        + ") SELECT x, y, round(r, 4) AS r FROM u UNION ALL SELECT y, x, round(r, 4) FROM u "
        + "".join(f" UNION ALL SELECT '{c}', '{c}', 1.0::DOUBLE" for c in columns))


def bins_sql(c: str, source: str, bins: str) -> str:
    return f"""WITH f AS (SELECT min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi, {bins} AS bins FROM {source}),
h AS (SELECT least(floor(({c} - lo) / ((hi - lo) / bins)), bins - 1)::INT AS bin, count(*) AS k FROM {source}, f WHERE {c} IS NOT NULL GROUP BY 1)
SELECT s.bin, round(s.bin * ((hi - lo) / bins) + lo, 6) AS low, round((s.bin + 1) * ((hi - lo) / bins) + lo, 6) AS high, coalesce(k, 0) AS count
FROM (SELECT unnest(range((SELECT bins FROM f)::BIGINT))::INT AS bin) s CROSS JOIN f LEFT JOIN h ON h.bin = s.bin"""


def box_sql(groups: str, source: str, value: str) -> str:
    return f"""v AS (SELECT {groups} AS "group", {value} AS x FROM {source}),
q AS (SELECT "group", count(x) AS n, min(x)::DOUBLE AS min, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median,
  quantile_cont(x, 0.75) AS q3, max(x)::DOUBLE AS max FROM v GROUP BY 1)
SELECT "group", n, round(min, 6) AS min, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(max, 6) AS max,
  round(q1 - 1.5 * (q3 - q1), 6) AS low, round(q3 + 1.5 * (q3 - q1), 6) AS high,
  (SELECT count(*) FROM v WHERE v."group" = q."group" AND (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1))) AS outliers FROM q"""


def bar_sql(agg: str) -> str:
    return WITH_BASE + f"""SELECT x, round({AGGS[agg]}::DOUBLE, 4) AS y FROM (SELECT coalesce(o_orderpriority, 'nan') AS x, o_totalprice AS y FROM base)
GROUP BY x ORDER BY {AGGS[agg]} DESC NULLS LAST, x LIMIT 15"""


def series_sql(source: str, time: str, y: str, period: str, agg: str) -> str:
    label = {"month": "last_day(s)", "week": "(s + INTERVAL 6 DAY)::DATE", "day": "s::DATE"}[period]
    empty = "coalesce({}, 0)" if agg in ("sum", "count") else "{}"
    return f"""WITH a AS (SELECT date_trunc('{period}', {time}) AS s, {AGGS[agg].replace('y', y)} AS v FROM {source} GROUP BY 1),
p AS (SELECT unnest(generate_series((SELECT min(s) FROM a)::TIMESTAMP, (SELECT max(s) FROM a)::TIMESTAMP, INTERVAL 1 {period})) AS s)
SELECT ({label})::TIMESTAMP AS period, round({empty.format('v')}::DOUBLE, 4) AS y FROM p LEFT JOIN a USING (s)"""


QUERIES = {
    "univariate_numeric": lambda s, d: rounded(eda.univariate_numeric(table(s, d, "events"), "value")),
    "univariate_histogram": lambda s, d: rounded(eda.univariate_histogram(table(s, d, "events"), "value")),
    "univariate_categorical": lambda s, d: eda.univariate_categorical(dirty_orders(s, d), "raw_amount"),
    "corr_matrix_pearson": lambda s, d: eda.correlation_matrix(table(s, d, "lineitem"), "pearson", columns=LINE),
    "corr_matrix_spearman": lambda s, d: eda.correlation_matrix(table(s, d, "lineitem"), "spearman", columns=RANKED),
    "corr_matrix_kendall": lambda s, d: eda.correlation_matrix(table(s, d, "lineitem"), "kendall", columns=RANKED),
    "strongest_pairs": lambda s, d: eda.strongest_pairs(table(s, d, "lineitem")),
    "bivariate_corr": lambda s, d: rounded(eda.bivariate(dirty_orders(s, d), "o_custkey", "o_totalprice")[1]),
    "group_means": lambda s, d: rounded(eda.bivariate(dirty_orders(s, d), "o_orderpriority", "o_totalprice")[1], 4),
    "crosstab": lambda s, d: eda.bivariate(dirty_orders(s, d), "o_orderpriority", "o_orderstatus")[1],
    "crosstab_wide": lambda s, d: eda.crosstab(table(s, d, "part"), "p_brand", "p_size", top_x=15, top_y=8),
    "chart_histogram": lambda s, d: rounded(charts.build_chart(table(s, d, "lineitem"), {"type": "histogram", "x": "l_extendedprice"})),
    "chart_box": lambda s, d: rounded(charts.build_chart(dirty_orders(s, d), {"type": "box", "y": "o_totalprice"})),
    "chart_box_many_groups": lambda s, d: rounded(charts.box_grouped(table(s, d, "part"), "p_retailprice", "p_brand")),
    "chart_box_grouped": lambda s, d: rounded(charts.build_chart(dirty_orders(s, d), {
        "type": "box", "y": "o_totalprice", "group": "o_orderpriority"})),
    "chart_scatter": lambda s, d: rounded(charts.build_chart(dirty_base(s, d), {
        "type": "scatter", "x": "o_custkey", "y": "o_totalprice", "group": "o_orderstatus", "key": ["o_orderkey"]})),
    **{f"chart_bar_{agg}": (lambda s, d, agg=agg: rounded(charts.build_chart(dirty_base(s, d), {
        "type": "bar", "x": "o_orderpriority", "y": "o_totalprice", "agg": agg}), 4)) for agg in AGGS},
    "chart_grouped_series": lambda s, d: rounded(charts.build_chart(dirty_base(s, d), {
        "type": "line", "x": "o_custkey", "y": "o_totalprice", "group": "o_orderstatus", "agg": "sum"}), 4),
    "timeseries_month": lambda s, d: rounded(charts.build_chart(table(s, d, "orders"), {
        "type": "line", "x": "o_orderdate", "y": "o_totalprice", "agg": "mean"}), 4),
    "timeseries_week": lambda s, d: rounded(charts.build_chart(table(s, d, "events"), {
        "type": "area", "x": "ts", "y": "value", "agg": "sum"}), 4),
    "timeseries_day": lambda s, d: rounded(charts.time_series(table(s, d, "orders"), "o_orderdate", "o_totalprice", "count", "day"), 4),
    "chart_frequency": lambda s, d: charts.build_chart(dirty_orders(s, d), {"type": "bar", "x": "raw_amount"}),
    "chart_pie": lambda s, d: charts.build_chart(dirty_orders(s, d), {"type": "pie", "x": "o_orderstatus"}),
}

def dropped_sql(start: str, source: str, group: str, y: str) -> str:
    """Boxes of the most frequent groups, and what they leave out."""
    g = f"coalesce({group}, 'nan')"
    shown = f"(SELECT * FROM {source} WHERE {g} IN (SELECT g FROM top))"
    boxes = box_sql(g, shown, y)
    return (start.rstrip().rstrip(",") + f", top AS (SELECT {g} AS g FROM {source} GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 12), boxes AS (WITH " + boxes
            + f") SELECT *, (SELECT count(DISTINCT {g}) FROM {source}) - (SELECT count(*) FROM top) AS dropped_groups, "
            f"(SELECT count(*) FROM {source}) - (SELECT count(*) FROM {shown}) AS dropped_rows FROM boxes")


ORACLE = {
    "univariate_numeric": """SELECT 'value' AS "column", count(value) AS count, round(avg(value), 6) AS mean, round(median(value), 6) AS median,
  round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min, round(quantile_cont(value, 0.25), 6) AS q1,
  round(quantile_cont(value, 0.75), 6) AS q3, round(max(value), 6) AS max, round(max(value) - min(value), 6) AS range,
  round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr,
  round(skewness(value) * (count(value) - 2) / sqrt(count(value)::DOUBLE * (count(value) - 1)), 6) AS skew_pop,
  round(kurtosis_pop(value), 6) AS kurtosis_pop FROM events""",
    "univariate_histogram": bins_sql("value", "events", "least(40, greatest(10, floor(floor(sqrt(count(value))) / 2)))"),
    "univariate_categorical": WITH_DIRTY + """, c AS (SELECT raw_amount AS v, count(*) AS k FROM dirty WHERE raw_amount IS NOT NULL GROUP BY 1),
t AS (SELECT row_number() OVER (ORDER BY k DESC, v) AS rank, v, k FROM c)
SELECT rank, v AS "value", k AS count, round(k * 100.0::DOUBLE / (SELECT sum(k) FROM c), 2) AS pct,
  CAST((SELECT sum(k) FROM t WHERE rank > 20) AS BIGINT) AS other_count, (SELECT count(*) FROM c) AS n_distinct,
  (SELECT count(*) FROM dirty WHERE raw_amount IS NULL) AS missing FROM t WHERE rank <= 20""",
    "corr_matrix_pearson": matrix_sql(LINE, "lineitem", lambda x, y: f"corr({x}, {y})"),
    "corr_matrix_spearman": flat(spearman)(RANKED),
    "corr_matrix_kendall": flat(kendall)(RANKED),
    "strongest_pairs": "WITH u AS (" + pair_sql(
        ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"],
        "lineitem", lambda x, y: f"corr({x}, {y})") + ") SELECT x, y, round(r, 4) AS r FROM u ORDER BY abs(r) DESC, x, y LIMIT 15",
    "bivariate_corr": WITH_DIRTY + "SELECT 'o_custkey' AS x, 'o_totalprice' AS y, count(o_totalprice) AS n, round(corr(o_custkey, o_totalprice), 6) AS r FROM dirty",
    "group_means": WITH_DIRTY + """SELECT coalesce(o_orderpriority, 'nan') AS "group", round(avg(o_totalprice), 4) AS mean FROM dirty GROUP BY 1
HAVING count(o_totalprice) > 0 ORDER BY avg(o_totalprice) DESC, 1 LIMIT 10""",
    "crosstab": WITH_DIRTY + "SELECT coalesce(o_orderpriority, 'nan') AS x, coalesce(o_orderstatus, 'nan') AS y, count(*) AS count FROM dirty GROUP BY 1, 2",
    "crosstab_wide": """WITH p AS (SELECT p_brand AS x, p_size::VARCHAR AS y FROM part),
tx AS (SELECT x FROM p GROUP BY x ORDER BY count(*) DESC, x LIMIT 15),
ty AS (SELECT y FROM p GROUP BY y ORDER BY count(*) DESC, y LIMIT 8)
SELECT x, y, count(*) AS count FROM p WHERE x IN (SELECT x FROM tx) AND y IN (SELECT y FROM ty) GROUP BY 1, 2""",
    "chart_histogram": bins_sql("l_extendedprice", "lineitem", "30"),
    "chart_box": WITH_DIRTY + ", " + box_sql("'o_totalprice'", "dirty", "o_totalprice"),
    "chart_box_grouped": dropped_sql(WITH_DIRTY, "dirty", "o_orderpriority", "o_totalprice"),
    "chart_box_many_groups": dropped_sql("WITH nothing AS (SELECT 1), ", "part", "p_brand", "p_retailprice"),
    "chart_scatter": WITH_BASE + """SELECT o_orderkey, round(o_custkey::DOUBLE, 6) AS x, round(o_totalprice, 6) AS y, coalesce(o_orderstatus, 'nan') AS color
FROM base WHERE o_totalprice IS NOT NULL ORDER BY md5(concat(o_orderkey, '|7')), o_orderkey LIMIT 5000""",
    **{f"chart_bar_{agg}": bar_sql(agg) for agg in AGGS},
    "chart_grouped_series": WITH_BASE + """, v AS (SELECT o_custkey::VARCHAR AS x, coalesce(o_orderstatus, 'nan') AS g, o_totalprice AS y FROM base),
tx AS (SELECT x FROM v GROUP BY x ORDER BY count(*) DESC, x LIMIT 30), tg AS (SELECT g FROM v GROUP BY g ORDER BY count(*) DESC, g LIMIT 6),
a AS (SELECT g, x, coalesce(sum(y), 0) AS y FROM v WHERE x IN (SELECT x FROM tx) AND g IN (SELECT g FROM tg) GROUP BY 1, 2)
SELECT tg.g AS series, tx.x, round(a.y, 4) AS y, (SELECT count(DISTINCT g) FROM v) - (SELECT count(*) FROM tg) AS dropped_series,
  (SELECT count(DISTINCT x) FROM v) - (SELECT count(*) FROM tx) AS dropped_x FROM tg CROSS JOIN tx LEFT JOIN a ON a.g = tg.g AND a.x = tx.x
WHERE tx.x IN (SELECT x FROM a)""",
    "timeseries_month": series_sql("orders", "o_orderdate", "o_totalprice", "month", "mean"),
    "timeseries_week": series_sql("events", "ts", "value", "week", "sum"),
    "timeseries_day": series_sql("orders", "o_orderdate", "o_totalprice", "day", "count"),
    "chart_frequency": WITH_DIRTY + "SELECT coalesce(raw_amount, 'nan') AS x, count(*) AS count FROM dirty GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15",
    "chart_pie": WITH_DIRTY + "SELECT coalesce(o_orderstatus, 'nan') AS x, count(*) AS count FROM dirty GROUP BY 1",
}
