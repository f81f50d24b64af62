"""Registered queries: descriptive statistics and tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from factsieve.catalog.chart_queries import kendall
from factsieve.catalog.inputs import WITH_DIRTY, dirty_orders, table
from factsieve.catalog.profile_queries import LINE_NUM
from factsieve.catalog.shape import rounded, union_sql
from factsieve.operators import stats

WORDS = """CASE WHEN abs(r) < 0.1 THEN 'negligible' WHEN abs(r) < 0.3 THEN 'weak' WHEN abs(r) < 0.6 THEN 'moderate'
  WHEN abs(r) < 0.85 THEN 'strong' ELSE 'very strong' END AS strength,
  CASE WHEN r > 0 THEN 'positive' WHEN r < 0 THEN 'negative' ELSE 'no' END AS direction"""
VERDICT = """CASE WHEN p_value < 0.001 THEN 'highly significant' WHEN p_value < 0.05 THEN 'significant' ELSE 'not significant' END AS significance,
  p_value < 0.05 AS reject"""


def t_tail(t: str, dof: str, steps: int = 60000) -> str:
    """Two-sided t tail by Simpson over x = sqrt(dof) tan(u), where the density is a power of a cosine."""
    return f"""(WITH a AS (SELECT atan(abs({t}) / sqrt({dof})) AS lo, {dof}::DOUBLE AS d),
  g AS (SELECT lo, d, (pi() / 2 - lo) / {steps} AS h, unnest(range({steps} + 1)) AS i FROM a)
  SELECT 2 * exp(lgamma((max(d) + 1) / 2) - lgamma(max(d) / 2)) / sqrt(pi()) * max(h) / 3
    * sum((CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(greatest(cos(lo + i * h), 0), d - 1)) FROM g)"""


def corr_sql(x: str, y: str, method: str, r: str) -> str:
    return f"""WITH s AS (SELECT (SELECT count(*) FROM lineitem) AS n, {r} AS r),
t AS (SELECT n, r, r * sqrt((n - 2) / (1 - r * r)) AS t FROM s), p AS (SELECT *, {t_tail('t', '(n - 2)')} AS p_value FROM t)
SELECT '{x}' AS x, '{y}' AS y, '{method}' AS method, n, round(r, 6) AS r, round(p_value, 6) AS p_value, {WORDS}, {VERDICT} FROM p"""


def rank_r(x: str, y: str) -> str:
    return f"""(SELECT corr(a, b) FROM (SELECT rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0 AS a,
  rank() OVER (ORDER BY {y}) + (count(*) OVER (PARTITION BY {y}) - 1) / 2.0 AS b FROM lineitem))"""


def kendall_sql(x: str, y: str) -> str:
    def tie(c: str, e: str) -> str:
        return f"(SELECT sum({e}) FROM (SELECT count(*)::DOUBLE AS t FROM lineitem GROUP BY {c}))"
    return f"""WITH s AS (SELECT (SELECT count(*) FROM lineitem) AS n, {kendall(x, y)} AS r),
v AS (SELECT n, r, {tie(x, 't * (t - 1) / 2')} AS xt, {tie(y, 't * (t - 1) / 2')} AS yt,
  {tie(x, 't * (t - 1) * (t - 2)')} AS x0, {tie(y, 't * (t - 1) * (t - 2)')} AS y0,
  {tie(x, 't * (t - 1) * (2 * t + 5)')} AS x1, {tie(y, 't * (t - 1) * (2 * t + 5)')} AS y1, n * (n - 1.0::DOUBLE) AS m FROM s),
z AS (SELECT n, r, r * sqrt(m / 2 - xt) * sqrt(m / 2 - yt) / sqrt((m * (2 * n + 5) - x1 - y1) / 18 + 2 * xt * yt / m + x0 * y0 / (9 * m * (n - 2))) AS z FROM v),
g AS (SELECT n, r, abs(z) AS lo, 12.0::DOUBLE / 4000 AS h, unnest(range(4001)) AS i FROM z),
p AS (SELECT n, r, 2 / sqrt(2 * pi()) * max(h) / 3 * sum((CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
  * exp(-pow(lo + i * h, 2) / 2)) AS p_value FROM g GROUP BY n, r)
SELECT '{x}' AS x, '{y}' AS y, 'kendall' AS method, n, round(r, 6) AS r, round(p_value, 6) AS p_value, {WORDS}, {VERDICT} FROM p"""


def welch_sql(groups: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    return f""", w AS (SELECT {k}a, b, ma AS mean_a, mb AS mean_b, na AS n_a, nb AS n_b, (ma - mb) / sqrt(va / na + vb / nb) AS t_stat,
  pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)) AS dof FROM {groups}),
p AS (SELECT *, {t_tail('t_stat', 'dof')} AS p_value FROM w)
SELECT {k}a, b, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, n_a, n_b, round(t_stat, 6) AS t_stat, round(dof, 3) AS dof,
  round(p_value, 6) AS p_value, {VERDICT} FROM p"""


def q_welch(spark, sf):
    out = rounded(stats.ttest(table(spark, sf, "events"), "value", "event_type"))
    return out.withColumn("dof", F.round("dof", 3))


def q_segment(spark, sf):
    out = stats.ttest_by_segment(table(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag", "l_linestatus")
    return rounded(out).withColumn("dof", F.round("dof", 3))


QUERIES = {
    "descriptive": lambda s, d: rounded(stats.descriptive(table(s, d, "lineitem")), 7),
    "corr_pearson_test": lambda s, d: rounded(stats.correlation(table(s, d, "lineitem"), "l_quantity", "l_extendedprice")),
    "corr_spearman_test": lambda s, d: rounded(stats.correlation(table(s, d, "lineitem"), "l_discount", "l_extendedprice", "spearman")),
    "corr_kendall_test": lambda s, d: rounded(stats.correlation(table(s, d, "lineitem"), "l_discount", "l_tax", "kendall")),
    "mean_ci": lambda s, d: rounded(stats.confidence_interval(table(s, d, "events"), "value")),
    "welch_ttest": q_welch,
    "welch_ttest_by_segment": q_segment,
    "chi_square": lambda s, d: rounded(stats.chi_square(table(s, d, "lineitem"), "l_returnflag", "l_linestatus")),
    "chi_square_missing": lambda s, d: rounded(stats.chi_square(dirty_orders(s, d), "o_orderstatus", "is_gift")),
    "anova": lambda s, d: rounded(stats.anova(table(s, d, "events"), "value", "event_type")),
    "anova_brands": lambda s, d: rounded(stats.anova(table(s, d, "part"), "p_retailprice", "p_brand")),
    "anova_groups": lambda s, d: rounded(stats.anova_groups(dirty_orders(s, d), "o_totalprice", "o_orderpriority"), 2),
}


def chi_sql(with_: str, source: str, x: str, y: str) -> str:
    return f"""{with_} c AS (SELECT {x} AS x, {y} AS y, count(*)::DOUBLE AS o FROM {source} GROUP BY 1, 2),
f AS (SELECT x, y, coalesce(o, 0) AS o FROM (SELECT DISTINCT x FROM c) CROSS JOIN (SELECT DISTINCT y FROM c) LEFT JOIN c USING (x, y)),
e AS (SELECT *, sum(o) OVER (PARTITION BY x) * sum(o) OVER (PARTITION BY y) / sum(o) OVER () AS e FROM f),
d AS (SELECT count(DISTINCT x) AS nr, count(DISTINCT y) AS nc, (count(DISTINCT x) - 1) * (count(DISTINCT y) - 1) AS dof FROM e),
s AS (SELECT sum(pow(abs(o - e) - CASE WHEN dof = 1 THEN least(0.5, abs(o - e)) ELSE 0 END, 2) / e) AS chi2, max(dof) AS dof,
  max(nr) AS n_rows, max(nc) AS n_cols, count(*) FILTER (WHERE e < 5) > 0.2 * count(*) AS small_expected FROM e, d),
g AS (SELECT *, sqrt(chi2) AS lo, (sqrt(chi2) + 12 - sqrt(chi2)) / 8000.0::DOUBLE AS h, unnest(range(8001)) AS i FROM s),
p AS (SELECT chi2, dof, n_rows, n_cols, small_expected,
  2 / exp(dof / 2.0 * ln(2) + lgamma(dof / 2.0)) * max(h) / 3 * sum((CASE WHEN i = 0 OR i = 8000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
    * pow(lo + i * h, dof - 1) * exp(-pow(lo + i * h, 2) / 2)) AS p_value FROM g GROUP BY chi2, dof, n_rows, n_cols, small_expected)
SELECT round(chi2, 6) AS chi2, dof, round(p_value, 6) AS p_value, n_rows, n_cols, small_expected, {VERDICT} FROM p"""


def anova_sql(source: str, value: str, group: str) -> str:
    return f"""WITH g AS (SELECT {group} AS g, count({value}) AS n, avg({value}) AS m, var_samp({value}) AS v FROM {source} GROUP BY 1 HAVING count({value}) >= 2),
t AS (SELECT sum(n * m) / sum(n) AS c FROM g),
s AS (SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS n, (count(*) - 1)::DOUBLE AS d1, (sum(n) - count(*))::DOUBLE AS d2,
  (sum(n * pow(m - c, 2)) / (count(*) - 1)) / (sum((n - 1) * v) / (sum(n) - count(*))) AS f FROM g, t),
i AS (SELECT *, asin(sqrt(d2 / (d2 + d1 * f))) / 20000 AS h, unnest(range(20001)) AS i FROM s),
p AS (SELECT groups, n, f AS f_stat, d1, d2, 2 * exp(lgamma((d1 + d2) / 2) - lgamma(d1 / 2) - lgamma(d2 / 2)) * max(h) / 3
  * sum((CASE WHEN i = 0 OR i = 20000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(sin(i * h), d2 - 1) * pow(cos(i * h), d1 - 1)) AS p_value FROM i GROUP BY groups, n, f, d1, d2)
SELECT groups, n, round(f_stat, 6) AS f_stat, round(p_value, 6) AS p_value, d1, d2, false AS truncated, {VERDICT} FROM p"""


ORACLE = {
    "descriptive": union_sql([f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 7) AS mean, round(stddev_samp({c}), 7) AS std,
  round(min({c})::DOUBLE, 7) AS min, """ + ", ".join(
        f"round(quantile_cont({c}::DOUBLE, {p}), 7) AS {n}" for n, p in stats.FIVE_NUMBERS.items())
        + f""", round(max({c})::DOUBLE, 7) AS max, round(skewness({c}), 7) AS skew, round(kurtosis({c}), 7) AS kurtosis,
  count(*) - count({c}) AS missing FROM lineitem""" for c in LINE_NUM]),
    "corr_pearson_test": corr_sql("l_quantity", "l_extendedprice", "pearson", "(SELECT corr(l_quantity, l_extendedprice) FROM lineitem)"),
    "corr_spearman_test": corr_sql("l_discount", "l_extendedprice", "spearman", rank_r("l_discount", "l_extendedprice")),
    "corr_kendall_test": kendall_sql("l_discount", "l_tax"),
    # t quantile by its expansion around the normal quantile; exact to 1e-12 at this many degrees of freedom
    "mean_ci": """WITH s AS (SELECT count(value) AS n, avg(value) AS m, stddev_samp(value) / sqrt(count(value)) AS se,
  1.959963984540054::DOUBLE AS z, (count(value) - 1)::DOUBLE AS d FROM events),
t AS (SELECT *, z + (pow(z, 3) + z) / (4 * d) + (5 * pow(z, 5) + 16 * pow(z, 3) + 3 * z) / (96 * d * d)
  + (3 * pow(z, 7) + 19 * pow(z, 5) + 17 * pow(z, 3) - 15 * z) / (384 * pow(d, 3)) AS t FROM s)
SELECT 'value' AS "column", 0.95::DOUBLE AS level, round(m, 6) AS mean, n, round(m - t * se, 6) AS ci_low, round(m + t * se, 6) AS ci_high FROM t""",
    "welch_ttest": """WITH g AS (SELECT event_type AS g, count(value) AS n, avg(value) AS m, var_samp(value) AS v,
  row_number() OVER (ORDER BY count(value) DESC, event_type) AS k FROM events GROUP BY 1),
x AS (SELECT a.g AS a, b.g AS b, a.m AS ma, b.m AS mb, a.n AS na, b.n AS nb, a.v AS va, b.v AS vb FROM g a, g b WHERE a.k = 1 AND b.k = 2)"""
    + welch_sql("x"),
    "welch_ttest_by_segment": """WITH g AS (SELECT l_linestatus AS segment, l_returnflag AS g, count(*) AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v,
  row_number() OVER (PARTITION BY l_linestatus ORDER BY count(*) DESC, l_returnflag) AS k FROM lineitem GROUP BY 1, 2),
x AS (SELECT a.segment, a.g AS a, b.g AS b, a.m AS ma, b.m AS mb, a.n AS na, b.n AS nb, a.v AS va, b.v AS vb
  FROM g a JOIN g b ON a.segment = b.segment AND a.k = 1 AND b.k = 2)""" + welch_sql("x", "segment"),
    "chi_square": chi_sql("WITH", "lineitem", "l_returnflag", "l_linestatus"),
    "chi_square_missing": chi_sql(WITH_DIRTY + ", ", "dirty", "coalesce(o_orderstatus, 'nan')", "is_gift::VARCHAR"),
    "anova": anova_sql("events", "value", "event_type"),
    "anova_brands": anova_sql("part", "p_retailprice", "p_brand"),
    "anova_groups": WITH_DIRTY + """SELECT coalesce(o_orderpriority, 'nan') AS "group", count(o_totalprice) AS n, round(avg(o_totalprice), 2) AS mean,
  round(var_samp(o_totalprice), 2) AS var FROM dirty WHERE o_totalprice IS NOT NULL GROUP BY 1 HAVING count(o_totalprice) >= 2""",
}
