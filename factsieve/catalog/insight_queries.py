"""Registered queries: insights, answers, report tables."""

from __future__ import annotations

from factsieve.catalog.chart_queries import pair_sql
from factsieve.catalog.inputs import WITH_DIRTY, dirty_orders, table
from factsieve.catalog.profile_queries import DIRTY, DUP_SQL, role_sql
from factsieve.catalog.quality_queries import outlier_sql
from factsieve.catalog.shape import rounded, union_sql
from factsieve.operators import answers, insights, report, trends
from factsieve.plans.facts import Facts

NUM = ["o_orderkey", "o_custkey", "o_totalprice"]


def rule(fn, source=dirty_orders):
    return lambda s, d: fn(Facts(source(s, d))).drop("pos")


def nation(s, d):
    return table(s, d, "nation")


def third_sql(source: str, t: str, y: str) -> str:
    """n, early and recent mean; rows at the bounding time count in proportion."""
    return f"""(WITH d AS (SELECT {t} AS t, {y}::DOUBLE AS y FROM {source} WHERE {t} IS NOT NULL AND {y} IS NOT NULL),
  k AS (SELECT count(*) AS n, greatest(1, count(*) // 3) AS k FROM d),
  g AS (SELECT t, count(*) AS c, avg(y) AS m FROM d GROUP BY t),
  o AS (SELECT *, coalesce(sum(c) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a,
    coalesce(sum(c) OVER (ORDER BY t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM g)
  SELECT '{y}' AS "column", max(n) AS n, sum(m * greatest(0, least(c, k - a))) / max(k) AS e, sum(m * greatest(0, least(c, k - b))) / max(k) AS r FROM o, k)"""


def row_sql(kind: str, title: str, columns: str, severity: str, metric: str, source: str) -> str:
    return f"SELECT '{kind}' AS kind, {title} AS title, {columns} AS columns, {severity} AS severity, ({metric})::DOUBLE AS metric FROM {source}"


FACTS = WITH_DIRTY + ", roles AS (" + role_sql() + "), f AS (" + union_sql([
    f"""SELECT '{c}' AS "column", {i} AS pos, count(*) AS n, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS u FROM dirty"""
    for i, c in enumerate(DIRTY)]) + "), tops AS (" + union_sql([
        f"""(SELECT '{c}' AS "column", {c}::VARCHAR AS v, count(*) AS k FROM dirty WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY 3 DESC, {c} LIMIT 1)"""
        for c in DIRTY]) + ") "

MISSING = row_sql("missing", "concat('''', \"column\", ''' lacks values')", '"column"',
                  "CASE WHEN missing * 100.0 / n >= 5 THEN 'warning' ELSE 'info' END", "round(missing * 100.0::DOUBLE / n, 2)",
                  "(SELECT * FROM f WHERE missing > 0 ORDER BY missing DESC, pos LIMIT 3)")
DOMINANCE = row_sql("dominance", "concat('Most rows of ''', \"column\", ''' hold ''', v, '''')", '"column"', "'info'",
                    "round(k * 100.0::DOUBLE / (n - missing), 1)",
                    "f JOIN roles USING (\"column\") JOIN tops USING (\"column\") WHERE role IN ('categorical', 'boolean') AND k >= 0.6 * (n - missing)")
SKEWED = " UNION ALL ".join(row_sql(
    "distribution", f"concat('''{c}'' has a long ', CASE WHEN s > 0 THEN 'right' ELSE 'left' END, ' tail')", f"'{c}'", "'info'", "round(s, 3)",
    f"(SELECT skewness({c}) AS s FROM dirty) WHERE abs(s) >= 1") for c in NUM)
OUTLIERS = row_sql("outliers", "concat('''', \"column\", ''' has values far off its quartiles')", '"column"', "'warning'", "outliers",
                   "(SELECT *, list_position(['o_orderkey', 'o_custkey', 'o_totalprice'], \"column\") AS p FROM ("
                   + outlier_sql(NUM, "dirty") + ") WHERE n >= 20 AND outliers >= greatest(5, 0.02 * n) ORDER BY p LIMIT 1)")
DUPLICATES = row_sql("duplicates", "'Some rows occur more than once'", "''", "CASE WHEN d >= 0.01 * n THEN 'warning' ELSE 'info' END", "d",
                     f"(SELECT {DUP_SQL} AS d, (SELECT count(*) FROM dirty) AS n) WHERE d > 0")
IDENTIFIER = row_sql("identifier", "concat('''', \"column\", ''' tells all rows apart')", '"column"', "'info'", "u",
                     "(SELECT * FROM f JOIN roles USING (\"column\") WHERE role IN ('categorical', 'text') AND u = n AND n > 5 ORDER BY f.pos LIMIT 1)")


def trend_insight(source: str, t: str, columns: list[str]) -> str:
    return row_sql("trend", "concat('\'\'', \"column\", '\'\' ', CASE WHEN r > e THEN 'rose' ELSE 'fell' END, ' between its first and its last third')",
                   f"concat('{t},', \"column\")", "'info'", "round(100 * (r - e) / abs(e), 1)",
                   "(SELECT * FROM (" + union_sql([f"SELECT {i} AS p, * FROM {third_sql(source, t, c)}" for i, c in enumerate(columns)])
                   + ") WHERE n >= 12 AND e <> 0 AND abs(100 * (r - e) / abs(e)) >= 20 ORDER BY p LIMIT 1)")


def corr_rows(columns: list[str], source: str) -> str:
    return f"""(SELECT *, row_number() OVER (ORDER BY abs(r) DESC, x, y) AS k, max(abs(r)) OVER () AS best FROM ({pair_sql(columns, source,
        lambda x, y: f"corr({x}, {y})")}))"""


def corr_insight(columns: list[str], source: str) -> str:
    title = """CASE WHEN abs(r) >= 0.5 THEN concat(x, ' ~ ', y, ': a ', CASE WHEN abs(r) >= 0.85 THEN 'close' WHEN abs(r) >= 0.7 THEN 'clear'
  ELSE 'visible' END, ', ', CASE WHEN r > 0 THEN 'rising' ELSE 'falling' END, ' line') ELSE 'No two numbers move together' END"""
    return row_sql("correlation", title, "concat(x, ',', y)", "'info'", "round(r, 4)",
                   corr_rows(columns, source) + " WHERE k <= 3 AND (abs(r) >= 0.5 OR (k = 1 AND best < 0.3))")


def gap_insight(source: str, nums: list[str], cats: list[str]) -> str:
    parts = [f"""SELECT {i} AS p, {j} AS q, '{n}' AS c, '{g}' AS g, (max(m) - min(m)) / max(s) AS gap
  FROM (SELECT coalesce({g}::VARCHAR, 'nan') AS g, avg({n}) AS m FROM {source} GROUP BY 1), (SELECT stddev_samp({n}) AS s FROM {source}) HAVING count(m) >= 2"""
             for i, n in enumerate(nums) for j, g in enumerate(cats)]
    return row_sql("group_difference", "concat('The mean of ''', c, ''' moves with ''', g, '''')", "concat(c, ',', g)", "'info'", "round(gap, 2)",
                   "(SELECT *, row_number() OVER (PARTITION BY p ORDER BY q) AS k FROM (" + union_sql(parts) + ") WHERE gap >= 1) WHERE k = 1")


def describe_sql() -> str:
    parts = []
    for c in DIRTY:
        num = c in NUM
        n = (lambda e: f"round({e}, 6)") if num else (lambda e: "NULL::DOUBLE")
        other = not num and c != "o_orderdate" and c != "raw_date"
        parts.append(f"""SELECT '{c}' AS "column", count({c}) AS count, {f'count(DISTINCT {c})' if other else 'NULL::BIGINT'} AS "unique",
  {f"(SELECT v FROM tops WHERE \"column\" = '{c}')" if other else 'NULL::VARCHAR'} AS top,
  {f"(SELECT k FROM tops WHERE \"column\" = '{c}')" if other else 'NULL::BIGINT'} AS freq,
  {n(f'avg({c})')} AS mean, {n(f'stddev_samp({c})')} AS std, {n(f'min({c})::DOUBLE')} AS min, {n(f'quantile_cont({c}::DOUBLE, 0.25)')} AS q1,
  {n(f'quantile_cont({c}::DOUBLE, 0.5)')} AS median, {n(f'quantile_cont({c}::DOUBLE, 0.75)')} AS q3, {n(f'max({c})::DOUBLE')} AS max FROM dirty""")
    return FACTS + union_sql(parts)


QUERIES = {
    "insight_correlation": rule(insights.correlation),
    "insight_missing": rule(insights.missing),
    "insight_dominance": rule(insights.dominance),
    "insight_skew": rule(insights.skewed),
    "insight_group_gap": rule(insights.group_gap, nation),
    "insight_trend": rule(insights.trend, lambda s, d: table(s, d, "events").select("value", "event_id", "user_id", "ts")),
    "insight_outliers": rule(insights.outliers, lambda s, d: table(s, d, "events").select("event_id", "value", "event_type")),
    "insight_duplicates": rule(insights.duplicates),
    "insight_identifier": rule(insights.identifier, lambda s, d: table(s, d, "customer")),
    "insights": lambda s, d: insights.insights(dirty_orders(s, d), limit=12, numbers=3, groups=2),
    "column_aggregate": lambda s, d: rounded(answers.column_aggregate(table(s, d, "lineitem"), "l_extendedprice"), 2),
    "top_groups": lambda s, d: rounded(answers.top_groups(table(s, d, "part"), "p_brand", "p_retailprice"), 4),
    "missing_columns": lambda s, d: answers.missing_columns(dirty_orders(s, d)),
    "trend_thirds": lambda s, d: rounded(trends.trend_thirds(table(s, d, "lineitem"), "l_shipdate", ["l_quantity", "l_extendedprice"]), 4),
    "outlier_records": lambda s, d: rounded(answers.outlier_records(table(s, d, "events"), "value", ["event_id"])),
    "describe_all": lambda s, d: rounded(report.describe_all(dirty_orders(s, d))),
    "report_facts": lambda s, d: report.report_facts(dirty_orders(s, d), [{"op": "remove_duplicates"}]),
}

ORACLE = {
    "insight_correlation": WITH_DIRTY + corr_insight(NUM, "dirty"),
    "insight_missing": FACTS + MISSING,
    "insight_dominance": FACTS + DOMINANCE,
    "insight_skew": WITH_DIRTY + SKEWED,
    "insight_group_gap": gap_insight("nation", ["n_nationkey", "n_regionkey"], ["n_name"]),
    "insight_trend": trend_insight("events", "ts", ["value", "event_id", "user_id"]),
    "insight_outliers": row_sql("outliers", "concat('''', \"column\", ''' has values far off its quartiles')", '"column"', "'warning'", "outliers",
                                "(SELECT * FROM (" + outlier_sql(["event_id", "value"], "events") + ") WHERE n >= 20 AND outliers >= greatest(5, 0.02 * n) ORDER BY \"column\" LIMIT 1)"),
    "insight_duplicates": WITH_DIRTY + DUPLICATES,
    "insight_identifier": row_sql("identifier", "'''c_name'' tells all rows apart'", "'c_name'", "'info'", "u",
                                  "(SELECT count(*) AS n, count(DISTINCT c_name) AS u FROM customer) WHERE u = n AND n > 5"),
    "insights": FACTS + ", i AS (" + union_sql([corr_insight(NUM, "dirty"), MISSING, DOMINANCE, SKEWED, gap_insight(
        "dirty", NUM, ["o_orderpriority", "o_orderstatus"]), trend_insight("dirty", "o_orderdate", NUM), OUTLIERS, DUPLICATES, IDENTIFIER])
        + ") SELECT * FROM i ORDER BY CASE severity WHEN 'warning' THEN 0 ELSE 1 END, kind, title LIMIT 12",
    "column_aggregate": """SELECT 'l_extendedprice' AS "column", count(*) AS n, round(avg(l_extendedprice), 2) AS mean, round(median(l_extendedprice), 2) AS median,
  round(sum(l_extendedprice), 2) AS sum, round(min(l_extendedprice), 2) AS min, round(max(l_extendedprice), 2) AS max FROM lineitem""",
    "top_groups": "SELECT p_brand AS \"group\", round(avg(p_retailprice), 4) AS mean FROM part GROUP BY 1 ORDER BY avg(p_retailprice) DESC, 1 LIMIT 10",
    "missing_columns": WITH_DIRTY + "SELECT * FROM (" + union_sql([
        f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing, round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS missing_pct FROM dirty"""
        for c in DIRTY]) + ") WHERE missing > 0 ORDER BY missing DESC, \"column\" LIMIT 20",
    "trend_thirds": "SELECT \"column\", n, round(e, 4) AS early_mean, round(r, 4) AS recent_mean, round(100 * (r - e) / abs(e), 4) AS pct_change, "
                    "CASE WHEN r > e THEN 'up' WHEN r < e THEN 'down' ELSE 'flat' END AS direction FROM ("
                    + union_sql([f"SELECT * FROM {third_sql('lineitem', 'l_shipdate', c)}" for c in ("l_quantity", "l_extendedprice")]) + ")",
    "outlier_records": """WITH f AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
SELECT event_id, round(value, 6) AS value FROM events, f WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a) ORDER BY event_id LIMIT 20""",
    "describe_all": describe_sql(),
}
