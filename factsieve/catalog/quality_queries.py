"""Registered queries: data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from factsieve.catalog.inputs import WITH_DIRTY, dirty_orders, table
from factsieve.catalog.profile_queries import DIRTY, DIRTY_TEXT, DUP_SQL, role_sql
from factsieve.catalog.shape import rounded, union_sql
from factsieve.operators import quality

NUM = ["o_orderkey", "o_custkey", "o_totalprice"]
STRIP = r"'^\s+|\s+$', '', 'g'"
# the five lexical classes, as RE2 patterns
LEX = [("int", r"^\s*[+-]?\d+\s*$"),
       ("float", r"^\s*[+-]?(\d+\.\d*|\.\d+|\d+[eE][+-]?\d+|\d+\.\d*[eE][+-]?\d+)\s*$"),
       ("date", r"^\s*(\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4})([ T]\d{1,2}:\d{2}.*)?\s*$"),
       ("bool", r"^\s*(?i:true|false|yes|no)\s*$")]


def lex_sql(c: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, '{p}') THEN '{k}'" for k, p in LEX) + " ELSE 'text' END"


def outlier_sql(columns: list[str], source: str) -> str:
    parts = []
    for c in columns:
        parts.append(f"""SELECT '{c}' AS "column", f.n, f.q1, f.q3, f.q1 - 1.5 * (f.q3 - f.q1) AS low, f.q3 + 1.5 * (f.q3 - f.q1) AS high,
  count(*) FILTER (WHERE f.n >= 8 AND f.q3 <> f.q1 AND ({c} < f.q1 - 1.5 * (f.q3 - f.q1) OR {c} > f.q3 + 1.5 * (f.q3 - f.q1))) AS outliers
  FROM {source}, (SELECT count({c}) AS n, quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM {source}) f
  GROUP BY ALL""")
    return union_sql(parts)


def text_sql(columns: list[str], source: str) -> str:
    parts = []
    for c in columns:
        bare = f"regexp_replace({c}, {STRIP})"
        lex = ", ".join(f"count(*) FILTER (WHERE k = '{k}') AS n_{k}" for k in ["int", "float", "date", "bool", "text"])
        parts.append(f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE v <> b) AS padded, count(DISTINCT b) AS n_stripped,
  count(DISTINCT lower(b)) AS n_folded, {lex}
  FROM (SELECT {c} AS v, {bare} AS b, {lex_sql(c)} AS k FROM {source} WHERE {c} IS NOT NULL) HAVING count(*) > 0""")
    return union_sql(parts)


CHECKS = WITH_DIRTY + ", roles AS (" + role_sql() + "), base_facts AS (" + union_sql([
    f"""SELECT '{c}' AS "column", count(*) AS n, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS u FROM dirty""" for c in DIRTY]) + \
    "), outl AS (" + outlier_sql(NUM, "dirty") + "), txt AS (" + text_sql(DIRTY_TEXT, "dirty") + """), c AS (
SELECT "column", role, f.n, missing, u, missing * 100.0::DOUBLE / f.n AS share, outliers, outliers * 1.0::DOUBLE / f.n AS osh, padded,
  (missing = f.n) AS is_empty, coalesce(u <= 1 AND missing < f.n, false) AS is_constant,
  (role = 'categorical' AND u > 50 AND u / f.n > 0.1) AS is_highcard,
  coalesce(outliers > 0 AND outliers / f.n >= 0.01, false) AS is_outliers,
  coalesce(role IN ('categorical', 'text') AND padded > 0, false) AS is_whitespace,
  coalesce(role IN ('categorical', 'text') AND n_stripped > n_folded, false) AS is_case,
  coalesce(CAST(n_int > 0 AS INT) + CAST(n_float > 0 AS INT) + CAST(n_date > 0 AS INT) + CAST(n_bool > 0 AS INT) + CAST(n_text > 0 AS INT) > 1, false) AS is_mixed
FROM base_facts f JOIN roles USING ("column") LEFT JOIN (SELECT "column", outliers FROM outl) USING ("column") LEFT JOIN txt USING ("column")) """

PCT = "format('{:.1f}', share)"
MISSING_TITLE = f"concat('''', \"column\", ''': ', {PCT}, ' % of the rows lack a value')"
ISSUES = CHECKS + f""", i AS (
SELECT 'empty' AS kind, "column", 'high' AS severity, concat('''', "column", ''': no value in any row') AS title, 'drop_column' AS actions FROM c WHERE is_empty
UNION ALL SELECT 'excessive_missing', "column", 'high', {MISSING_TITLE}, 'fill_median,fill_mode,drop_column,drop_rows' FROM c WHERE NOT is_empty AND share >= 40
UNION ALL SELECT 'missing', "column", CASE WHEN share < 20 THEN 'medium' ELSE 'high' END, {MISSING_TITLE},
  'fill_mean,fill_median,fill_mode,ffill,bfill,drop_rows' FROM c WHERE share >= 5 AND share < 40
UNION ALL SELECT 'missing_small', "column", 'low', concat('''', "column", ''': ', missing, ' rows lack a value, ', {PCT}, ' % of all'),
  'fill_median,fill_mode,drop_rows' FROM c WHERE share > 0 AND share < 5
UNION ALL SELECT 'constant', "column", 'medium', concat('''', "column", ''': one value only'), 'drop_column' FROM c WHERE is_constant
UNION ALL SELECT 'highcard', "column", 'medium', concat('''', "column", ''': ', u, ' different labels, too many to compare'), 'drop_column' FROM c WHERE is_highcard
UNION ALL SELECT 'outliers', "column", CASE WHEN osh < 0.05 THEN 'low' ELSE 'medium' END,
  concat('''', "column", ''': ', outliers, ' values beyond the quartile fences'), 'cap_outliers,drop_outliers' FROM c WHERE is_outliers
UNION ALL SELECT 'whitespace', "column", 'low', concat('''', "column", ''': ', padded, ' values begin or end with white space'), 'trim_whitespace' FROM c WHERE is_whitespace
UNION ALL SELECT 'case', "column", 'low', concat('''', "column", ''': labels differ by letter case alone'), 'standardize_case' FROM c WHERE is_case
UNION ALL SELECT 'mixed', "column", 'medium', concat('''', "column", ''': values of several kinds'), 'convert_dtype' FROM c WHERE is_mixed
UNION ALL SELECT 'duplicate_rows', '', CASE WHEN d / n < 0.05 THEN 'medium' ELSE 'high' END, concat(d, ' rows repeat an earlier row'), 'remove_duplicates'
  FROM (SELECT {DUP_SQL} AS d, (SELECT count(*) FROM dirty) AS n) WHERE d > 0) """

FLAG_SQL = "concat_ws(',', " + ", ".join(f"CASE WHEN {cond} THEN '{flag}' END" for cond, flag in [
    ("is_empty", "empty_column"), ("NOT is_empty AND share >= 40", "excessive_missing"),
    ("share >= 5 AND share < 40", "missing"), ("share > 0 AND share < 5", "missing_small"), ("is_constant", "constant"),
    ("is_highcard", "high_cardinality"), ("is_outliers", "outliers"), ("is_whitespace", "whitespace"),
    ("is_case", "case_inconsistent"), ("is_mixed", "mixed_types")]) + ")"
DTYPES = ("CASE \"column\" WHEN 'o_orderkey' THEN 'bigint' WHEN 'o_custkey' THEN 'bigint' WHEN 'o_totalprice' THEN 'double' "
          "WHEN 'o_orderdate' THEN 'timestamp_ntz' WHEN 'is_gift' THEN 'boolean' ELSE 'string' END")

DOCS = ["text", "lang", "source"]

QUERIES = {
    "quality_columns": lambda s, d: quality.Quality(dirty_orders(s, d)).columns(),
    "quality_issues": lambda s, d: quality.Quality(dirty_orders(s, d)).issues(),
    "severity_counts": lambda s, d: quality.Quality(dirty_orders(s, d)).severity_counts(),
    "quality_score": lambda s, d: rounded(quality.Quality(dirty_orders(s, d)).score(), 4),
    "iqr_outliers": lambda s, d: rounded(quality.iqr_outliers(table(s, d, "events"), ["event_id", "user_id", "value"])),
    "whitespace_values": lambda s, d: quality.whitespace_values(dirty_orders(s, d)),
    "case_inconsistency": lambda s, d: quality.case_inconsistency(dirty_orders(s, d)),
    "mixed_types": lambda s, d: quality.mixed_types(dirty_orders(s, d)),
    "document_text_checks": lambda s, d: quality.text_checks(table(s, d, "documents"), DOCS).drop("n"),
}

ORACLE = {
    "quality_columns": CHECKS + f"""SELECT "column", role, missing, round(share, 2) AS missing_pct, u AS n_distinct,
  {DTYPES} AS dtype, {FLAG_SQL} AS flags, outliers FROM c""",
    "quality_issues": ISSUES + """SELECT * FROM i ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, title LIMIT 120""",
    "severity_counts": ISSUES + "SELECT severity, count(*) AS issues FROM i GROUP BY severity",
    "quality_score": CHECKS + f""", s AS (SELECT sum(missing) * 100.0::DOUBLE / (max(n) * count(*)) AS miss,
  CAST(sum(5 * CAST(is_empty AS INT) + 3 * CAST(is_constant AS INT) + 4 * CAST(NOT is_empty AND share >= 40 AS INT)
      + 2 * CAST(is_mixed AS INT) + CAST(is_outliers AS INT)) AS DOUBLE) AS penalty,
  {DUP_SQL} * 100.0::DOUBLE / max(n) AS dup FROM c)
SELECT round(greatest(5.0::DOUBLE, least(100.0::DOUBLE, round(100 - least(35, 1.2 * miss) - least(15, 2 * dup) - penalty, 1))), 4) AS score,
  round(dup, 2) AS duplicate_pct, round(miss, 2) AS missing_pct, penalty FROM s""",
    "iqr_outliers": "SELECT \"column\", n, round(q1, 6) AS q1, round(q3, 6) AS q3, round(low, 6) AS low, round(high, 6) AS high, outliers FROM ("
                    + outlier_sql(["event_id", "user_id", "value"], "events") + ")",
    "whitespace_values": WITH_DIRTY + "SELECT \"column\", padded AS padded_values FROM (" + text_sql(DIRTY_TEXT, "dirty") + ")",
    "case_inconsistency": WITH_DIRTY + "SELECT \"column\", n_stripped, n_folded, n_stripped > n_folded AS inconsistent FROM ("
                          + text_sql(DIRTY_TEXT, "dirty") + ")",
    "mixed_types": WITH_DIRTY + "SELECT \"column\", n_int, n_float, n_date, n_bool, n_text, "
                   "CAST(n_int > 0 AS INT) + CAST(n_float > 0 AS INT) + CAST(n_date > 0 AS INT) + CAST(n_bool > 0 AS INT) + CAST(n_text > 0 AS INT) > 1 AS mixed FROM ("
                   + text_sql(DIRTY_TEXT, "dirty") + ")",
    "document_text_checks": text_sql(DOCS, "documents"),
}
