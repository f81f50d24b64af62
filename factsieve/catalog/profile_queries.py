"""Registered queries: sources, roles, profiles, browsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from factsieve.catalog.inputs import WITH_BASE, WITH_DATED, WITH_DIRTY, dated_orders, dirty_base, dirty_orders, table
from factsieve.catalog.shape import rounded, union_sql
from factsieve.operators import browse, profile, roles
from factsieve.plans import dates
from factsieve.catalog import file_checks
from factsieve.sources import files, tables

DIRTY = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus", "o_orderdate", "raw_amount",
         "raw_date", "is_gift", "currency", "empty_note"]
DIRTY_TEXT = ["o_orderpriority", "o_orderstatus", "raw_amount", "raw_date", "currency", "empty_note"]
LINE_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
            "l_tax"]

NUMBER = r"^-?\d+(\.\d+)?$"


def role_sql() -> str:
    """Rows (column, pos, role) of the dirty orders."""
    fixed = {"o_orderkey": "numeric", "o_custkey": "numeric", "o_totalprice": "numeric", "o_orderdate": "datetime",
             "is_gift": "boolean"}
    parts = []
    for i, c in enumerate(DIRTY):
        if c in fixed:
            parts.append(f"SELECT '{c}' AS \"column\", {i} AS pos, '{fixed[c]}' AS role")
            continue
        parts.append(f"""SELECT '{c}' AS "column", {i} AS pos, CASE WHEN count({c}) = 0 THEN 'text'
  WHEN count({c}) >= 3 AND count(TRY_CAST({c} AS TIMESTAMP)) FILTER (WHERE regexp_matches({c}, '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}'))
       >= greatest(3, floor(count({c}) * 0.7))
       AND avg(CASE WHEN regexp_matches(trim({c}), '{NUMBER}') THEN 1.0 ELSE 0.0 END) <= 0.7 THEN 'datetime'
  WHEN count(DISTINCT {c}) / count({c}) > 0.9 AND avg(length({c})) > 24 THEN 'text'
  WHEN count(DISTINCT {c}) > 100 AND count(DISTINCT {c}) / count({c}) > 0.5 THEN 'text'
  ELSE 'categorical' END AS role FROM dirty""")
    return union_sql(parts)


def numeric_sql(columns: list[str], source: str, digits: int = 7) -> str:
    def r(e: str) -> str:
        return f"round({e}, {digits})"
    return union_sql([f"""SELECT '{c}' AS "column", count({c}) AS n, count(*) - count({c}) AS missing,
  {r(f'avg({c})')} AS mean, {r(f'quantile_cont({c}::DOUBLE, 0.5)')} AS median, {r(f'stddev_samp({c})')} AS std,
  {r(f'min({c})::DOUBLE')} AS min, {r(f'max({c})::DOUBLE')} AS max,
  {r(f'quantile_cont({c}::DOUBLE, 0.25)')} AS q1, {r(f'quantile_cont({c}::DOUBLE, 0.75)')} AS q3,
  {r(f'skewness({c})')} AS skew, {r(f'kurtosis({c})')} AS kurtosis FROM {source}""" for c in columns])


def missing_sql(columns: list[str], source: str) -> str:
    return union_sql([f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing,
  round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS missing_pct FROM {source}""" for c in columns])


def distinct_sql(columns: list[str], source: str) -> str:
    return union_sql([f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS n_distinct,
  round(count(DISTINCT {c}) * 100.0::DOUBLE / count(*), 2) AS distinct_pct FROM {source}""" for c in columns])


def top_sql(columns: list[str], source: str, k: int = 10) -> str:
    return union_sql([f"""SELECT * FROM (SELECT '{c}' AS "column",
  row_number() OVER (ORDER BY count(*) DESC, {c}) AS rank, substr({c}::VARCHAR, 1, 120) AS "value",
  count(*) AS count, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM {source}), 2) AS pct
  FROM {source} WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank <= {k}""" for c in columns])


DUP_SQL = "((SELECT count(*) FROM dirty) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)))"
BYTES = {"o_orderkey": "count(*) * 8", "o_custkey": "count(*) * 8", "o_totalprice": "count(o_totalprice) * 8",
         "o_orderdate": "count(o_orderdate) * 8", "is_gift": "count(*)"}


def bytes_sql() -> str:
    return union_sql([
        f"""SELECT '{c}' AS "column", {i} AS pos,
  CAST({BYTES.get(c, f'coalesce(sum(strlen({c})), 0)')} AS BIGINT) AS bytes FROM dirty""" for i, c in enumerate(DIRTY)])


def q_normalized_names(spark, sf):
    raw = table(spark, sf, "nation").toDF(" n_key ", "name", "name")
    return raw.toDF(*tables.normalized_names(raw.columns))


def q_coerce_datetime(spark, sf):
    base = dirty_base(spark, sf).select("o_orderkey", "raw_date", "raw_amount")
    return tables.coerce_datetimes(base, roles.role_map(base)).select("o_orderkey", "raw_date", "raw_amount")


DATED = ["day_first", "month_first", "unclear", "two_conventions", "two_shapes", "no_date"]


def q_date_formats(spark, sf):
    df = dated_orders(spark, sf)
    return dates.date_formats(df, DATED)


def q_typed_dates(spark, sf):
    return tables.load(dated_orders(spark, sf))


def formats_sql() -> str:
    """Votes of the formats that the dated orders hold."""
    known = [(0, "year-month-day", "iso", r"^\d{4}-\d{2}-\d{2}$", "%Y-%m-%d"), (3, "month/day/year", "slash", r"^\d{2}/\d{2}/\d{4}$", "%m/%d/%Y"),
             (4, "day/month/year", "slash", r"^\d{2}/\d{2}/\d{4}$", "%d/%m/%Y"), (9, "day.month.year", "dot", r"^\d{2}\.\d{2}\.\d{4}$", "%d.%m.%Y"),
             (10, "month.day.year", "dot", r"^\d{2}\.\d{2}\.\d{4}$", "%m.%d.%Y")]
    cells = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {i + 1} AS pos, {c} AS x FROM dated" for i, c in enumerate(DATED))
    votes = " UNION ALL ".join(f"""SELECT "column", pos, {place} AS place, '{name}' AS format, '{family}' AS family,
  count(*) FILTER (regexp_matches(x, '{shape}')) AS held, count(*) FILTER (regexp_matches(x, '{shape}') AND try_strptime(x, '{fmt}') IS NOT NULL) AS parsed
  FROM t GROUP BY "column", pos""" for place, name, family, shape, fmt in known)
    return WITH_DATED + f""", t AS ({cells}), v AS ({votes}),
best AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY parsed DESC, place) = 1),
rivals AS (SELECT v."column", v.format, v.parsed FROM v JOIN best USING ("column") WHERE v.family = best.family AND v.format <> best.format
  AND v.parsed > 0 QUALIFY row_number() OVER (PARTITION BY v."column" ORDER BY v.parsed DESC, v.place) = 1),
others AS (SELECT v."column", sum(v.parsed) AS parsed FROM v JOIN best USING ("column") WHERE v.family <> best.family GROUP BY ALL),
n AS (SELECT "column", count(x) AS n FROM t GROUP BY ALL)
SELECT b."column", b.pos, n.n, CASE WHEN b.parsed > 0 THEN b.format END AS format, b.parsed, n.n - b.parsed AS unread,
  CASE WHEN b.parsed = 0 THEN 'none' WHEN o.parsed > 0 OR (b.held > b.parsed AND r.format IS NOT NULL) THEN 'mixed'
       WHEN r.parsed = b.parsed THEN 'ambiguous' ELSE 'clear' END AS status, CASE WHEN b.parsed > 0 THEN r.format END AS rival
FROM best b JOIN n USING ("column") LEFT JOIN rivals r USING ("column") LEFT JOIN others o USING ("column")"""


def typed_dates_sql() -> str:
    def chosen(c: str) -> str:
        m, d = f"try_strptime({c}, '%m/%d/%Y')", f"try_strptime({c}, '%d/%m/%Y')"
        return f"CASE WHEN (SELECT count({m}) >= count({d}) FROM dated) THEN {m} ELSE {d} END AS {c}"
    return WITH_DATED + ("SELECT o_orderkey, " + ", ".join(chosen(c) for c in DATED[:4])
                         + ", try_strptime(two_shapes, '%d.%m.%Y') AS two_shapes, no_date FROM dated")


def q_dataset_summary(spark, sf):
    return profile.dataset_summary(dirty_orders(spark, sf))


def q_full_profile(spark, sf):
    found = profile.full_profile(dirty_orders(spark, sf), order_by=["o_orderkey"])
    top = F.array_join(F.transform("top_values", lambda t: F.concat_ws("=", t["value"], t["count"])), "|")
    return rounded(found.select(
        "column", "role", "type", "count", "missing", "missing_pct", "n_distinct", "distinct_pct", "mean", "median", "std",
        "min", "max", "q1", "q3", "skew", "kurtosis", "first", "last", "mode", "mode_count", "truncated",
        F.coalesce(F.when(F.col("type") != "double", top), F.lit("")).alias("top_values"), F.array_join("sample", "|").alias("sample")))


TYPES = {c: "bigint" if c in ("o_orderkey", "o_custkey") else "double" if c == "o_totalprice" else "timestamp_ntz" if c == "o_orderdate"
         else "boolean" if c == "is_gift" else "string" for c in DIRTY}


def full_profile_sql() -> str:
    parts = []
    for c in DIRTY:
        num = c in ("o_orderkey", "o_custkey", "o_totalprice")
        time = c == "o_orderdate"
        n = (lambda e: f"round({e}, 6)") if num else (lambda e: "NULL::DOUBLE")
        t = (lambda e: e) if time else (lambda e: "NULL::TIMESTAMP")
        parts.append(f"""SELECT '{c}' AS "column", count({c}) AS count, count(*) - count({c}) AS missing,
  round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS missing_pct, count(DISTINCT {c}) AS n_distinct,
  round(count(DISTINCT {c}) * 100.0::DOUBLE / count(*), 2) AS distinct_pct,
  {n(f'avg({c})')} AS mean, {n(f'quantile_cont({c}::DOUBLE, 0.5)')} AS median, {n(f'stddev_samp({c})')} AS std,
  {n(f'min({c})::DOUBLE')} AS min, {n(f'max({c})::DOUBLE')} AS max, {n(f'skewness({c})')} AS skew, '{TYPES[c]}' AS type,
  {n(f'quantile_cont({c}::DOUBLE, 0.25)')} AS q1, {n(f'quantile_cont({c}::DOUBLE, 0.75)')} AS q3,
  (SELECT {c}::VARCHAR FROM dirty WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS mode,
  coalesce((SELECT string_agg(concat_ws('=', v, k), '|' ORDER BY k DESC, x) FROM (SELECT {c} AS x, {c}::VARCHAR AS v, count(*) AS k FROM dirty
    WHERE {c} IS NOT NULL AND {c != "o_totalprice"} GROUP BY {c} ORDER BY k DESC, x LIMIT 10)), '') AS top_values,
  (SELECT string_agg(v, '|' ORDER BY o, v) FROM (SELECT o_orderkey AS o, {c}::VARCHAR AS v FROM dirty WHERE {c} IS NOT NULL ORDER BY o, v LIMIT 5)) AS sample,
  {n(f'kurtosis({c})')} AS kurtosis, {t(f'min({c})')} AS first, {t(f'max({c})')} AS last,
  (SELECT max(k) FROM (SELECT count(*) AS k FROM dirty WHERE {c} IS NOT NULL GROUP BY {c})) AS mode_count,
  false AS truncated FROM dirty""")
    return (WITH_DIRTY + ", roles AS (" + role_sql() + "), p AS (" + union_sql(parts)
            + ') SELECT p.*, roles.role FROM p JOIN roles USING ("column")')


def q_value_sample(spark, sf):
    return profile.value_sample(dirty_base(spark, sf),
                                ["o_orderpriority", "o_orderstatus", "raw_amount", "raw_date"], ["o_orderkey"])


def q_search(spark, sf):
    return browse.search_rows(table(spark, sf, "customer"), " BUILD ").select("c_custkey", "c_name", "c_mktsegment")


def q_sort(spark, sf):
    rows = browse.sort_rows(dirty_base(spark, sf), "o_totalprice", ["o_orderkey"], descending=True)
    return rows.select("o_orderkey", "o_totalprice")


def q_page(spark, sf):
    page = browse.page_rows(dirty_base(spark, sf), 3, ["o_orderkey"], 50, "urgent", "o_totalprice", True)
    return page.select("o_orderkey", "o_totalprice", "o_orderpriority")


DIRTY_TEXT_ROWS = " || '|' || ".join(f"coalesce(CAST({c} AS VARCHAR), 'nan')" for c in
                                     ["o_orderpriority", "o_orderstatus", "raw_amount", "currency", "empty_note"])

QUERIES = {
    "csv_roundtrip": lambda s, d: file_checks.csv_roundtrip(table(s, d, "customer")),
    "csv_delimiter": lambda s, d: file_checks.delimiter_demo({n: table(s, d, n) for n in ("customer", "part", "supplier", "orders")}),
    "csv_encoding": lambda s, d: file_checks.encoding_demo(table(s, d, "part").select("p_partkey", "p_name")),
    "load_guard": lambda s, d: file_checks.guard_report({n: table(s, d, n) for n in ("customer", "part", "orders", "lineitem")}),
    "csv_latin1": lambda s, d: file_checks.latin1(table(s, d, "customer"), "c_name"),
    "csv_mixed_folder": lambda s, d: file_checks.mixed_folder(table(s, d, "customer"), "c_custkey", "c_name"),
    "sink_roundtrip": lambda s, d: file_checks.sink_roundtrip(table(s, d, "supplier")),
    "normalized_names": q_normalized_names,
    "coerce_datetime": q_coerce_datetime,
    "date_formats": q_date_formats,
    "typed_dates": q_typed_dates,
    "logical_bytes": lambda s, d: tables.logical_bytes(dirty_orders(s, d)),
    "column_roles": lambda s, d: roles.column_roles(dirty_orders(s, d)),
    "columns_by_role": lambda s, d: roles.columns_by_role(dirty_orders(s, d)),
    "document_roles": lambda s, d: roles.column_roles(table(s, d, "documents")),
    "dataset_summary": q_dataset_summary,
    "missing_by_column": lambda s, d: profile.missing_by_column(dirty_orders(s, d)),
    "distinct_by_column": lambda s, d: profile.distinct_by_column(table(s, d, "lineitem")),
    "numeric_profile": lambda s, d: rounded(profile.numeric_profile(table(s, d, "lineitem"), LINE_NUM), 7),
    "datetime_profile": lambda s, d: profile.datetime_profile(
        table(s, d, "lineitem").select("l_shipdate")).unionByName(
            profile.datetime_profile(table(s, d, "events").select("ts"))),
    "top_values": lambda s, d: profile.top_values(
        dirty_orders(s, d), ["o_custkey", "o_orderpriority", "o_orderstatus", "raw_amount", "currency", "is_gift"]),
    "value_sample": q_value_sample,
    "full_profile": q_full_profile,
    "search_rows": q_search,
    "sort_rows": q_sort,
    "page_rows": q_page,
    "page_counts": lambda s, d: browse.page_counts(
        dirty_base(s, d).select("o_orderpriority", "o_orderstatus", "raw_amount", "currency", "empty_note"), "urgent"),
    "duplicate_rows": lambda s, d: profile.duplicate_rows(dirty_orders(s, d)),
}

WIDTHS = {"customer": 5, "part": 6, "supplier": 4, "orders": 6, "lineitem": 11}

ORACLE = {
    "csv_roundtrip": "SELECT * FROM customer",
    "csv_delimiter": union_sql([
        f"SELECT '{t}' AS input, '{sep}' AS delimiter, {WIDTHS[t]}::BIGINT AS columns, count(*) > 0 AS found FROM {t}"
        for t, sep in zip(("customer", "part", "supplier", "orders"), files.SEPARATORS)]),
    "csv_encoding": union_sql([f"SELECT '{w}' AS written, '{e}' AS encoding, count(*) > 0 AS found FROM part"
                               for w, e in (("UTF-8", "utf-8"), ("ISO-8859-1", "iso-8859-1"))]),
    "load_guard": union_sql([
        f"SELECT '{t}{label}' AS input, {WIDTHS[t]}::BIGINT AS n_columns, CASE WHEN count(*) > 0 THEN '{outcome}' END AS outcome FROM {t}"
        for t in ("customer", "part", "orders", "lineitem") for label, outcome in (
            ("", "ok"), ("/none", "The input has headers but no data rows."),
            ("/wide", f"Input has {WIDTHS[t]} columns which exceeds the limit of 2."))]),
    "csv_latin1": "SELECT * REPLACE ('café ' || c_name AS c_name) FROM customer",
    "csv_mixed_folder": "SELECT * REPLACE ('café ' || c_name AS c_name) FROM customer",
    "sink_roundtrip": "SELECT k.sink, s.* FROM supplier s, (VALUES ('parquet'), ('csv'), ('json'), ('orc')) k(sink)",
    "normalized_names": "SELECT n_nationkey AS n_key, n_name AS name, n_regionkey AS name_1 FROM nation",
    "date_formats": formats_sql(),
    "typed_dates": typed_dates_sql(),
    "coerce_datetime": WITH_BASE + "SELECT o_orderkey, TRY_CAST(raw_date AS TIMESTAMP) AS raw_date, raw_amount FROM base",
    "logical_bytes": WITH_DIRTY + bytes_sql(),
    "column_roles": WITH_DIRTY + role_sql(),
    "columns_by_role": WITH_DIRTY + ", roles AS (" + role_sql() + ") SELECT role, count(*) AS n_columns, "
                       "string_agg(\"column\", ',' ORDER BY pos) AS columns FROM roles GROUP BY role",
    "document_roles": """SELECT 'doc_id' AS "column", 0 AS pos, 'numeric' AS role UNION ALL
SELECT 'text', 1, CASE WHEN count(DISTINCT text) / count(text) > 0.9 AND avg(length(text)) > 24 THEN 'text'
  WHEN count(DISTINCT text) > 100 AND count(DISTINCT text) / count(text) > 0.5 THEN 'text' ELSE 'categorical' END FROM documents
UNION ALL SELECT 'lang', 2, CASE WHEN count(DISTINCT lang) > 100 THEN 'text' ELSE 'categorical' END FROM documents
UNION ALL SELECT 'source', 3, CASE WHEN count(DISTINCT source) > 100 THEN 'text' ELSE 'categorical' END FROM documents
UNION ALL SELECT 'n_chars', 4, 'numeric'""",
    "dataset_summary": WITH_DIRTY + ", roles AS (" + role_sql() + "), m AS (" + missing_sql(DIRTY, "dirty") + "), b AS ("
                       + bytes_sql() + ") SELECT (SELECT count(*) FROM dirty) AS rows, 11::BIGINT AS columns, "
                       + ", ".join(f"(SELECT coalesce(string_agg(\"column\", ',' ORDER BY pos), '') FROM roles WHERE role = '{r}') AS {r}_columns"
                                   for r in profile.ROLES)
                       + ", '" + ",".join(f"{c}:{t}" for c, t in TYPES.items()) + "' AS types"
                       + f""", (SELECT CAST(sum(missing) AS BIGINT) FROM m) AS missing_cells,
  round((SELECT sum(missing) FROM m) * 100.0::DOUBLE / ((SELECT count(*) FROM dirty) * 11), 2) AS missing_pct,
  {DUP_SQL} AS duplicate_rows, round(({DUP_SQL}) * 100.0::DOUBLE / (SELECT count(*) FROM dirty), 2) AS duplicate_pct,
  (SELECT CAST(sum(bytes) AS BIGINT) FROM b) AS logical_bytes""",
    "missing_by_column": WITH_DIRTY + missing_sql(DIRTY, "dirty"),
    "distinct_by_column": distinct_sql(LINE_NUM + ["l_returnflag", "l_linestatus", "l_shipdate"], "lineitem"),
    "numeric_profile": numeric_sql(LINE_NUM, "lineitem"),
    "datetime_profile": union_sql([
        f"""SELECT '{c}' AS "column", count({c}) AS n, count(*) - count({c}) AS missing, min({c}) AS first, max({c}) AS last
  FROM {t}""" for c, t in (("l_shipdate", "lineitem"), ("ts", "events"))]),
    "top_values": WITH_DIRTY + top_sql(
        ["o_custkey", "o_orderpriority", "o_orderstatus", "raw_amount", "currency", "is_gift"], "dirty"),
    "value_sample": WITH_BASE + union_sql([
        f"""SELECT * FROM (SELECT '{c}' AS "column", row_number() OVER (ORDER BY o_orderkey) AS rank, {c} AS "value"
  FROM base WHERE {c} IS NOT NULL) WHERE rank <= 5""" for c in ["o_orderpriority", "o_orderstatus", "raw_amount", "raw_date"]]),
    "full_profile": full_profile_sql(),
    "search_rows": """SELECT c_custkey, c_name, c_mktsegment FROM customer
WHERE contains(lower(concat_ws('|', c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment)), 'build')""",
    "sort_rows": WITH_BASE + "SELECT o_orderkey, o_totalprice FROM base ORDER BY o_totalprice DESC NULLS LAST, o_orderkey",
    "page_rows": WITH_BASE + f"""SELECT o_orderkey, o_totalprice, o_orderpriority FROM base
WHERE contains(lower({DIRTY_TEXT_ROWS}), 'urgent') ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50 OFFSET 100""",
    "page_counts": WITH_BASE + f"""SELECT count(*) AS total_rows,
  count(*) FILTER (WHERE contains(lower({DIRTY_TEXT_ROWS}), 'urgent')) AS filtered_rows,
  greatest(1, CAST(ceil(count(*) FILTER (WHERE contains(lower({DIRTY_TEXT_ROWS}), 'urgent')) / 25.0) AS BIGINT)) AS total_pages
FROM base""",
    "duplicate_rows": WITH_DIRTY + f"""SELECT (SELECT count(*) FROM dirty) AS n_rows, {DUP_SQL} AS duplicate_rows,
  round(({DUP_SQL}) * 100.0::DOUBLE / (SELECT count(*) FROM dirty), 2) AS duplicate_pct""",
}
