"""Registered queries: cleaning operations and recipes."""

from __future__ import annotations

from factsieve.catalog.inputs import WITH_BASE, WITH_DIRTY, dirty_base, dirty_orders
from factsieve.catalog.shape import rounded
from factsieve.operators.clean import Recipe, apply_operation

KEPT = ["o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus", "raw_amount", "raw_date", "is_gift"]


def on_base(op: dict, columns: list[str], digits: int = 6):
    def run(spark, sf):
        return rounded(apply_operation(dirty_base(spark, sf), op).select(*columns), digits)
    return run


def fill(column: str, strategy: str, **more):
    return on_base({"op": "fill_missing", "column": column, "strategy": strategy, "order_by": ["o_orderkey"], **more},
                   ["o_orderkey", column])


RECIPE = [
    {"op": "remove_duplicates"},
    {"op": "trim_whitespace", "columns": ["o_orderpriority"]},
    {"op": "standardize_case", "column": "o_orderpriority", "case": "upper"},
    {"op": "fill_missing", "column": "o_orderpriority", "strategy": "mode"},
    {"op": "cap_outliers", "column": "o_totalprice"},
    {"op": "fill_missing", "column": "o_totalprice", "strategy": "median"},
    {"op": "scale_numeric", "column": "o_totalprice", "method": "minmax"},
    {"op": "drop_column", "columns": ["empty_note", "currency"]},
    {"op": "rename_column", "old": "o_totalprice", "new": "price_scaled"},
]
RECIPE_OUT = ["o_orderkey", "price_scaled", "o_orderpriority", "o_orderstatus", "is_gift"]

FENCE = """, f AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (
  SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM base)) """
BARE = r"regexp_replace(o_orderpriority, '^\s+|\s+$', '', 'g')"
NUM = r"regexp_matches(raw_amount, '^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$')"

QUERIES = {
    "clean_dedup": lambda s, d: apply_operation(dirty_orders(s, d), {"op": "remove_duplicates"}),
    "clean_drop_column": lambda s, d: apply_operation(dirty_base(s, d), {
        "op": "drop_column", "columns": ["empty_note", "currency", "raw_date"]}),
    "clean_drop_missing": on_base({"op": "drop_rows_missing", "columns": ["o_totalprice", "o_orderpriority"]}, KEPT),
    "fill_mean": fill("o_totalprice", "mean"),
    "fill_median": fill("o_totalprice", "median"),
    "fill_mode": fill("o_orderpriority", "mode"),
    "fill_ffill": fill("o_orderstatus", "ffill"),
    "fill_bfill": fill("o_orderpriority", "bfill"),
    "fill_constant": fill("o_orderstatus", "constant", value="unknown"),
    "fill_zero": fill("o_totalprice", "zero"),
    "clean_rename": on_base({"op": "rename_column", "old": "o_totalprice", "new": "total price"}, ["o_orderkey", "total price"]),
    "convert_numeric": on_base({"op": "convert_dtype", "column": "raw_amount", "dtype": "numeric"}, ["o_orderkey", "raw_amount"]),
    "convert_int": on_base({"op": "convert_dtype", "column": "raw_amount", "dtype": "int"}, ["o_orderkey", "raw_amount"]),
    "convert_datetime": on_base({"op": "convert_dtype", "column": "raw_date", "dtype": "datetime"}, ["o_orderkey", "raw_date"]),
    "convert_string": on_base({"op": "convert_dtype", "column": "o_custkey", "dtype": "string"}, ["o_orderkey", "o_custkey"]),
    "clean_trim": on_base({"op": "trim_whitespace"}, KEPT),
    "case_lower": on_base({"op": "standardize_case", "column": "o_orderpriority", "case": "lower"}, ["o_orderkey", "o_orderpriority"]),
    "case_upper": on_base({"op": "standardize_case", "column": "o_orderpriority", "case": "upper"}, ["o_orderkey", "o_orderpriority"]),
    "case_title": on_base({"op": "standardize_case", "column": "o_orderpriority", "case": "title"}, ["o_orderkey", "o_orderpriority"]),
    "cap_outliers": on_base({"op": "cap_outliers", "column": "o_totalprice"}, ["o_orderkey", "o_totalprice"]),
    "drop_outliers": on_base({"op": "drop_outliers", "column": "o_totalprice"}, ["o_orderkey", "o_totalprice"]),
    "encode_onehot": lambda s, d: apply_operation(dirty_base(s, d).select("o_orderkey", "o_orderstatus"), {
        "op": "encode_categorical", "column": "o_orderstatus", "method": "onehot"}),
    "encode_label": on_base({"op": "encode_categorical", "column": "o_orderpriority", "method": "label"}, ["o_orderkey", "o_orderpriority"]),
    "encode_label_many": on_base({"op": "encode_categorical", "column": "o_custkey", "method": "label"}, ["o_orderkey", "o_custkey"]),
    "scale_standard": on_base({"op": "scale_numeric", "column": "o_totalprice", "method": "standard"}, ["o_orderkey", "o_totalprice"]),
    "scale_minmax": on_base({"op": "scale_numeric", "column": "o_totalprice", "method": "minmax"}, ["o_orderkey", "o_totalprice"]),
    "scale_log1p": on_base({"op": "scale_numeric", "column": "o_totalprice", "method": "log"}, ["o_orderkey", "o_totalprice"]),
    "clean_recipe": lambda s, d: rounded(
        Recipe(RECIPE).fit(dirty_orders(s, d)).transform(dirty_orders(s, d)).select(*RECIPE_OUT)),
}

TITLE = f"""list_reduce([''] || list_transform(regexp_extract_all({BARE}, '[A-Za-z]+|[^A-Za-z]+'),
  lambda w: concat(upper(w[1]), lower(w[2:]))), lambda a, b: concat(a, b))"""


def one(expr: str, column: str) -> str:
    return WITH_BASE + f"SELECT o_orderkey, {expr} AS {column} FROM base"


ORACLE = {
    "clean_dedup": WITH_DIRTY + "SELECT DISTINCT * FROM dirty",
    "clean_drop_column": WITH_BASE + "SELECT * EXCLUDE (empty_note, currency, raw_date) FROM base",
    "clean_drop_missing": WITH_BASE + f"SELECT * REPLACE (round(o_totalprice, 6) AS o_totalprice) FROM (SELECT {', '.join(KEPT)} FROM base) WHERE o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL",
    "fill_mean": one("round(coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM base)), 6)", "o_totalprice"),
    "fill_median": one("round(coalesce(o_totalprice, (SELECT median(o_totalprice) FROM base)), 6)", "o_totalprice"),
    "fill_mode": one("coalesce(o_orderpriority, (SELECT o_orderpriority FROM base WHERE o_orderpriority IS NOT NULL "
                     "GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1))", "o_orderpriority"),
    "fill_ffill": one("last_value(o_orderstatus IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)", "o_orderstatus"),
    "fill_bfill": one("first_value(o_orderpriority IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)", "o_orderpriority"),
    "fill_constant": one("coalesce(o_orderstatus, 'unknown')", "o_orderstatus"),
    "fill_zero": one("round(coalesce(o_totalprice, 0), 6)", "o_totalprice"),
    "clean_rename": WITH_BASE + 'SELECT o_orderkey, round(o_totalprice, 6) AS "total price" FROM base',
    "convert_numeric": one(f"CASE WHEN {NUM} THEN TRY_CAST(raw_amount AS DOUBLE) END", "raw_amount"),
    "convert_int": one(f"CASE WHEN {NUM} AND TRY_CAST(raw_amount AS DOUBLE) = floor(TRY_CAST(raw_amount AS DOUBLE)) "
                       "THEN CAST(TRY_CAST(raw_amount AS DOUBLE) AS BIGINT) END", "raw_amount"),
    "convert_datetime": one("TRY_CAST(raw_date AS TIMESTAMP)", "raw_date"),
    "convert_string": one("CAST(o_custkey AS VARCHAR)", "o_custkey"),
    "clean_trim": WITH_BASE + f"SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice, {BARE} AS o_orderpriority, o_orderstatus, raw_amount, raw_date, is_gift FROM base",
    "case_lower": one(f"lower({BARE})", "o_orderpriority"),
    "case_upper": one(f"upper({BARE})", "o_orderpriority"),
    "case_title": one(f"CASE WHEN o_orderpriority IS NOT NULL THEN {TITLE} END", "o_orderpriority"),
    "cap_outliers": WITH_BASE + FENCE + "SELECT o_orderkey, CASE WHEN o_totalprice IS NOT NULL THEN round(greatest(lo, least(hi, o_totalprice)), 6) END AS o_totalprice FROM base, f",
    "drop_outliers": WITH_BASE + FENCE + "SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM base, f WHERE o_totalprice IS NULL OR o_totalprice BETWEEN lo AND hi",
    "encode_onehot": WITH_BASE + "SELECT o_orderkey, " + ", ".join(
        f"coalesce(o_orderstatus = '{v}', false) AS \"o_orderstatus_{v}\"" for v in "FOP") + " FROM base",
    "encode_label": one("CASE WHEN o_orderpriority IS NOT NULL THEN (dense_rank() OVER (ORDER BY o_orderpriority NULLS LAST)) - 1 END", "o_orderpriority"),
    "encode_label_many": one("(dense_rank() OVER (ORDER BY CAST(o_custkey AS VARCHAR))) - 1", "o_custkey"),
    "scale_standard": one("round((o_totalprice - (SELECT avg(o_totalprice) FROM base)) / (SELECT stddev_samp(o_totalprice) FROM base), 6)", "o_totalprice"),
    "scale_minmax": one("round((o_totalprice - (SELECT min(o_totalprice) FROM base)) / (SELECT max(o_totalprice) - min(o_totalprice) FROM base), 6)", "o_totalprice"),
    "scale_log1p": one("round(ln(1 + o_totalprice), 6)", "o_totalprice"),
    "clean_recipe": WITH_DIRTY + r""", a AS (SELECT DISTINCT * FROM dirty),
b AS (SELECT o_orderkey, o_totalprice, o_orderstatus, is_gift, upper(regexp_replace(o_orderpriority, '^\s+|\s+$', '', 'g')) AS p FROM a),
m AS (SELECT p FROM b WHERE p IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
f AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (
  SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM b)),
c AS (SELECT o_orderkey, o_orderstatus, is_gift, coalesce(p, (SELECT p FROM m)) AS o_orderpriority,
  CASE WHEN o_totalprice IS NOT NULL THEN greatest(lo, least(hi, o_totalprice)) END AS t FROM b, f),
d AS (SELECT * EXCLUDE t, coalesce(t, (SELECT median(t) FROM c)) AS t FROM c)
SELECT o_orderkey, o_orderpriority, o_orderstatus, is_gift,
  round((t - (SELECT min(t) FROM d)) / (SELECT max(t) - min(t) FROM d), 6) AS price_scaled FROM d""",
}
