"""Input tables of the registered queries, as Spark readers and as text for the SQL side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factsieve.sources.tables import read_parquet

DIRTY_BASE = """SELECT o_orderkey, o_custkey,
  CASE WHEN o_orderkey % 20 = 0 THEN NULL WHEN o_orderkey % 997 = 0 THEN o_totalprice * 25 ELSE o_totalprice END AS o_totalprice,
  CASE WHEN o_orderkey % 41 = 0 THEN NULL WHEN o_orderkey % 50 = 0 THEN concat(' ', o_orderpriority, ' ')
       WHEN o_orderkey % 33 = 0 THEN lower(o_orderpriority) ELSE o_orderpriority END AS o_orderpriority,
  CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
  o_orderdate,
  CASE WHEN o_orderkey % 9 = 0 THEN 'n/a' WHEN o_orderkey % 11 = 0 THEN '2024-01-05'
       WHEN o_orderkey % 7 = 0 THEN '1.5' ELSE CAST(o_custkey AS {S}) END AS raw_amount,
  CAST(o_orderdate AS {S}) AS raw_date,
  CASE WHEN o_orderkey % 5 = 0 THEN true ELSE false END AS is_gift,
  'EUR' AS currency, CAST(NULL AS {S}) AS empty_note
FROM {T}"""
SCORED = """SELECT event_id, event_type AS label, user_id,
  CASE WHEN event_id % 4 <> 0 THEN event_type WHEN event_type = 'purchase' THEN 'click' ELSE 'purchase' END AS prediction,
  event_type = 'purchase' AS y, (event_id % 101) / 100.0 AS score,
  value AS target, value * 0.9 + (event_id % 7) AS guess
FROM {T}"""

DATED = """SELECT o_orderkey, {DMY} AS day_first, {MDY} AS month_first, CASE WHEN {DAY} <= 12 THEN {DMY} END AS unclear,
  CASE WHEN o_orderkey % 4 = 0 THEN {MDY} ELSE {DMY} END AS two_conventions,
  CASE WHEN o_orderkey % 10 = 0 THEN {ISO} ELSE {DOT} END AS two_shapes, o_orderpriority AS no_date FROM {T}"""
_SPARK_DATES = {k: f"date_format(o_orderdate, '{f}')" for k, f in
                {"DMY": "dd/MM/yyyy", "MDY": "MM/dd/yyyy", "ISO": "yyyy-MM-dd", "DOT": "dd.MM.yyyy"}.items()}
_DUCK_DATES = {k: f"strftime(o_orderdate, '{f}')" for k, f in
               {"DMY": "%d/%m/%Y", "MDY": "%m/%d/%Y", "ISO": "%Y-%m-%d", "DOT": "%d.%m.%Y"}.items()}

WITH_DATED = "WITH dated AS (" + DATED.format(**_DUCK_DATES, DAY="day(o_orderdate)", T="orders") + ") "
_BASE_SQL = DIRTY_BASE.format(S="VARCHAR", T="orders")
WITH_BASE = f"WITH base AS ({_BASE_SQL}) "
WITH_DIRTY = (f"WITH base AS ({_BASE_SQL}), dirty AS (SELECT * FROM base UNION ALL "
              "SELECT * FROM base WHERE o_orderkey % 100 = 0) ")
WITH_SCORED = "WITH scored AS (" + SCORED.format(T="events").replace("/ 100.0", "/ 100.0::DOUBLE") + ") "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet")


def dirty_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with defects; one row per order."""
    return spark.sql(DIRTY_BASE.format(S="STRING", T="{orders}"), orders=table(spark, sf_dir, "orders"))


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with defects and with exact duplicates."""
    base = dirty_base(spark, sf_dir)
    return base.unionAll(base.where("o_orderkey % 100 = 0"))


def dated_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of orders as text in several conventions."""
    return spark.sql(DATED.format(**_SPARK_DATES, DAY="day(o_orderdate)", T="{orders}"), orders=table(spark, sf_dir, "orders"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with fixed predictions, for the metric operators."""
    text = SCORED.format(T="{events}").replace("/ 100.0", "/ 100.0D")
    return spark.sql(text, events=table(spark, sf_dir, "events"))
