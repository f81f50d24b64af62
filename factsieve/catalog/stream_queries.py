"""Registered queries: the same operators on streams that read the given files."""

from __future__ import annotations

from pyspark.sql import functions as F

from factsieve.catalog.clean_queries import FENCE, WITH_BASE
from factsieve.catalog.inputs import DIRTY_BASE, dirty_base, table
from factsieve.catalog.shape import rounded
from factsieve.operators import ml
from factsieve.operators.clean import Recipe
from factsieve.streaming import streams

STEPS = [{"op": "trim_whitespace", "columns": ["o_orderpriority"]},
         {"op": "standardize_case", "column": "o_orderpriority", "case": "upper"},
         {"op": "fill_missing", "column": "o_orderpriority", "strategy": "mode"},
         {"op": "cap_outliers", "column": "o_totalprice"}]


def stream(s, d, name):
    return streams.read_files(s, d, f"{name}.parquet", table(s, d, name).schema)


def dirty_stream(s, d):
    return s.sql(DIRTY_BASE.format(S="STRING", T="{orders}"), orders=stream(s, d, "orders"))


def q_clean(s, d):
    fitted = Recipe(STEPS).fit(dirty_base(s, d))
    return rounded(streams.run_available(fitted.transform(dirty_stream(s, d)).select("o_orderkey", "o_orderpriority", "o_totalprice")))


def q_windows(s, d):
    return rounded(streams.run_to_end(streams.windowed(stream(s, d, "events"), "ts", "value", "sum")), 4)


def q_quality(s, d):
    return streams.run_to_end(streams.quality_counters(dirty_stream(s, d), "o_orderdate", ["o_totalprice", "o_orderpriority"], "7 days"))


def q_score(s, d):
    data = table(s, d, "events").select("event_id", "user_id", "value", (F.col("event_type") == "purchase").alias("bought"))
    run = ml.train_models(data, "bought", "classification", ["event_id"], cv=0, models=["logistic"])
    live = stream(s, d, "events").select("event_id", "user_id", "value")
    return streams.run_available(run.best_model.predict(live, ["event_id"]).select("event_id", "prediction"))


QUERIES = {"stream_clean": q_clean, "stream_windows": q_windows, "stream_quality": q_quality, "stream_score": q_score}

ORACLE = {
    "stream_clean": WITH_BASE + FENCE + r""", p AS (SELECT o_orderkey, o_totalprice, upper(regexp_replace(o_orderpriority, '^\s+|\s+$', '', 'g')) AS p FROM base),
m AS (SELECT p AS mo FROM p WHERE p IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT o_orderkey, coalesce(p, mo) AS o_orderpriority, CASE WHEN o_totalprice IS NOT NULL THEN round(greatest(lo, least(hi, o_totalprice)), 6) END AS o_totalprice FROM p, m, f""",
    "stream_windows": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, round(sum(value), 4) AS y, count(*) AS n FROM events GROUP BY 1",
    "stream_quality": WITH_BASE + """SELECT time_bucket(INTERVAL 7 DAY, o_orderdate, TIMESTAMP '1970-01-01') AS start, count(*) AS rows,
  count(*) - count(o_totalprice) AS missing_o_totalprice, count(*) - count(o_orderpriority) AS missing_o_orderpriority FROM base GROUP BY 1""",
}
