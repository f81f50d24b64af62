"""Report tables: one long table of facts, and a description of all columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factsieve.operators.eda import strongest_pairs
from factsieve.operators.insights import insights
from factsieve.operators.profile import dataset_summary
from factsieve.operators.quality import Quality
from factsieve.plans.facts import Facts
from factsieve.plans.frequency import top_of


def describe_all(df: DataFrame, facts: Facts | None = None) -> DataFrame:
    """column, count and the numbers that fit its kind: mean … max, or unique, top, freq."""
    facts = (facts or Facts(df)).warm()
    base = facts.columns
    tops = top_of(facts.counts, 1).select("column", "shown", "cnt")
    out = base.join(tops, "column", "left")
    names = ["mean", "std", "min", "q1", "median", "q3", "max"]
    if facts.with_role("numeric"):
        out = out.join(facts.numbers.select("column", *names), "column", "left")
    else:
        out = out.select("*", *[F.lit(None).cast("double").alias(n) for n in names])
    other = F.col("role").isin("categorical", "text", "boolean")
    return out.select(
        "column", (F.col("n_rows") - F.col("missing")).alias("count"),
        F.when(other, F.col("n_distinct")).alias("unique"), F.when(other, F.col("shown")).alias("top"),
        F.when(other, F.col("cnt")).alias("freq"), *names)


def _section(df: DataFrame, name: str, order: list[Column], item: Column, value: Column) -> DataFrame:
    w = W.partitionBy(F.lit(1)).orderBy(*order)  # a section has a few rows
    return df.select(F.lit(name).alias("section"), F.row_number().over(w).cast("long").alias("ord"),
                     item.cast("string").alias("item"), value.cast("string").alias("value"))


def report_facts(df: DataFrame, operations: list[dict] | None = None, runs: list[DataFrame] | None = None,
                 facts: Facts | None = None) -> DataFrame:
    """section, ord, item, value: overview, issues, operations, description, correlations, insights, model runs."""
    facts = (facts or Facts(df)).warm()
    spark = df.sparkSession
    summary = dataset_summary(df, facts)
    fields = [f.name for f in summary.schema.fields]
    overview = summary.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(c).alias("item"), F.col(c).cast("string").alias("value")) for i, c in enumerate(fields)])))
    severity = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    described = describe_all(df, facts).join(facts.columns.select("column", "pos"), "column")
    parts = [
        _section(overview, "overview", [F.col("i")], F.col("item"), F.col("value")),
        _section(Quality(df, facts).issues(), "issues", [severity, F.col("title")], F.col("severity"), F.col("title")),
        _section(described, "describe", [F.col("pos")],
                 F.col("column"), F.to_json(F.struct(*[c for c in described.columns if c not in ("column", "pos")]))),
        _section(insights(df, facts=facts, numbers=3, groups=2), "insights",
                 [F.when(F.col("severity") == "warning", 0).otherwise(1), F.col("kind"), F.col("title")],
                 F.col("kind"), F.col("title")),
    ]
    if len(facts.with_role("numeric")) >= 2:
        top = strongest_pairs(df, k=None, columns=facts.with_role("numeric"))
        parts.append(_section(top, "correlations", [F.abs("r").desc(), F.col("x"), F.col("y")],
                              F.concat_ws(" ~ ", "x", "y"), F.format_string("%.3f", F.col("r"))))
    if operations:
        ops = spark.createDataFrame([(i, op["op"], op.get("column") or "") for i, op in enumerate(operations)],
                                    "i int, op string, col string")
        parts.append(_section(ops, "operations", [F.col("i")], F.col("op"), F.col("col")))
    for run in runs or []:
        parts.append(_section(run, "models", [F.col("model")], F.col("model"), F.to_json(F.struct("*"))))
    return reduce(DataFrame.unionByName, parts)
