"""Rule-based findings.  Each rule gives rows (kind, pos, title, columns, severity, metric)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factsieve.functions.columns import as_number, group_key, ref
from factsieve.operators.eda import correlation_pairs
from factsieve.operators.quality import outlier_counts
from factsieve.operators.trends import trend_thirds
from factsieve.plans.facts import Facts
from factsieve.plans.frequency import top_of
from factsieve.plans.moments import adjusted_skew

SCHEMA = "kind string, pos int, title string, columns string, severity string, metric double"


def _row(kind: str, pos: Column, title: Column, columns: Column, severity: Column, metric: Column) -> list[Column]:
    return [F.lit(kind).alias("kind"), pos.cast("int").alias("pos"), title.alias("title"), columns.alias("columns"),
            severity.alias("severity"), metric.cast("double").alias("metric")]


def _quoted(name: str) -> Column:
    return F.concat(F.lit("'"), F.col(name), F.lit("'"))


def _none(facts: Facts) -> DataFrame:
    return facts.df.sparkSession.createDataFrame([], SCHEMA)


def _positions(facts: Facts) -> Column:
    return F.create_map(*[e for i, c in enumerate(facts.df.columns) for e in (F.lit(c), F.lit(i))])


def correlation(facts: Facts) -> DataFrame:
    """The strong ones among the top three pairs, or a note that even the strongest pair is weak."""
    names = facts.with_role("numeric")
    if len(names) < 2:
        return _none(facts)
    pairs = correlation_pairs(facts.df, max_cols=len(names), columns=names).where("r is not null")
    top = pairs.orderBy(F.abs("r").desc(), "x", "y").limit(3)
    strongest = F.max(F.abs("r")).over(_whole())
    a = F.abs("r")
    top = top.withColumn("_best", strongest)
    word = F.when(a >= 0.85, "close").when(a >= 0.7, "clear").otherwise("visible")
    sign = F.when(F.col("r") > 0, "rising").otherwise("falling")
    strong = F.concat(F.col("x"), F.lit(" ~ "), F.col("y"), F.lit(": a "), word, F.lit(", "), sign, F.lit(" line"))
    weak = (F.col("_best") < 0.3) & (a == F.col("_best"))
    title = F.when(a >= 0.5, strong).otherwise(F.lit("No two numbers move together"))
    kept = top.where((a >= 0.5) | weak).withColumn(
        "_rank", F.row_number().over(_whole().orderBy(a.desc(), "x", "y"))).where((a >= 0.5) | (F.col("_rank") == 1))
    return kept.select(*_row("correlation", F.col("_rank"), title, F.concat_ws(",", "x", "y"), F.lit("info"), F.round("r", 4)))


def _whole():
    from pyspark.sql import Window as W
    return W.partitionBy(F.lit(1))  # over at most three rows


def missing(facts: Facts) -> DataFrame:
    top = facts.columns.where("missing > 0").orderBy(F.desc("missing"), "pos").limit(3)
    pct = F.col("missing") * 100.0 / F.col("n_rows")
    return top.select(*_row("missing", F.col("pos"), F.concat(_quoted("column"), F.lit(" lacks values")), F.col("column"),
                            F.when(pct >= 5, "warning").otherwise("info"), F.round(pct, 2)))


def dominance(facts: Facts) -> DataFrame:
    c = facts.columns.where(F.col("role").isin("categorical", "boolean"))
    share = F.col("top_count") * 100.0 / (F.col("n_rows") - F.col("missing"))
    tops = top_of(facts.counts, 1).select("column", "shown")
    hit = c.where((F.col("n_rows") > F.col("missing")) & (F.col("top_count") >= (F.col("n_rows") - F.col("missing")) * 0.6))
    title = F.concat(F.lit("Most rows of '"), F.col("column"), F.lit("' hold '"), F.col("shown"), F.lit("'"))
    return hit.join(tops, "column").select(
        *_row("dominance", F.col("pos"), title, F.col("column"), F.lit("info"), F.round(share, 1)))


def skewed(facts: Facts) -> DataFrame:
    if not facts.with_role("numeric"):
        return _none(facts)
    s = facts.numbers.where("n > 10").withColumn("skew", adjusted_skew()).where(F.abs("skew") >= 1)
    word = F.when(F.col("skew") > 0, "right").otherwise("left")
    return s.select(*_row("distribution", F.col("pos"), F.concat(_quoted("column"), F.lit(" has a long "), word, F.lit(" tail")),
                          F.col("column"), F.lit("info"), F.round("skew", 3)))


def group_gap(facts: Facts, numbers: int | None = None, groups: int | None = None) -> DataFrame:
    """First categorical column, per numeric one, whose group means lie a standard deviation apart.

    ``numbers`` and ``groups`` take the leading columns only.
    """
    nums, cats = facts.with_role("numeric")[:numbers], facts.with_role("categorical", "boolean")[:groups]
    if not nums or not cats:
        return _none(facts)
    df = facts.df
    cells = F.array(*[F.struct(F.lit(i).alias("ci"), F.lit(c).alias("cat"), group_key(ref(c)).alias("label"))
                      for i, c in enumerate(cats)])
    wide = df.select(*[as_number(df, c).alias(f"n{i}") for i, c in enumerate(nums)], F.inline(cells))
    means = wide.groupBy("ci", "cat", "label").agg(*[F.avg(f"n{i}").alias(f"m{i}") for i in range(len(nums))])
    spans = means.groupBy("ci", "cat").agg(*[
        F.struct(F.count(f"m{i}").alias("groups"), (F.max(f"m{i}") - F.min(f"m{i}")).alias("gap")).alias(f"s{i}")
        for i in range(len(nums))])
    flat = spans.select("ci", "cat", F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"s{i}.groups").alias("groups"), F.col(f"s{i}.gap").alias("gap"))
        for i, c in enumerate(nums)])))
    scale = facts.numbers.where("n >= 10").select("column", "pos", F.when(F.col("std") > 0, F.col("std")).otherwise(1.0).alias("std"))
    gap = (flat.where("groups >= 2").join(scale, "column").withColumn("gap_sd", F.col("gap") / F.col("std"))
           .where("gap_sd >= 1"))
    first = gap.groupBy("column", "pos").agg(F.min_by(F.struct("cat", "gap_sd"), "ci").alias("hit"))
    title = F.concat(F.lit("The mean of "), _quoted("column"), F.lit(" moves with '"), F.col("hit.cat"), F.lit("'"))
    return first.select(*_row("group_difference", F.col("pos"), title, F.concat_ws(",", F.col("column"), F.col("hit.cat")),
                              F.lit("info"), F.round("hit.gap_sd", 2)))


def trend(facts: Facts, numbers: int | None = None) -> DataFrame:
    """First of the (leading) numeric columns that moved by a fifth from the earliest to the latest third of the first time column."""
    times, nums = facts.with_role("datetime")[:1], facts.with_role("numeric")[:numbers]
    if not times or not nums:
        return _none(facts)
    at = F.create_map(*[e for i, c in enumerate(nums) for e in (F.lit(c), F.lit(i))])
    t = trend_thirds(facts.df, times[0], nums).where((F.col("n") >= 12) & (F.abs("pct_change") >= 20)
                                                     & (F.col("early_mean") != 0))
    first = t.withColumn("pos", at[F.col("column")]).orderBy("pos").limit(1)
    word = F.when(F.col("pct_change") > 0, "rose").otherwise("fell")
    title = F.concat(_quoted("column"), F.lit(" "), word, F.lit(" between its first and its last third"))
    return first.select(*_row("trend", F.col("pos"), title, F.concat_ws(",", F.lit(times[0]), F.col("column")), F.lit("info"),
                              F.round("pct_change", 1)))


def outliers(facts: Facts) -> DataFrame:
    if not facts.with_role("numeric"):
        return _none(facts)
    pos = _positions(facts)
    o = outlier_counts(facts.df, facts.numbers).where(
        (F.col("n") >= 20) & (F.col("outliers") >= F.greatest(F.lit(5.0), F.col("n") * 0.02)))
    first = o.withColumn("pos", pos[F.col("column")]).orderBy("pos").limit(1)
    return first.select(*_row("outliers", F.col("pos"), F.concat(_quoted("column"), F.lit(" has values far off its quartiles")), F.col("column"),
                              F.lit("warning"), F.col("outliers")))


def duplicates(facts: Facts) -> DataFrame:
    d = facts.duplicates.where("duplicate_rows > 0")
    severity = F.when(F.col("duplicate_rows") >= F.col("n_rows") * 0.01, "warning").otherwise("info")
    return d.select(*_row("duplicates", F.lit(0), F.lit("Some rows occur more than once"), F.lit(""), severity, F.col("duplicate_rows")))


def identifier(facts: Facts) -> DataFrame:
    c = facts.columns.where(F.col("role").isin("categorical", "text")
                            & (F.col("n_distinct") == F.col("n_rows")) & (F.col("n_rows") > 5))
    return c.orderBy("pos").limit(1).select(*_row(
        "identifier", F.col("pos"), F.concat(_quoted("column"), F.lit(" tells all rows apart")), F.col("column"),
        F.lit("info"), F.col("n_distinct")))


RULES = [correlation, missing, dominance, skewed, outliers, duplicates, identifier]


def insights(df: DataFrame, limit: int | None = None, facts: Facts | None = None, numbers: int | None = None,
             groups: int | None = None) -> DataFrame:
    """All findings, or the first ``limit``: warnings first, then by kind.

    Group gaps and trends look at all columns, or at the leading ``numbers`` numeric and ``groups`` categorical ones.
    """
    facts = (facts or Facts(df)).warm()
    parts = [rule(facts) for rule in RULES] + [group_gap(facts, numbers, groups), trend(facts, numbers)]
    found = reduce(DataFrame.unionByName, parts)
    ranked = found.orderBy(F.when(F.col("severity") == "warning", 0).otherwise(1), "kind", "pos", "title")
    return (ranked if limit is None else ranked.limit(limit)).select("kind", "title", "columns", "severity", "metric")
