"""Feature preparation fitted once, applied as plain column expressions (batch or stream)."""

from __future__ import annotations

import json

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factsieve.functions.columns import (NUMERIC_TYPES, REAL_TYPES, TIME_TYPES, distinct_names, finite_sql, quoted,
                                         ref, time_sql)
from factsieve.plans.frequency import top_of
from factsieve.plans.moments import column_quantiles

MAX_CATEGORIES = 30  # fixed value: beyond it the rarest categories share one column
OTHER = "__other__"


def is_number_feature(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, NUMERIC_TYPES + TIME_TYPES)


def raw_number(df: DataFrame, name: str, time: bool = False) -> str:
    """SQL text of a number feature; a date counts as its day ordinal, 1 on 0001-01-01.

    Text is read as a date where the feature is one (``time``), else as a number; what is neither is missing.
    """
    t = df.schema[name].dataType
    text = isinstance(t, T.StringType)
    if isinstance(t, TIME_TYPES) or text and time:
        value = time_sql(name) if text else quoted(name)
        return f"cast(datediff(cast({value} as date), date'0001-01-01') + 1 as double)"
    if text:
        number = f"try_cast(trim({quoted(name)}) as double)"
        return f"if(abs({number}) < double('Infinity'), {number}, null)"
    return finite_sql(name) if isinstance(t, REAL_TYPES) else f"cast({quoted(name)} as double)"


class Features:
    """Median-imputed standardised numbers (population deviation) and one-hot categories."""

    def __init__(self, numbers: list[dict], categories: list[dict]):
        self.numbers, self.categories = numbers, categories

    @property
    def inputs(self) -> list[str]:
        return [n["column"] for n in self.numbers] + [c["column"] for c in self.categories]

    @property
    def names(self) -> list[str]:
        out = [n["column"] for n in self.numbers]
        for c in self.categories:
            out += [f"{c['column']}_{v}" for v in c["values"]] + ([f"{c['column']}_{OTHER}"] if c["pooled"] else [])
        return distinct_names(out)

    @staticmethod
    def fit(df: DataFrame, columns: list[str]) -> Features:
        numeric = [c for c in columns if is_number_feature(df, c)]
        other = [c for c in columns if c not in numeric and isinstance(
            df.schema[c].dataType, (T.StringType, T.BooleanType))]
        numbers: list[dict] = []
        if numeric:
            plain = df.select(*[F.expr(f"{raw_number(df, c)} as {quoted(c)}") for c in numeric])
            medians = {r["column"]: r["m"] for r in column_quantiles(plain, numeric, {"m": 0.5}).collect()}
            kept = [c for c in numeric if medians.get(c) is not None]
            if kept:
                filled = plain.select(*[
                    F.expr(f"coalesce({quoted(c)}, double('{medians[c]!r}')) as {quoted(c)}") for c in kept])
                long = filled.unpivot([], [ref(c) for c in kept], "column", "value")
                sums = {r["column"]: r for r in long.groupBy("column").agg(
                    F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")).collect()}
                numbers = [{"column": c, "median": medians[c], "mean": sums[c]["mean"], "std": sums[c]["std"] or 1.0,
                            "time": isinstance(df.schema[c].dataType, TIME_TYPES)} for c in kept]
        categories: list[dict] = []
        if other:
            cells = F.array(*[F.struct(F.lit(c).alias("column"), ref(c).cast("string").alias("key")) for c in other])
            counts = (df.select(F.inline(cells)).where("key is not null").groupBy("column", "key")
                      .agg(F.count(F.lit(1)).alias("cnt"))
                      .select("column", "key", F.col("key").alias("shown"), F.lit(None).cast("double").alias("num"), "cnt"))
            rows = top_of(counts, MAX_CATEGORIES + 1).collect()  # at most 31 per column
            for c in other:
                ranked = [r["key"] for r in sorted((r for r in rows if r["column"] == c), key=lambda r: r["rank"])]
                if not ranked:
                    continue
                pooled = len(ranked) > MAX_CATEGORIES
                values = sorted(ranked[:MAX_CATEGORIES - 1] if pooled else ranked)
                categories.append({"column": c, "mode": ranked[0], "values": values, "pooled": pooled})
        if not numbers and not categories:
            raise ValueError(f"none of {columns} has a value to learn from")
        return Features(numbers, categories)

    def expressions(self, df: DataFrame) -> list[Column]:
        out = []
        for n in self.numbers:
            fit = {k: f"double('{n[k]!r}')" for k in ("median", "mean", "std")}
            out.append(F.expr(f"(coalesce({raw_number(df, n['column'], n.get('time', False))}, {fit['median']}) - {fit['mean']}) / {fit['std']}"))
        for c in self.categories:
            v = F.coalesce(ref(c["column"]).cast("string"), F.lit(c["mode"]))
            out += [(v == F.lit(k)).cast("double") for k in c["values"]]
            if c["pooled"]:
                out.append((~v.isin(c["values"])).cast("double"))
        return out

    def table(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """Kept columns and one column per feature."""
        return df.select(*[ref(k) for k in keep], *[e.alias(n) for e, n in zip(self.expressions(df), self.names)])

    def vectors(self, df: DataFrame, *keep: Column) -> DataFrame:
        return df.select(*keep, array_to_vector(F.array(*self.expressions(df))).alias("features"))

    def to_json(self) -> str:
        return json.dumps({"numbers": self.numbers, "categories": self.categories})

    @staticmethod
    def from_json(text: str) -> Features:
        return Features(**json.loads(text))
