"""Data-quality checks, issue list and score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factsieve.functions.columns import as_number, digest, percent, ref, string_columns, strip
from factsieve.plans.facts import Facts
from factsieve.plans.frequency import SHOWN, value_counts
from factsieve.plans.rows import side_by_side
from factsieve.plans.store import materialize

# Lexical classes of a text, tried in this order.
LEXICAL = [
    ("int", r"^\s*[+-]?\d+\s*$"),
    ("float", r"^\s*[+-]?(\d+\.\d*|\.\d+|\d+[eE][+-]?\d+|\d+\.\d*[eE][+-]?\d+)\s*$"),
    ("date", r"^\s*(\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4})([ T]\d{1,2}:\d{2}.*)?\s*$"),
    ("bool", r"^\s*(?i:true|false|yes|no)\s*$"),
]
LEXICAL_CLASSES = ["int", "float", "date", "bool", "text"]

# Fixes offered per issue kind, and the weight of each flag in the score.
ACTIONS = {
    "duplicate_rows": "remove_duplicates",
    "empty": "drop_column",
    "excessive_missing": "fill_median,fill_mode,drop_column,drop_rows",
    "missing": "fill_mean,fill_median,fill_mode,ffill,bfill,drop_rows",
    "missing_small": "fill_median,fill_mode,drop_rows",
    "constant": "drop_column",
    "highcard": "drop_column",
    "outliers": "cap_outliers,drop_outliers",
    "whitespace": "trim_whitespace",
    "case": "standardize_case",
    "mixed": "convert_dtype",
}
FLAGS = {
    "empty": "empty_column",
    "excessive_missing": "excessive_missing",
    "missing": "missing",
    "missing_small": "missing_small",
    "constant": "constant",
    "highcard": "high_cardinality",
    "outliers": "outliers",
    "whitespace": "whitespace",
    "case": "case_inconsistent",
    "mixed": "mixed_types",
}
PENALTY = {"empty": 5, "constant": 3, "excessive_missing": 4, "mixed": 2, "outliers": 1}


def fences(stats: DataFrame) -> DataFrame:
    """Adds iqr, low, high (1.5 IQR) to a table with q1 and q3."""
    iqr = F.col("q3") - F.col("q1")
    return (stats.withColumn("iqr", iqr)
            .withColumn("low", F.col("q1") - iqr * 1.5).withColumn("high", F.col("q3") + iqr * 1.5))


def outlier_counts(df: DataFrame, stats: DataFrame) -> DataFrame:
    """column, n, q1, q3, low, high, outliers: values strictly outside the fences, all columns in one aggregate.

    ``stats`` has column, n, q1, q3.  Columns with under 8 values or no spread count 0.
    """
    fitted = fences(stats).select("column", "n", "q1", "q3", "iqr", "low", "high").collect()  # one row per column
    rows = []
    for r in fitted:
        x = as_number(df, r["column"])
        usable = r["iqr"] is not None and r["iqr"] != 0 and r["n"] >= 8
        hits = (F.count_if((x < F.lit(r["low"])) | (x > F.lit(r["high"]))) if usable
                else F.count_if(F.lit(False)))
        rows.append(F.struct(
            F.lit(r["column"]).alias("column"), F.lit(r["n"]).cast("long").alias("n"),
            *[F.lit(r[k]).cast("double").alias(k) for k in ("q1", "q3", "low", "high")], hits.alias("outliers")))
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def iqr_outliers(df: DataFrame, columns: list[str] | None = None, facts: Facts | None = None) -> DataFrame:
    from factsieve.plans.moments import column_quantiles

    stats = facts.numbers if facts else column_quantiles(df, columns)
    return outlier_counts(df, stats)


def lexical_class(c: Column) -> Column:
    out = None
    for name, pattern in LEXICAL:
        out = F.when(c.rlike(pattern), name) if out is None else out.when(c.rlike(pattern), name)
    return out.otherwise("text")


def text_checks(df: DataFrame, columns: list[str], counts: DataFrame | None = None) -> DataFrame:
    """column, n, padded, n_stripped, n_folded and one count per lexical class, per text column.

    Short values are checked once per distinct value, from the frequency table.  Long
    ones are checked whole where they are read; only their digests are shuffled.
    """
    counts = value_counts(df, columns) if counts is None else counts.where(F.col("column").isin(columns))
    short = counts.where(F.col("chars") <= SHOWN).select("column", F.col("key").alias("v"), "cnt")
    long = (df.select(*[ref(c) for c in columns]).unpivot([], [ref(c) for c in columns], "column", "v")
            .where(F.length("v") > SHOWN).select("column", "v", F.expr("1L as cnt")))
    checked = short.unionByName(long).withColumn("b", strip(F.col("v"))).select(
        "column", "cnt", digest(F.col("b")).alias("bare"), digest(F.lower("b")).alias("folded"),
        (F.col("v") != F.col("b")).alias("padded"), lexical_class(F.col("v")).alias("lexical"))
    small = checked.groupBy("column", "bare", "folded", "padded", "lexical").agg(F.sum("cnt").alias("cnt"))
    tallies = [F.expr("sum(cnt) as n"), F.expr("sum(if(padded, cnt, 0L)) as padded")]
    tallies += [F.expr(f"sum(if(lexical = '{k}', cnt, 0L)) as n_{k}") for k in LEXICAL_CLASSES]
    sums = [F.expr(f"sum({s}) as {s}") for s in ["n", "padded"] + [f"n_{k}" for k in LEXICAL_CLASSES]]
    by_bare = small.groupBy("column", "folded", "bare").agg(*tallies)
    by_folded = by_bare.groupBy("column", "folded").agg(F.expr("count(1) as n_stripped"), *sums)
    return by_folded.groupBy("column").agg(F.expr("sum(n_stripped) as n_stripped"), F.expr("count(1) as n_folded"), *sums)


def whitespace_values(df: DataFrame) -> DataFrame:
    return text_checks(df, string_columns(df)).select("column", F.col("padded").alias("padded_values"))


def case_inconsistency(df: DataFrame) -> DataFrame:
    return text_checks(df, string_columns(df)).select(
        "column", "n_stripped", "n_folded", (F.col("n_stripped") > F.col("n_folded")).alias("inconsistent"))


def mixed_types(df: DataFrame) -> DataFrame:
    kinds = reduce(lambda a, b: a + b, [(F.col(f"n_{k}") > 0).cast("int") for k in LEXICAL_CLASSES])
    return text_checks(df, string_columns(df)).select(
        "column", *[f"n_{k}" for k in LEXICAL_CLASSES], (kinds > 1).alias("mixed"))


class Quality:
    """All checks of one table.  Reports share the facts; nothing is scanned twice."""

    def __init__(self, df: DataFrame, facts: Facts | None = None):
        self.df, self.facts = df, facts or Facts(df)
        self._checks: DataFrame | None = None

    def checks(self) -> DataFrame:
        """One row per column: facts, outlier count and one boolean per issue kind."""
        if self._checks is not None:
            return self._checks
        base = self.facts.warm().columns
        if self.facts.with_role("numeric"):
            base = base.join(outlier_counts(self.df, self.facts.numbers).select("column", "outliers"), "column", "left")
        else:
            base = base.withColumn("outliers", F.lit(None).cast("long"))
        texts = string_columns(self.df)
        if texts:
            checks = text_checks(self.df, texts, self.facts.counts).drop("n")
            base = base.join(checks, "column", "left")
        else:
            for c in ["n_stripped", "n_folded", "padded"] + [f"n_{k}" for k in LEXICAL_CLASSES]:
                base = base.withColumn(c, F.lit(None).cast("long"))
        n, missing, u = F.col("n_rows"), F.col("missing"), F.col("n_distinct")
        share = F.coalesce(F.try_divide(missing * 100.0, n), F.lit(0.0))
        empty = missing == n
        wordy = F.col("role").isin("categorical", "text")
        kinds = reduce(lambda a, b: a + b, [
            (F.coalesce(F.col(f"n_{k}"), F.lit(0)) > 0).cast("int") for k in LEXICAL_CLASSES])
        out_share = F.coalesce(F.try_divide(F.col("outliers") * 1.0, n), F.lit(0.0))
        found = {
            "empty": empty,
            "excessive_missing": ~empty & (share >= 40),
            "missing": ~empty & (share >= 5) & (share < 40),
            "missing_small": ~empty & (missing > 0) & (share < 5),
            "constant": ~empty & (u <= 1) & (F.col("role") != "nested"),
            "highcard": (F.col("role") == "categorical") & (u > 50) & (F.try_divide(u * 1.0, n) > 0.1),
            "outliers": (F.col("outliers") > 0) & (out_share >= 0.01),
            "whitespace": wordy & (F.col("padded") > 0),
            "case": wordy & (F.col("n_stripped") > F.col("n_folded")),
            "mixed": kinds > 1,
        }
        table = base.select(
            "column", "pos", "role", "n_rows", "missing", share.alias("share"), "n_distinct", "outliers",
            out_share.alias("out_share"), "padded",
            *[F.coalesce(cond, F.lit(False)).alias(f"is_{k}") for k, cond in found.items()])
        self._checks = materialize(table.coalesce(1), "checks")
        return self._checks

    def columns(self) -> DataFrame:
        """column, role, missing, missing_pct, n_distinct, dtype, flags, outliers: one row per column."""
        types = F.create_map(*[e for f in self.df.schema.fields
                               for e in (F.lit(f.name), F.lit(f.dataType.simpleString()))])
        flags = F.concat_ws(",", *[F.when(F.col(f"is_{k}"), F.lit(flag)) for k, flag in FLAGS.items()])
        return self.checks().select(
            "column", "role", "missing", F.round("share", 2).alias("missing_pct"), "n_distinct",
            types[F.col("column")].alias("dtype"), flags.alias("flags"), "outliers")

    def all_issues(self) -> DataFrame:
        """kind, column, severity, title, actions: every issue found."""
        c = self.checks()
        name, pct = F.concat(F.lit("'"), F.col("column"), F.lit("'")), F.format_string("%.1f", F.col("share"))
        spec = {
            "empty": (F.lit("high"), F.concat(name, F.lit(": no value in any row"))),
            "excessive_missing": (F.lit("high"), F.concat(name, F.lit(": "), pct, F.lit(" % of the rows lack a value"))),
            "missing": (F.when(F.col("share") < 20, "medium").otherwise("high"),
                        F.concat(name, F.lit(": "), pct, F.lit(" % of the rows lack a value"))),
            "missing_small": (F.lit("low"), F.concat(name, F.lit(": "), F.col("missing").cast("string"),
                                                     F.lit(" rows lack a value, "), pct, F.lit(" % of all"))),
            "constant": (F.lit("medium"), F.concat(name, F.lit(": one value only"))),
            "highcard": (F.lit("medium"), F.concat(name, F.lit(": "), F.col("n_distinct").cast("string"),
                                                   F.lit(" different labels, too many to compare"))),
            "outliers": (F.when(F.col("out_share") < 0.05, "low").otherwise("medium"),
                         F.concat(name, F.lit(": "), F.col("outliers").cast("string"),
                                  F.lit(" values beyond the quartile fences"))),
            "whitespace": (F.lit("low"), F.concat(name, F.lit(": "), F.col("padded").cast("string"),
                                                  F.lit(" values begin or end with white space"))),
            "case": (F.lit("low"), F.concat(name, F.lit(": labels differ by letter case alone"))),
            "mixed": (F.lit("medium"), F.concat(name, F.lit(": values of several kinds"))),
        }
        cells = F.array(*[
            F.struct(F.lit(kind).alias("kind"), F.col(f"is_{kind}").alias("hit"), sev.alias("severity"),
                     title.alias("title"), F.lit(ACTIONS[kind]).alias("actions")) for kind, (sev, title) in spec.items()])
        issues = c.select("column", F.inline(cells)).where("hit").drop("hit")
        d, n = F.col("duplicate_rows"), F.col("n_rows")
        dup = self.facts.duplicates.where(d > 0).select(
            F.lit("").alias("column"), F.lit("duplicate_rows").alias("kind"),
            F.when(d / n < 0.05, "medium").otherwise("high").alias("severity"),
            F.concat(d.cast("string"), F.lit(" rows repeat an earlier row")).alias("title"),
            F.lit(ACTIONS["duplicate_rows"]).alias("actions"))
        return issues.unionByName(dup)

    def issues(self, limit: int | None = None) -> DataFrame:
        """The issue list, or its first ``limit`` rows: high before medium before low, then by title."""
        rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
        ranked = self.all_issues().orderBy(rank, "title")
        return ((ranked if limit is None else ranked.limit(limit))
                .select("kind", "column", "severity", "title", "actions"))

    def severity_counts(self) -> DataFrame:
        return self.all_issues().groupBy("severity").agg(F.count(F.lit(1)).alias("issues"))

    def score(self) -> DataFrame:
        """One row with the score (5 to 100) and the shares it is built from."""
        penalties = reduce(lambda a, b: a + b, [F.sum(F.col(f"is_{k}").cast("int")) * p for k, p in PENALTY.items()])
        cells = F.sum(F.col("missing")) * 100.0 / F.greatest(F.lit(1), F.max("n_rows") * F.count(F.lit(1)))
        c = self.checks().agg(penalties.cast("double").alias("penalty"), cells.alias("missing_share"))
        both = side_by_side(c, self.facts.duplicates)
        dup = F.col("duplicate_rows") * 100.0 / F.greatest(F.lit(1), F.col("n_rows"))
        raw = (100.0 - F.least(F.lit(35.0), F.col("missing_share") * 1.2)
               - F.least(F.lit(15.0), dup * 2) - F.col("penalty"))
        return both.select(F.greatest(F.lit(5.0), F.least(F.lit(100.0), F.round(raw, 1))).alias("score"),
                           percent(F.col("duplicate_rows"), F.col("n_rows")).alias("duplicate_pct"),
                           F.round("missing_share", 2).alias("missing_pct"), "penalty")


def quality_report(df: DataFrame) -> dict[str, DataFrame]:
    """score, issues, severity counts and the per-column table of one input, off shared facts."""
    q = Quality(df)
    return {"score": q.score(), "issues": q.issues(), "severity_counts": q.severity_counts(), "columns": q.columns()}
