"""Files written from the given tables and read back, for the queries on sources and sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factsieve.functions.columns import ref
from factsieve.plans.store import new_path
from factsieve.sources.files import SEPARATORS, detect_delimiters, detect_encodings, read_csv, write
from factsieve.sources.tables import check_table


def csv_roundtrip(df: DataFrame) -> DataFrame:
    """What comes back after writing ``df`` as CSV, in the types it had."""
    back = read_csv(df.sparkSession, write(df, new_path(df.sparkSession, "csv"), "csv"))
    return back.select(*[ref(f.name).cast(f.dataType).alias(f.name) for f in df.schema.fields])


def delimiter_demo(inputs: dict[str, DataFrame]) -> DataFrame:
    """Writes each input with its own separator and reports what is detected per input."""
    parts = []
    for sep, (name, df) in zip(SEPARATORS, inputs.items()):
        path = new_path(df.sparkSession, "delimited")
        df.write.csv(path, header=True, sep=sep)
        found = detect_delimiters(df.sparkSession, path)
        parts.append(found.groupBy("delimiter", "columns").agg(F.count(F.lit(1)).alias("files"))
                     .select(F.lit(name).alias("input"), "delimiter", "columns", (F.col("files") > 0).alias("found")))
    return reduce(DataFrame.unionByName, parts)


def encoding_demo(df: DataFrame) -> DataFrame:
    """Writes texts with an accented letter in two encodings and reports what is detected."""
    text = F.concat_ws(",", *[ref(c).cast("string") for c in df.columns], F.lit("café"))
    parts = []
    for charset in ("UTF-8", "ISO-8859-1"):
        path = new_path(df.sparkSession, "encoded")
        df.select(text.alias("value")).write.option("encoding", charset).option("header", "false").csv(path)
        found = detect_encodings(df.sparkSession, path)
        parts.append(found.groupBy("encoding").agg(F.count(F.lit(1)).alias("n"))
                     .select(F.lit(charset).alias("written"), "encoding", (F.col("n") > 0).alias("found")))
    return reduce(DataFrame.unionByName, parts)


def guard_report(inputs: dict[str, DataFrame]) -> DataFrame:
    """input, n_columns, outcome of the load checks for each input and for it without rows."""
    spark, rows = next(iter(inputs.values())).sparkSession, []
    for name, df in inputs.items():
        for label, candidate, limit in ((name, df, None), (f"{name}/none", df.where("1 = 0"), None), (f"{name}/wide", df, 2)):
            try:
                check_table(candidate, limit)
                outcome = "ok"
            except ValueError as e:
                outcome = str(e)
            rows.append((label, len(df.columns), outcome))
    return spark.createDataFrame(rows, "input string, n_columns bigint, outcome string")


def sink_roundtrip(df: DataFrame) -> DataFrame:
    """The rows read back from every kind of sink, with the sink's name."""
    spark, parts = df.sparkSession, []
    for kind in ("parquet", "csv", "json", "orc"):
        path = write(df, new_path(spark, f"sink-{kind}"), kind)
        options = {"header": "true", "escape": '"'} if kind == "csv" else {}
        back = spark.read.schema(df.schema).options(**options).format(kind).load(path)
        parts.append(back.select(F.lit(kind).alias("sink"), *[ref(c) for c in df.columns]))
    return reduce(DataFrame.unionByName, parts)


def _as_before(back: DataFrame, df: DataFrame) -> DataFrame:
    return back.select(*[ref(f.name).cast(f.dataType).alias(f.name) for f in df.schema.fields])


def latin1(df: DataFrame, column: str) -> DataFrame:
    """``df`` with an accented word in front of a text column, written in ISO-8859-1 and read back."""
    marked = df.withColumn(column, F.concat(F.lit("café "), ref(column)))
    path = new_path(df.sparkSession, "latin1")
    marked.write.option("encoding", "ISO-8859-1").csv(path, header=True)
    return _as_before(read_csv(df.sparkSession, path), df)


def mixed_folder(df: DataFrame, key: str, column: str) -> DataFrame:
    """A third of ``df`` each written with commas, semicolons (ISO-8859-1) and tabs into one folder and read back together."""
    path, marked = new_path(df.sparkSession, "mixed"), df.withColumn(column, F.concat(F.lit("café "), ref(column)))
    for i, (sep, charset) in enumerate(((",", "UTF-8"), (";", "ISO-8859-1"), ("\t", "UTF-8"))):
        marked.where(ref(key) % 3 == i).write.option("encoding", charset).csv(f"{path}/part{i}", header=True, sep=sep)
    return _as_before(read_csv(df.sparkSession, f"{path}/*"), df)
