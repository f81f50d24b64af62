"""CSV input (encoding and delimiter per file) and sinks."""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factsieve.functions.columns import ref
from factsieve.sources.tables import check_table, normalized_names

# Separators tried, in this order; the first wins a tie.
SEPARATORS = [",", ";", "\t", "|"]
SUFFIXES = (".csv", ".csv.gz", ".tsv", ".tsv.gz", ".txt", ".txt.gz")
QUOTED = r'"(?:[^"]|"")*"'


def detect_delimiters(spark: SparkSession, path: str) -> DataFrame:
    """file, delimiter, columns: the separator that splits every file of a directory most consistently.

    Separators inside quotes do not count.  Comma is kept unless another one gives
    strictly more columns in at least as many lines.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    bare = F.regexp_replace("value", QUOTED, "")
    cells = F.array(*[
        F.struct(F.lit(i).alias("pick"), F.lit(s).alias("delimiter"),
                 (F.length(bare) - F.length(F.replace(bare, F.lit(s))) + 1).alias("columns"))
        for i, s in enumerate(SEPARATORS)])
    widths = (lines.where(F.length("value") > 0).select("file", F.inline(cells))
              .groupBy("file", "pick", "delimiter", "columns").agg(F.count(F.lit(1)).alias("lines")))
    per_sep = widths.groupBy("file", "pick", "delimiter").agg(
        F.max_by("columns", F.struct("lines", "columns")).alias("columns"), F.max("lines").alias("agreeing"),
        F.sum("lines").alias("lines"))
    steady = F.when((F.col("columns") > 1) & (F.col("agreeing") * 10 >= F.col("lines") * 9), F.col("columns")).otherwise(1)
    best = per_sep.withColumn("columns", steady).groupBy("file").agg(
        F.max_by("delimiter", F.struct("columns", -F.col("pick"))).alias("delimiter"),
        F.max("columns").cast("long").alias("columns"))
    return best.withColumn("delimiter", F.when(F.col("columns") == 1, ",").otherwise(F.col("delimiter")))


def detect_encodings(spark: SparkSession, path: str) -> DataFrame:
    """file, encoding: UTF-8 (with or without byte order mark) where every line is valid UTF-8, else ISO-8859-1.

    Lines are read as bytes, so a file of any size is spread over many tasks.
    """
    lines = spark.read.format("text").load(path).select(
        F.col("_metadata.file_path").alias("file"), "value")  # the text source keeps the raw bytes
    seen = lines.groupBy("file").agg(
        F.bool_and(F.is_valid_utf8("value")).alias("valid"),
        F.bool_or(F.col("value").startswith("﻿")).alias("marked"))
    return seen.select("file", F.when(~F.col("valid"), "iso-8859-1").when(F.col("marked"), "utf-8-sig")
                       .otherwise("utf-8").alias("encoding"))


def has_line_breaks(spark: SparkSession, path: str | list[str]) -> bool:
    """Whether a quoted value runs over a line end somewhere (a line with an odd number of quotes)."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    return not spark.read.text(path).where(quotes % 2 == 1).limit(1).isEmpty()


def file_kinds(spark: SparkSession, path: str) -> DataFrame:
    """file, delimiter, encoding of every file."""
    return detect_delimiters(spark, path).join(detect_encodings(spark, path), "file").select("file", "delimiter", "encoding")


def _read_alike(spark: SparkSession, path: str | list[str], encoding: str, delimiter: str, infer: bool) -> DataFrame:
    """Files of one encoding and separator, names as written and normalised."""
    charset = {"utf-8-sig": "utf-8", "latin-1": "iso-8859-1", "cp1252": "iso-8859-1"}.get(encoding, encoding)
    options = {"sep": delimiter, "encoding": charset, "escape": '"', "multiLine": has_line_breaks(spark, path)}
    df = spark.read.csv(path, header=True, inferSchema=infer, **options)
    names = df.columns
    first = spark.read.csv(path, header=False, **options).first()  # the names as written, before Spark renames repeated ones
    if first is not None and len(first) == len(names):
        names = [v or "" for v in first]
    return df.toDF(*normalized_names(names))


def _common_type(kinds: set[str]) -> str:
    for family, result in ((("int", "bigint"), "bigint"), (("int", "bigint", "double"), "double"), (("date", "timestamp"), "timestamp")):
        if kinds <= set(family):
            return result
    return kinds.pop() if len(kinds) == 1 else "string"


def read_csv(spark: SparkSession, path: str, encoding: str | None = None, delimiter: str | None = None) -> DataFrame:
    """CSV with a header: names normalised, types inferred.

    Encoding and separator are found per file unless given; files that agree are read together, and the groups are united by
    name in their common types.  Files of one kind have the same header.  Files are split over tasks unless some value really
    holds a line break.
    """
    check_path(path)
    if encoding and delimiter:
        return check_table(_read_alike(spark, path, encoding, delimiter, True))
    kinds = file_kinds(spark, path).groupBy(
        F.lit(delimiter).alias("delimiter") if delimiter else F.col("delimiter"),
        F.lit(encoding).alias("encoding") if encoding else F.col("encoding")).agg(F.sort_array(F.collect_list("file")).alias("files"))
    groups = kinds.orderBy(F.desc(F.size("files")), "delimiter", "encoding").collect()
    if not groups:
        raise ValueError("The input is empty.")
    if len(groups) == 1:
        return check_table(_read_alike(spark, path, groups[0]["encoding"], groups[0]["delimiter"], True))
    parts = [([unquote(f) for f in g["files"]], g["encoding"], g["delimiter"]) for g in groups]
    typed = [_read_alike(spark, *p, True).dtypes for p in parts]
    kinds_of: dict[str, set[str]] = {}
    for name, kind in (c for t in typed for c in t):
        kinds_of.setdefault(name, set()).add(kind)
    texts = [_read_alike(spark, *p, False) for p in parts]
    united = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), texts)
    return check_table(united.select(*[ref(c).try_cast(_common_type(kinds_of[c])).alias(c) for c in united.columns]))


def check_path(path: str) -> str:
    """Refuses a file whose ending tells that it holds no delimited text; folders and patterns pass."""
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    if "." in name and not any(c in name for c in "*?{[") and not name.endswith(SUFFIXES):
        raise ValueError(f"'{name}' is no delimited text file; known endings are {', '.join(SUFFIXES)}.")
    return path


def write(df: DataFrame, path: str, kind: str = "parquet") -> str:
    """Writes a result table as parquet, csv, json or orc."""
    if kind not in ("parquet", "csv", "json", "orc"):
        raise ValueError(f"Unknown sink '{kind}'.")
    options = {"header": "true", "escape": '"'} if kind == "csv" else {}
    df.write.format(kind).options(**options).save(path)
    return path
