"""Reading inputs and bringing them into the form the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factsieve.functions.columns import distinct_names, finite, ref
from factsieve.plans import dates

BYTES_PER_TASK = 128 * 1024 * 1024


def spread(df: DataFrame) -> DataFrame:
    """Deals a small input over all cores.

    A file with a single row group is one task however many cores there are.
    Inputs with enough bytes to fill the cluster are left as they are.
    """
    if not hasattr(df, "_jdf"):  # a remote session: the plan's size is not at hand
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if 1_000_000 < size < cores * BYTES_PER_TASK else df


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spread(spark.read.parquet(path))


def normalized_names(columns: list[str]) -> list[str]:
    """Stripped names; blank and unnamed ones become ``column_{i}``, repeated ones get ``_1``, ``_2``…"""
    out = []
    for i, raw in enumerate(columns):
        name = raw.lstrip("\ufeff").strip()
        out.append(name if name and name != f"_c{i}" else f"column_{i + 1}")
    return distinct_names(out)


def normalize(df: DataFrame) -> DataFrame:
    """Normalised names, and NaN or infinity as null in every real column."""
    named = df.toDF(*normalized_names(df.columns))
    return named.select(*[
        finite(f.name).cast(f.dataType).alias(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else ref(f.name) for f in named.schema.fields])


def coerce_datetimes(df: DataFrame, roles: dict[str, str], formats: dict[str, str | None] | None = None) -> DataFrame:
    """Text columns of role datetime become timestamp_ntz, each read in one format; what that does not read becomes null.

    ``formats`` names the format of each such column; without it the columns vote (``plans.dates``).
    """
    texts = [f.name for f in df.schema.fields if roles.get(f.name) == "datetime" and isinstance(f.dataType, T.StringType)]
    formats = dates.formats_of(df, texts) if formats is None else formats
    return df.select(*[dates.read(c, formats.get(c)).alias(c) if c in texts else ref(c) for c in df.columns])


def check_table(df: DataFrame, max_columns: int | None = None) -> DataFrame:
    """Raises ValueError for an input that cannot be analysed; there is no row cap."""
    if not df.columns:
        raise ValueError("No columns were detected in this input.")
    if max_columns is not None and len(df.columns) > max_columns:
        raise ValueError(f"Input has {len(df.columns)} columns which exceeds the limit of {max_columns}.")
    if df.isEmpty():
        raise ValueError("The input has headers but no data rows.")
    return df


def logical_bytes(df: DataFrame) -> DataFrame:
    """column, pos, bytes: bytes of the values by type (8 per number or time, 1 per boolean, text in UTF-8)."""
    rows = []
    for i, f in enumerate(df.schema.fields):
        c = ref(f.name)
        if isinstance(f.dataType, T.StringType):
            size = F.sum(F.octet_length(c))
        elif isinstance(f.dataType, T.BooleanType):
            size = F.count(c)
        elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
            size = F.sum(F.greatest(F.size(c), F.lit(0))) * 8
        elif isinstance(f.dataType, T.BinaryType):
            size = F.sum(F.octet_length(c))
        else:
            size = F.count(c) * 8
        rows.append(F.struct(F.lit(f.name).alias("column"), F.lit(i).alias("pos"),
                             F.coalesce(size, F.lit(0)).cast("long").alias("bytes")))
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def load(df: DataFrame) -> DataFrame:
    """Checks, normalises and types an input: the usual first step."""
    from factsieve.operators.roles import schema_roles, typed_columns

    checked = normalize(check_table(df))
    if None not in schema_roles(checked).values():
        return checked
    found = typed_columns(checked).collect()
    return coerce_datetimes(checked, {r["column"]: r["role"] for r in found}, {r["column"]: r["date_format"] for r in found})
