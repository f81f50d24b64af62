"""Column expressions shared by every operator.  All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Labels and patterns the results depend on.
NULL_LABEL = "nan"
PLAIN_NUMBER = r"^-?\d+(\.\d+)?$"
NUMBER_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"

# Date shapes tried in this order: (pattern the text must match, Spark format or None for ISO).
DATE_SHAPES = [
    (r"^\d{4}-\d{1,2}-\d{1,2}([ T].*)?$", None),
    (r"^(19|20)\d{6}$", "yyyyMMdd"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "y/M/d"),
    (r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{2}:\d{2}$", "y/M/d H:mm:ss"),
    (r"^(0?[1-9]|1[0-2])/\d{1,2}/\d{4}$", "M/d/y"),
    (r"^(1[3-9]|2\d|3[01])/\d{1,2}/\d{4}$", "d/M/y"),
    (r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{2}$", "y/M/d H:mm"),
    (r"^(0?[1-9]|1[0-2])/\d{1,2}/\d{4} \d{1,2}:\d{2}$", "M/d/y H:mm"),
    (r"^(0?[1-9]|1[0-2])/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$", "M/d/y H:mm:ss"),
    (r"^(1[3-9]|2\d|3[01])/\d{1,2}/\d{4} \d{1,2}:\d{2}$", "d/M/y H:mm"),
    (r"^(1[3-9]|2\d|3[01])/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$", "d/M/y H:mm:ss"),
    (r"^(0?[1-9]|1[0-2])/\d{1,2}/\d{4} \d{1,2}:\d{2} [AP]M$", "M/d/y h:mm a"),
    (r"^(0?[1-9]|1[0-2])/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2} [AP]M$", "M/d/y h:mm:ss a"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-y"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.y"),
    (r"^\d{1,2} [A-Z][a-z]{2} \d{4}$", "d MMM y"),
    (r"^\d{1,2} [A-Z][a-z]{3,8} \d{4}$", "d MMMM y"),
    (r"^\d{1,2}-[A-Z][a-z]{2}-\d{4}$", "d-MMM-y"),
    (r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$", "MMM d, y"),
    (r"^[A-Z][a-z]{3,8} \d{1,2}, \d{4}$", "MMMM d, y"),
]

INTEGER_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
REAL_TYPES = (T.FloatType, T.DoubleType, T.DecimalType)
NUMERIC_TYPES = INTEGER_TYPES + REAL_TYPES
TIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)
NESTED_TYPES = (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def ref(name: str) -> Column:
    """Column by exact name, whatever characters the name holds."""
    return F.expr(quoted(name))


def distinct_names(names: list[str]) -> list[str]:
    """The names, repeated ones with ``_1``, ``_2``…; names that differ only by case count as repeated."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        fold = name.lower()
        if fold in seen:
            seen[fold] += 1
            name = f"{name}_{seen[fold]}"
        else:
            seen[fold] = 0
        out.append(name)
    return out


def field_type(df: DataFrame, name: str) -> T.DataType:
    if name not in df.columns:
        raise ValueError(f"Column '{name}' not found.")
    return df.schema[name].dataType


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(field_type(df, name), NUMERIC_TYPES)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def finite_sql(name: str) -> str:
    """SQL text of a real column as double with NaN and infinities turned into null."""
    d = f"cast({quoted(name)} as double)"
    return f"if(abs({d}) < double('Infinity'), {d}, null)"  # NaN is larger than any number


def finite(name: str) -> Column:
    return F.expr(finite_sql(name))


def present(df: DataFrame, name: str) -> Column:
    """Value of a column, null where it is missing: NaN and infinities count as missing."""
    t = field_type(df, name)
    return finite(name).cast(t) if isinstance(t, (T.FloatType, T.DoubleType)) else ref(name)


def number_from_text(c: Column) -> Column:
    """Numeric value of a text, null where it is not wholly a number."""
    return F.when(c.rlike(NUMBER_TEXT), F.trim(c).try_cast("double"))


def as_number(df: DataFrame, name: str) -> Column:
    """Double value of a column of any type; text that is no number becomes null."""
    t = field_type(df, name)
    if isinstance(t, INTEGER_TYPES + (T.DecimalType,)):
        return F.expr(f"cast({quoted(name)} as double)")
    if isinstance(t, NUMERIC_TYPES):
        return finite(name)
    if isinstance(t, T.BooleanType):
        return ref(name).cast("int").cast("double")
    if isinstance(t, T.StringType):
        return number_from_text(ref(name))
    raise ValueError(f"Column '{name}' is not numeric.")


def group_key(c: Column, null_label: str = NULL_LABEL) -> Column:
    """Text label of a group; missing values form their own group."""
    return F.coalesce(c.cast("string"), F.lit(null_label))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, EDGE_SPACE, "")


def title_case(c: Column) -> Column:
    """First letter of every run of letters upper, the others lower.

    ``initcap`` only breaks at spaces; here any non-letter starts a new word.
    """
    pieces = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    cased = F.transform(
        pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(p.substr(F.lit(2), F.length(p)))))
    return F.array_join(cased, "")


def time_sql(name: str) -> str:
    """SQL text of the timestamp of a text column by the fixed list of date shapes, null where none fits."""
    text = f"trim({quoted(name)})"
    tries = []
    for shape, fmt in DATE_SHAPES:
        parsed = (f"try_cast({text} as timestamp_ntz)" if fmt is None
                  else f"cast(try_to_timestamp({text}, '{fmt}') as timestamp_ntz)")
        tries.append(f"when {text} rlike r'{shape}' then {parsed}")
    return "case " + " ".join(tries) + " end"


def parse_time(name: str) -> Column:
    return F.expr(time_sql(name))


def as_time(df: DataFrame, name: str) -> Column:
    """timestamp_ntz value of a time or text column; a text column is read in the one format that its values vote for."""
    t = field_type(df, name)
    if isinstance(t, TIME_TYPES):
        return ref(name).cast("timestamp_ntz")
    if isinstance(t, T.StringType):
        from factsieve.plans import dates

        return dates.read(name, dates.formats_of(df, [name])[name])
    raise ValueError(f"Column '{name}' holds no dates.")


def micros(c: Column) -> Column:
    """Microseconds since 1970 of a timestamp_ntz, free of time zones; exact in a double until 2255."""
    seconds = F.unix_date(c.cast("date")) * F.lit(86400).cast("long") + F.hour(c) * 3600 + F.minute(c) * 60
    fraction = F.date_part(F.lit("SECOND"), c) * F.lit(1000000)
    return (seconds * F.lit(1000000).cast("long") + fraction.cast("long")).cast("double")


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """100 * part / whole rounded, 0 for an empty whole."""
    return F.round(F.coalesce(F.try_divide(part * F.lit(100.0), whole), F.lit(0.0)), digits)


def digest(c: Column) -> Column:
    """The text itself when short, else its MD5: an exact grouping key of bounded width."""
    return F.when(F.length(c) > 120, F.concat(F.lit("md5:"), F.md5(c))).otherwise(c)


def hash_number(key: Column, seed: int) -> Column:
    """Reproducible number below 2^52 from a row key and a seed (first 13 hex digits of MD5)."""
    h = F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double")
