"""One date format for each text column, by a vote of all its values.

Every format counts the values that have its shape and those that it reads.  Formats of one family share a shape (day or month first, say);
a value that one of them cannot read strikes it out against its siblings, however many other values both can read.  The column takes the
format that reads most values, the earlier one in the list where two read as many; what it cannot read is missing.  The votes
are one aggregate over the distinct values, so a column is read in one way by every task, on a stream too.

``status`` says how sure that is: ``clear``; ``ambiguous`` where a sibling reads all the same values (no number above 12 decides);
``mixed`` where other formats read values that the chosen one does not; ``none`` where no value is a date.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factsieve.functions.columns import quoted, string_columns


@dataclass(frozen=True)
class Format:
    name: str
    shape: str
    pattern: str | None  # None: ISO, read by a cast


_TIME = r"( \d{1,2}:\d{2}(:\d{2})?)?"
_CLOCK = "[ H:mm[:ss]]"
_HALF = r" \d{1,2}:\d{2}(:\d{2})? [AP]M"
_NUMBERS = r"^\d{{1,2}}{0}\d{{1,2}}{0}\d{{4}}"
_SLASH, _DASH, _DOT = (_NUMBERS.format(s) for s in ("/", "-", r"\."))

#: Fixed order: of siblings that read the same values the first is taken. Points mean day first, other separators month first.
FORMATS = (
    Format("year-month-day", r"^\d{4}-\d{1,2}-\d{1,2}([ T].*)?$", None),
    Format("yearmonthday", r"^(19|20)\d{6}$", "yyyyMMdd"),
    Format("year/month/day", rf"^\d{{4}}/\d{{1,2}}/\d{{1,2}}{_TIME}$", f"y/M/d{_CLOCK}"),
    Format("month/day/year", f"{_SLASH}{_TIME}$", f"M/d/y{_CLOCK}"),
    Format("day/month/year", f"{_SLASH}{_TIME}$", f"d/M/y{_CLOCK}"),
    Format("month/day/year am", f"{_SLASH}{_HALF}$", "M/d/y h:mm[:ss] a"),
    Format("day/month/year am", f"{_SLASH}{_HALF}$", "d/M/y h:mm[:ss] a"),
    Format("month-day-year", f"{_DASH}{_TIME}$", f"M-d-y{_CLOCK}"),
    Format("day-month-year", f"{_DASH}{_TIME}$", f"d-M-y{_CLOCK}"),
    Format("day.month.year", f"{_DOT}{_TIME}$", f"d.M.y{_CLOCK}"),
    Format("month.day.year", f"{_DOT}{_TIME}$", f"M.d.y{_CLOCK}"),
    Format("day mon year", rf"^\d{{1,2}} [A-Z][a-z]{{2}} \d{{4}}{_TIME}$", f"d MMM y{_CLOCK}"),
    Format("day month year", rf"^\d{{1,2}} [A-Z][a-z]{{3,8}} \d{{4}}{_TIME}$", f"d MMMM y{_CLOCK}"),
    Format("day-mon-year", rf"^\d{{1,2}}-[A-Z][a-z]{{2}}-\d{{4}}{_TIME}$", f"d-MMM-y{_CLOCK}"),
    Format("mon day, year", rf"^[A-Z][a-z]{{2}} \d{{1,2}}, \d{{4}}{_TIME}$", f"MMM d, y{_CLOCK}"),
    Format("month day, year", rf"^[A-Z][a-z]{{3,8}} \d{{1,2}}, \d{{4}}{_TIME}$", f"MMMM d, y{_CLOCK}"),
)
BY_NAME = {f.name: f for f in FORMATS}
_VOTES = "array<struct<parsed:bigint,place:int,name:string,family:string,held:bigint>>"


def read_sql(name: str, fmt: str | None) -> str:
    """SQL text of the timestamp_ntz of a text column in the named format; null for what it cannot read, or without a format."""
    if fmt is None:
        return "cast(null as timestamp_ntz)"
    f, text = BY_NAME[fmt], f"trim({quoted(name)})"
    return f"case when {text} rlike r'{f.shape}' then {_value_sql(text, f)} end"


def _value_sql(text: str, f: Format) -> str:
    return f"try_cast({text} as timestamp_ntz)" if f.pattern is None else f"cast(try_to_timestamp({text}, '{f.pattern}') as timestamp_ntz)"


def read(name: str, fmt: str | None) -> Column:
    return F.expr(read_sql(name, fmt))


SHAPES = list(dict.fromkeys(f.shape for f in FORMATS))
SIBLINGS = [[f for f in FORMATS if f.shape == shape] for shape in SHAPES]


def looked(text: str) -> dict[str, Column]:
    """Per value: the number of its shape, and whether the first and the second format of that shape read it."""
    bare = f"trim({quoted(text)})"
    shapes = " ".join(f"when {bare} rlike r'{s}' then {i}" for i, s in enumerate(SHAPES))

    def reads(which: int) -> Column:
        tries = " ".join(f"when {i} then {_value_sql(bare, fs[which])} is not null" for i, fs in enumerate(SIBLINGS) if which < len(fs))
        return F.expr(f"coalesce(case _shape {tries} end, false)")

    # every format needs a digit and eight characters at least
    return {"_shape": F.expr(f"case when length({bare}) >= 8 and {bare} rlike r'\\d' then case {shapes} end end"), "_first": reads(0), "_second": reads(1)}


def judged(rows: DataFrame, text: str) -> DataFrame:
    """The rows with the columns of ``looked``."""
    columns = looked(text)
    return rows.withColumn("_shape", columns["_shape"]).withColumns({c: columns[c] for c in ("_first", "_second")})


def votes(weight: str) -> Column:
    """Aggregate over rows with the columns of ``looked``: for each format the values it reads and those of its shape, in an array."""
    counted = []
    for i, formats in enumerate(SIBLINGS):
        mine = F.col("_shape") == i
        held = F.sum(F.when(mine, F.col(weight)).otherwise(0))
        for f, hit in zip(formats, ("_first", "_second")):
            counted.append(F.struct(F.sum(F.when(mine & F.col(hit), F.col(weight)).otherwise(0)).alias("parsed"), F.lit(-FORMATS.index(f)).alias("place"),
                                    F.lit(f.name).alias("name"), F.lit(f.shape).alias("family"), held.alias("held")))
    return F.array(*counted).cast(_VOTES)


def verdict(found: Column) -> Column:
    """Struct (format, parsed, status, rival) of an array of votes."""
    best = F.array_max(found)
    siblings = F.filter(found, lambda v: (v["family"] == best["family"]) & (v["name"] != best["name"]) & (v["parsed"] > 0))
    rival = F.array_max(siblings)
    other = F.exists(found, lambda v: (v["family"] != best["family"]) & (v["parsed"] > 0))
    sibling_reads_more = (best["held"] > best["parsed"]) & (F.size(siblings) > 0)
    status = (F.when(best["parsed"] == 0, "none").when(other | sibling_reads_more, "mixed")
              .when(rival["parsed"] == best["parsed"], "ambiguous").otherwise("clear"))
    return F.struct(F.when(best["parsed"] > 0, best["name"]).alias("format"), best["parsed"].alias("parsed"), status.alias("status"),
                    F.when(best["parsed"] > 0, rival["name"]).alias("rival"))


def date_formats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, pos, n, format, parsed, unread, status, rival: how each text column would be read as dates, one row per column.

    ``unread`` values become missing; ``rival`` is the sibling format that reads most of the same values.  A column without values
    has n 0 and status ``none``.
    """
    columns = string_columns(df) if columns is None else columns
    base = df.sparkSession.createDataFrame([(c, df.columns.index(c)) for c in columns], "column string, pos int")
    cells = [F.struct(F.lit(c).alias("column"), F.expr(f"trim({quoted(c)})").alias("text")) for c in columns]
    if not cells:
        return base.selectExpr("column", "pos", "0L n", "string(null) format", "0L parsed", "0L unread", "'none' status", "string(null) rival")
    counted = df.select(F.inline(F.array(*cells))).where("text is not null").select(
        "column", F.when(F.length("text") <= 64, F.col("text")).alias("text")).groupBy("column", "text").agg(F.count(F.lit(1)).alias("cnt"))
    voted = judged(counted, "text").groupBy("column").agg(F.sum("cnt").alias("n"), votes("cnt").alias("votes")).select(
        "column", "n", verdict(F.col("votes")).alias("v"))
    return base.join(voted, "column", "left").select(
        "column", "pos", F.coalesce("n", F.lit(0)).alias("n"), F.col("v.format").alias("format"), F.coalesce("v.parsed", F.lit(0)).alias("parsed"),
        (F.coalesce("n", F.lit(0)) - F.coalesce("v.parsed", F.lit(0))).alias("unread"), F.coalesce("v.status", F.lit("none")).alias("status"),
        F.col("v.rival").alias("rival"))


def formats_of(df: DataFrame, columns: list[str]) -> dict[str, str | None]:
    """The format of each text column; one row per column reaches the driver."""
    return {r["column"]: r["format"] for r in date_formats(df, columns).collect()} if columns else {}
