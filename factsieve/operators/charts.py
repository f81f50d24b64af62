"""The aggregate behind each chart mark, over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factsieve.functions.columns import NULL_LABEL, as_number, as_time, group_key, is_numeric, ref
from factsieve.operators.quality import fences
from factsieve.plans.moments import long_numbers
from factsieve.plans.quantiles import QUARTILES, quantiles
from factsieve.plans.sampling import bottom_k
from factsieve.plans.store import materialize

LABEL = 40          # fixed values: limits of what a chart shows
SCATTER_POINTS = 5000
BOX_GROUPS = 12
SERIES, SERIES_X = 6, 30
PIE_SLICES = 12

SIMPLE = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count}


def histogram(df: DataFrame, column: str, bins: int = 30, clamp: bool = True) -> DataFrame:
    """bin, low, high, count: equal-width bins, the last one closed, empty bins included."""
    bins = min(60, max(5, bins)) if clamp else bins
    x = as_number(df, column)
    span = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    if span["lo"] is None:
        raise ValueError(f"{column!r} holds no number")
    lo, hi = span["lo"], span["hi"]
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    at = F.least(F.floor((x - F.lit(lo)) / F.lit(width)).cast("int"), F.lit(bins - 1))
    counted = df.where(x.isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return spine.join(counted, "bin", "left").select(
        "bin", (F.col("bin") * F.lit(width) + F.lit(lo)).alias("low"),
        ((F.col("bin") + 1) * F.lit(width) + F.lit(lo)).alias("high"), F.coalesce("count", F.lit(0)).alias("count"))


def _box(values: DataFrame) -> DataFrame:
    """Five numbers, fences and outlier count per ``group`` of (group, value)."""
    found = quantiles(values, ["group"], "value", QUARTILES, also={"min": "min(_v)", "max": "max(_v)"}).where("n > 0")
    q = materialize(fences(found), "boxes")
    outside = (F.col("value") < F.col("low")) | (F.col("value") > F.col("high"))
    counted = (values.where("value is not null").join(q.select("group", "low", "high"), "group")
               .groupBy("group").agg(F.count_if(outside).alias("outliers")))
    return q.join(counted, "group").select("group", "n", "min", "q1", "median", "q3", "max", "low", "high", "outliers")


def box(df: DataFrame, column: str) -> DataFrame:
    return _box(long_numbers(df, [column], "group"))


def box_grouped(df: DataFrame, column: str, group: str, null_label: str = NULL_LABEL) -> DataFrame:
    """Box numbers for the 12 most frequent groups; ``dropped_groups`` and ``dropped_rows`` tell what is not shown."""
    label = group_key(ref(group), null_label)
    top, groups, rows = _most_frequent(df, label, BOX_GROUPS)
    kept = df.where(label.isin(list(top)))
    return _box(kept.select(label.alias("group"), as_number(df, column).alias("value"))).withColumns({
        "group": F.substring("group", 1, LABEL), "dropped_groups": F.lit(groups - len(top)).cast("long"),
        "dropped_rows": F.lit(rows - sum(top.values())).cast("long")})


def _most_frequent(df: DataFrame, label: Column, k: int) -> tuple[dict[str, int], int, int]:
    """The k most frequent labels with their rows, the number of all labels, and of all rows."""
    counted = materialize(df.groupBy(label.alias("v")).agg(F.count(F.lit(1)).alias("c")), "labels")
    total = counted.agg(F.count(F.lit(1)).alias("labels"), F.coalesce(F.sum("c"), F.lit(0)).alias("rows")).first()
    rows = counted.orderBy(F.desc("c"), "v").limit(k).collect()
    return {r["v"]: r["c"] for r in rows}, total["labels"], total["rows"]


def scatter(df: DataFrame, x: str, y: str, key: list[str], color: str | None = None,
            points: int = SCATTER_POINTS, seed: int = 7) -> DataFrame:
    """Points with both values present, at most ``points`` of them by hash order of the row key."""
    more = [] if color is None else [F.substring(group_key(ref(color)), 1, LABEL).alias("color")]
    rows = df.select(*[ref(k) for k in key], as_number(df, x).alias("x"), as_number(df, y).alias("y"), *more)
    return bottom_k(rows.where("x is not null and y is not null"), key, points, seed)


def _aggregate(values: DataFrame, keys: list[str], agg: str) -> DataFrame:
    """keys, y: one aggregate of ``value`` per key; the median is exact."""
    if agg != "median":
        how = SIMPLE.get(agg, F.avg)
        y = how("value")
        if agg == "sum":
            y = F.coalesce(y, F.lit(0.0))
        return values.groupBy(*keys).agg(y.cast("double").alias("y"))
    return quantiles(values, keys, "value", {"y": 0.5}).select(*keys, "y")


def by_category(df: DataFrame, x: str, y: str, agg: str = "mean", top_n: int = 15,
                null_label: str = NULL_LABEL) -> DataFrame:
    """x, y for the top_n categories by value."""
    values = df.select(group_key(ref(x), null_label).alias("x"), as_number(df, y).alias("value"))
    return (_aggregate(values, ["x"], agg).orderBy(F.col("y").desc_nulls_last(), "x").limit(top_n)
            .select(F.substring("x", 1, LABEL).alias("x"), "y"))


def grouped_series(df: DataFrame, x: str, y: str, group: str, agg: str = "mean", null_label: str = NULL_LABEL) -> DataFrame:
    """series, x, y for the 6 most frequent groups over the 30 most frequent x; missing pairs give null.

    ``dropped_series`` and ``dropped_x`` are the numbers of groups and of x values that are not shown.
    """
    gx, gg = group_key(ref(x), null_label), group_key(ref(group), null_label)
    (xs, all_x, _), (gs, all_series, _) = _most_frequent(df, gx, SERIES_X), _most_frequent(df, gg, SERIES)
    xs, gs = list(xs), list(gs)
    values = df.select(gx.alias("x"), gg.alias("series"), as_number(df, y).alias("value")).where(
        F.col("x").isin(xs) & F.col("series").isin(gs))
    found = _aggregate(values, ["series", "x"], agg)
    spine = df.sparkSession.createDataFrame([(g, v) for g in gs for v in xs], "series string, x string")
    seen = found.select("x").distinct()
    return (spine.join(seen, "x", "left_semi").join(found, ["series", "x"], "left")
            .select(F.substring("series", 1, LABEL).alias("series"), "x", "y", F.lit(all_series - len(gs)).cast("long").alias("dropped_series"),
                    F.lit(all_x - len(xs)).cast("long").alias("dropped_x")))


PERIODS = {"month": "1 month", "week": "7 days", "day": "1 day"}


def period_start(t: Column, period: str) -> Column:
    return F.date_trunc(period, t).cast("timestamp_ntz")


def period_label(start: Column, period: str) -> Column:
    """Last day of the period: month end, the Sunday of the week, or the day itself."""
    day = start.cast("date")
    return F.last_day(day) if period == "month" else F.date_add(day, 6) if period == "week" else day


def choose_period(days: int) -> str:
    return "month" if days > 120 else "week" if days > 21 else "day"


def time_series(df: DataFrame, time: str, y: str, agg: str = "mean", period: str | None = None) -> DataFrame:
    """period, y: one row per month, week or day between the first and last date, empty ones included."""
    t = as_time(df, time)
    span = df.agg(F.min(t).alias("lo"), F.max(t).alias("hi")).first()
    if span["lo"] is None:
        raise ValueError(f"{time!r} holds no date")
    period = period or choose_period((span["hi"] - span["lo"]).days)
    values = df.where(t.isNotNull()).select(
        period_label(period_start(t, period), period).alias("period"), as_number(df, y).alias("value"))
    found = _aggregate(values, ["period"], agg)
    ends = [F.lit(span[k]).cast("timestamp_ntz") for k in ("lo", "hi")]
    starts = F.sequence(*[period_start(e, period).cast("date") for e in ends], F.expr(f"interval {PERIODS[period]}"))
    spine = df.sparkSession.range(1).select(F.explode(starts).alias("s")).select(
        period_label(F.col("s"), period).alias("period"))
    y_out = F.coalesce("y", F.lit(0.0)) if agg in ("sum", "count") else F.col("y")
    return spine.join(found, "period", "left").select(F.col("period").cast("timestamp_ntz").alias("period"), y_out.alias("y"))


def frequency(df: DataFrame, x: str, top_n: int = 15, null_label: str = NULL_LABEL) -> DataFrame:
    """x, count for the top_n values, missing counted as a value."""
    counts = df.groupBy(group_key(ref(x), null_label).alias("x")).agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), "x").limit(top_n).select(F.substring("x", 1, LABEL).alias("x"), "count")


def pie(df: DataFrame, x: str, null_label: str = NULL_LABEL) -> DataFrame:
    """x, count; more than 12 categories are refused."""
    counts = frequency(df, x, PIE_SLICES + 1, null_label)
    if counts.count() > PIE_SLICES:
        raise ValueError(f"a pie of {x!r} would have over {PIE_SLICES} slices")
    return counts


def _heatmap(df: DataFrame, method: str = "pearson") -> DataFrame:
    from factsieve.operators.eda import correlation_matrix

    return correlation_matrix(df, method)


def _by_x(df: DataFrame, x: str, y: str | None = None, group: str | None = None, agg: str = "mean", top_n: int = 15,
          in_order: bool = False) -> DataFrame:
    """Counts of x without a number to aggregate, else y by x (and group), over time where x is one."""
    from factsieve.operators.roles import role_map

    if y is None or not is_numeric(df, y):
        return frequency(df, x, top_n)
    if group is not None:
        return grouped_series(df, x, y, group, agg)
    if role_map(df.select(ref(x)))[x] == "datetime":
        return time_series(df, x, y, agg)
    bars = by_category(df, x, y, agg, top_n)
    return bars.orderBy("x") if in_order else bars


#: Per kind of chart its table and the options that it takes, required ones first.
CHARTS = {
    "histogram": (lambda df, x, bins=30: histogram(df, x, bins), ("x", "bins")),
    "box": (lambda df, y, group=None: box_grouped(df, y, group) if group else box(df, y), ("y", "group")),
    "scatter": (lambda df, x, y, key=None, group=None: scatter(df, x, y, key or df.columns, group), ("x", "y", "key", "group")),
    "pie": (lambda df, x: pie(df, x), ("x",)),
    "donut": (lambda df, x: pie(df, x), ("x",)),
    "heatmap": (_heatmap, ("method",)),
    "bar": (_by_x, ("x", "y", "group", "agg", "top_n")),
    "line": (lambda df, **o: _by_x(df, **o, in_order=True), ("x", "y", "group", "agg", "top_n")),
    "area": (lambda df, **o: _by_x(df, **o, in_order=True), ("x", "y", "group", "agg", "top_n")),
}
#: Options that stand in for one that is not given.
STAND_INS = {"histogram": {"x": "y"}, "pie": {"x": "group"}, "donut": {"x": "group"}}


def build_chart(df: DataFrame, spec: dict) -> DataFrame:
    """The table of a chart; ``spec`` holds its ``type`` (a bar chart if none) and that kind's options, empty ones count as not given."""
    given = {k: v.lower() if k in ("type", "agg") else v for k, v in spec.items() if v not in (None, "")}
    kind = given.pop("type", "bar")
    if kind not in CHARTS:
        raise ValueError(f"no chart is of type {kind!r}; known are {sorted(CHARTS)}")
    table, options = CHARTS[kind]
    for option, other in STAND_INS.get(kind, {}).items():
        given.setdefault(option, given.get(other))
    return table(df, **{o: int(given[o]) if o in ("bins", "top_n") else given[o] for o in options if o in given})
