"""Exact order statistics without sorting the data.

A KLL sketch brackets every wanted rank with a wide safety margin.  Values inside a
bracket stay as they are, everything between two brackets collapses to one counted
cell while it is still on the map side, so the shuffle carries about a hundredth of the
values per rank.  The wanted values are then read off the running total over that small
table.  The sketch only sets how much is shuffled: a rank outside its bracket (some
eight standard deviations away) fails the query instead of giving a wrong value.
Equal values collapse to one row, so a value held by a third of all rows costs nothing
extra.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factsieve.functions.columns import quoted, ref
from factsieve.plans.ordering import ROWS_PER_SLICE, running_total
from factsieve.plans.store import materialize

SKETCH_K = 2_000           # sketch size: some 50 kB per task and key, cheap to merge from very many tasks
MARGIN = 0.0045            # bracket half-width in rank share: over three times the sketch's 99% error (2.3 / k^0.97)
WHOLE_GROUP = 10_000       # groups up to this size are bracketed whole

Rank = tuple[str, float, str]


def order_statistics(values: DataFrame, keys: list[str], value: str, ranks: list[Rank],
                     rows_per_slice: int = ROWS_PER_SLICE, also: dict[str, str] | None = None) -> DataFrame:
    """Per key the values at the given 0-based ranks among the non-null ``value`` (double).

    ``ranks`` holds (output column, share of n where the rank lies, SQL text of the rank in terms of n).
    ``also`` names further aggregates over ``_v`` that ride along with the sketch, at no further scan.
    Returns keys, n, those aggregates and one column per rank; n is 0 for a key without values.
    Keys must not be null.
    """
    by, also = [ref(k) for k in keys], also or {}
    cells = values.select(*by, F.expr(f"{quoted(value)} as _v"))
    present = cells.where("_v is not null")
    shares = sorted({share for _, share, _ in ranks})
    edges = [e for s in shares for e in (max(0.0, s - MARGIN), min(1.0, s + MARGIN))]
    sketch = cells.groupBy(*by).agg(
        F.expr("count(_v) as n"), *[F.expr(f"{e} as {quoted(c)}") for c, e in also.items()],
        F.expr(f"kll_sketch_agg_double(_v, {SKETCH_K}) as _s"))
    bounds = []
    for i in range(len(shares)):
        low, high = edges[2 * i] <= 0.0, edges[2 * i + 1] >= 1.0
        bounds.append(f"if(n <= {WHOLE_GROUP} or {low}, double('-Infinity'), kll_sketch_get_quantile_double(_s, {edges[2 * i]!r}D)) as _lo{i}")
        bounds.append(f"if(n <= {WHOLE_GROUP} or {high}, double('Infinity'), kll_sketch_get_quantile_double(_s, {edges[2 * i + 1]!r}D)) as _hi{i}")
    brackets = materialize(sketch.select(*by, "n", *[ref(c) for c in also], *[F.expr(b) for b in bounds]), "brackets")

    inside = " or ".join(f"(_v >= _lo{i} and _v <= _hi{i})" for i in range(len(shares)))
    gap = " + ".join(f"cast(_v > _hi{i} as int)" for i in range(len(shares)))
    marked = present.join(brackets.drop(*also), keys).select(
        *by, "n", "_v", F.expr(f"if({inside}, _v, null) as _point"), F.expr(f"{gap} as _gap"))
    counted = (marked.groupBy(*by, "n", "_gap", "_point").agg(F.expr("max(_v) as _at"), F.expr("count(1) as _cnt"))
               .select(*by, "n", "_at", F.expr("_point is not null as _exact"), "_cnt"))
    placed = running_total(materialize(counted, "cells"), keys, ["_at"], "_cnt", "_before", rows_per_slice)

    wanted = ", ".join(f"named_struct('i', {i}, 'r', cast(greatest(0, least({rank}, n - 1)) as bigint))"
                       for i, (_, _, rank) in enumerate(ranks))
    hit = placed.select(*by, "n", "_at", "_exact", F.expr(
        f"inline(filter(array({wanted}), t -> t.r >= _before and t.r < _before + _cnt))"))
    checked = "if(_exact, _at, cast(raise_error('order statistic fell outside its bracket') as double))"
    picked = hit.groupBy(*by).agg(*[
        F.expr(f"max(if(i = {i}, {checked}, null)) as {quoted(name)}") for i, (name, _, _) in enumerate(ranks)])
    return brackets.select(*by, "n", *[ref(c) for c in also]).join(picked, keys, "left")


def quantiles(values: DataFrame, keys: list[str], value: str, shares: dict[str, float],
              rows_per_slice: int = ROWS_PER_SLICE, also: dict[str, str] | None = None) -> DataFrame:
    """Per key the linearly interpolated quantiles ``{column: share}``, with n (and the aggregates of ``also``)."""
    ranks: list[Rank] = []
    for name, p in shares.items():
        ranks.append((f"_{name}_a", p, f"floor((n - 1) * {p!r}D)"))
        ranks.append((f"_{name}_b", p, f"ceil((n - 1) * {p!r}D)"))
    found = order_statistics(values, keys, value, ranks, rows_per_slice, also)
    out = []
    for name, p in shares.items():
        place = f"(n - 1) * {p!r}D"
        out.append(F.expr(f"_{name}_a + (_{name}_b - _{name}_a) * ({place} - floor({place})) as {name}"))
    return found.select(*[ref(k) for k in keys], "n", *[ref(c) for c in also or {}], *out)


QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}
