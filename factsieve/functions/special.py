"""Tail probabilities of test statistics, as Arrow UDFs over already aggregated rows.

Regularised incomplete beta and gamma by continued fraction and series; no SciPy.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TINY = 1e-300


def _lgamma(values):
    return np.array([math.lgamma(v) for v in np.ravel(values)]).reshape(np.shape(values))


def _beta_fraction(a, b, x):
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
    h = d.copy()
    for m in range(1, 2000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = 1.0 + num / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1.0) < 1e-15):
            break
    return h


def beta_cdf(a, b, x):
    """I_x(a, b) elementwise."""
    a, b, x = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(a, b, x))
    x = np.clip(x, 0.0, 1.0)
    inner = np.clip(x, _TINY, 1.0 - 1e-16)
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(inner) + b * np.log1p(-inner))
    low = inner < (a + 1.0) / (a + b + 2.0)
    value = np.where(low, front * _beta_fraction(a, b, np.where(low, inner, 0.5)) / a,
                     1.0 - front * _beta_fraction(b, a, np.where(low, 0.5, 1.0 - inner)) / b)
    return np.where(x <= 0.0, 0.0, np.where(x >= 1.0, 1.0, value))


def gamma_tail(s: float, x: float) -> float:
    """Upper regularised incomplete gamma Q(s, x)."""
    if x <= 0.0:
        return 1.0
    front = math.exp(s * math.log(x) - x - math.lgamma(s))
    if x < s + 1.0:
        term = total = 1.0 / s
        k = s
        while abs(term) > abs(total) * 1e-17:
            k += 1.0
            term *= x / k
            total += term
        return 1.0 - front * total
    b = x + 1.0 - s
    c, d = 1.0 / _TINY, 1.0 / b
    h = d
    for i in range(1, 5000):
        an = -i * (i - s)
        b += 2.0
        d = an * d + b
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = b + an / c
        c = c if abs(c) > _TINY else _TINY
        h *= d * c
        if abs(d * c - 1.0) < 1e-16:
            break
    return front * h


def t_two_sided(t, dof):
    t, dof = np.asarray(t, dtype=float), np.asarray(dof, dtype=float)
    return beta_cdf(dof / 2.0, 0.5, dof / (dof + t * t))


def t_quantile(level: float, dof: float) -> float:
    """t with P(|T| <= t) = level, by bisection."""
    low, high = 0.0, 1.0
    while float(t_two_sided(high, dof)) > 1.0 - level:
        high *= 2.0
    for _ in range(200):
        mid = (low + high) / 2.0
        if float(t_two_sided(mid, dof)) > 1.0 - level:
            low = mid
        else:
            high = mid
    return (low + high) / 2.0


def kendall_exact(n: int, discordant: int) -> float:
    """Two-sided p of untied Kendall tau: share of permutations with at most so extreme an inversion count."""
    c = min(discordant, n * (n - 1) // 2 - discordant)
    if 4 * c == n * (n - 1):
        return 1.0
    ways = [1] + [0] * c
    for k in range(2, n + 1):  # inversions added by the k-th element: 0 .. k - 1
        total, grown = 0, []
        for i in range(c + 1):
            total += ways[i] - (ways[i - k] if i >= k else 0)
            grown.append(total)
        ways = grown
    return min(1.0, 2.0 * float(sum(ways) / math.factorial(n)))


@F.pandas_udf(T.DoubleType())
def t_pvalue(t: pd.Series, dof: pd.Series) -> pd.Series:
    ok = t.notna() & dof.notna() & (dof > 0)
    out = pd.Series(np.nan, index=t.index)
    if ok.any():
        out[ok] = t_two_sided(t[ok].to_numpy(), dof[ok].to_numpy())
    return out.where(ok, None)


@F.pandas_udf(T.DoubleType())
def t_interval(level: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([t_quantile(a, b) if b > 0 else None for a, b in zip(level, dof)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def f_pvalue(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    ok = f.notna() & (d1 > 0) & (d2 > 0)
    out = pd.Series(np.nan, index=f.index)
    if ok.any():
        x, a, b = f[ok].to_numpy(), d1[ok].to_numpy(), d2[ok].to_numpy()
        out[ok] = beta_cdf(b / 2.0, a / 2.0, b / (b + a * x))
    return out.where(ok, None)


@F.pandas_udf(T.DoubleType())
def chi2_pvalue(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([gamma_tail(d / 2.0, v / 2.0) if v == v and d > 0 else None for v, d in zip(x, dof)],
                     dtype="float64")


@F.pandas_udf(T.DoubleType())
def kendall_pvalue(n: pd.Series, surplus: pd.Series, dis: pd.Series, xt: pd.Series, yt: pd.Series, x0: pd.Series,
                   y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
    """Exact for small untied samples, else normal with the variance corrected for ties."""
    out = []
    for m, s, d, a, b, a0, b0, a1, b1 in zip(n, surplus, dis, xt, yt, x0, y0, x1, y1):
        total = m * (m - 1) / 2.0
        if m < 2 or a >= total or b >= total:
            out.append(None)
        elif a == 0 and b == 0 and (m <= 33 or min(d, total - d) <= 1):
            out.append(kendall_exact(int(m), int(d)))
        else:
            pairs = m * (m - 1.0)
            var = (pairs * (2 * m + 5) - a1 - b1) / 18.0 + 2.0 * a * b / pairs
            var += a0 * b0 / (9.0 * pairs * (m - 2)) if m > 2 else 0.0
            out.append(math.erfc(abs(s) / math.sqrt(var) / math.sqrt(2.0)))
    return pd.Series(out, dtype="float64")


# workers get these functions by value, so the package need not be installed on them
cloudpickle.register_pickle_by_value(sys.modules[__name__])
