"""Tail probabilities for finished test statistics.

Spark reduces the data to one row per test or per pair of groups; these Arrow UDFs then see only
those rows. Nulls in give null out.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


# Above this many degrees of freedom a chi-square divided by them is taken as 1, its limit: log gamma
# loses the digits that the difference would show in.
LARGE = 1e7


def _log_beta(a: float, b: float) -> float:
    return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_inc(b, a, 1.0 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - _log_beta(a, b)) / a
    tiny, c, d = 1e-300, 1.0, 0.0
    value = 1.0
    # Terms needed grow with the root of the larger parameter; callers keep both below LARGE / 2.
    for i in range(2000 + int(40 * math.sqrt(max(a, b)))):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 + num * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + num / (c if abs(c) > tiny else tiny)
        value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            return front * (value - 1.0)
    return math.nan


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma."""
    if x <= 0.0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        k = a
        while term > total * 1e-16:
            k += 1.0
            term *= x / k
            total += term
        return max(0.0, 1.0 - total * scale)
    b, c = x + 1.0 - a, 1e300
    d = h = 1.0 / b
    for i in range(1, 2000 + int(40 * math.sqrt(a))):
        an = -i * (i - a)
        b += 2.0
        d = 1.0 / (an * d + b)
        c = b + an / c
        h *= c * d
        if abs(c * d - 1.0) < 1e-15:
            return scale * h
    return math.nan


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def f_sf(f: float, d1: float, d2: float) -> float:
    if d1 > LARGE and d2 > LARGE:
        return normal_sf(math.log(f) / math.sqrt(2.0 / d1 + 2.0 / d2)) if f > 0.0 else 1.0
    if d2 > LARGE:
        return chi2_sf(d1 * f, d1)
    if d1 > LARGE:
        return 1.0 - chi2_sf(d2 / f, d2) if f > 0.0 else 1.0
    return beta_inc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def t_two_sided(t: float, df: float) -> float:
    if df > LARGE:
        return 2.0 * normal_sf(abs(t))
    return beta_inc(df / 2.0, 0.5, df / (df + t * t))


def chi2_sf(x: float, df: float) -> float:
    if df > LARGE:
        return normal_sf((x - df) / math.sqrt(2.0 * df))
    return gamma_upper(df / 2.0, x / 2.0)


def _phi(z: np.ndarray) -> np.ndarray:
    erf = np.vectorize(math.erf, otypes=[float])
    return 0.5 * (1.0 + erf(z / math.sqrt(2.0)))


def _nodes(lo: float, hi: float, n: int) -> tuple[np.ndarray, np.ndarray]:
    x, w = np.polynomial.legendre.leggauss(n)
    return lo + (x + 1.0) * (hi - lo) / 2.0, w * (hi - lo) / 2.0


def _scale_nodes(df: float, n: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and probability weights of s = sqrt(chi2 / df)."""
    if df > LARGE:
        return np.ones(1), np.ones(1)
    spread = 9.0 / math.sqrt(2.0 * df)
    s, w = _nodes(max(0.0, 1.0 - spread), 1.0 + spread, n)
    logf = (
        math.log(2.0)
        + df / 2.0 * math.log(df / 2.0)
        - math.lgamma(df / 2.0)
        + (df - 1.0) * np.log(s)
        - df * s * s / 2.0
    )
    return s, w * np.exp(logf)


def tukey_sf(q: float, k: float, df: float) -> float:
    """Upper tail of the studentized range of k means."""
    if q <= 0.0:
        return 1.0
    s, ws = _scale_nodes(df)
    z, wz = _nodes(-8.0, 8.0, 96)
    below = _phi(z)[None, :] - _phi(z[None, :] - q * s[:, None])
    dens = wz * np.exp(-z * z / 2.0) / math.sqrt(2.0 * math.pi)
    cdf = k * (np.power(below, k - 1.0) @ dens)
    return float(min(1.0, max(0.0, 1.0 - (ws @ cdf) / ws.sum())))


def upper_point(tail, level: float) -> float:
    """The point above which a decreasing tail function keeps the given probability."""
    lo, hi = 0.0, 10.0
    while tail(hi) > level:
        lo, hi = hi, hi * 2.0
        if math.isinf(hi):
            return math.nan
    while hi - lo > 1e-14 * hi:
        mid = (lo + hi) / 2.0
        if mid in (lo, hi):
            break
        lo, hi = (mid, hi) if tail(mid) > level else (lo, mid)
    return (lo + hi) / 2.0


def tukey_quantile(p: float, k: float, df: float) -> float:
    return upper_point(lambda q: tukey_sf(q, k, df), 1.0 - p)


def dunnett_two_sided(t: float, df: float, loadings: np.ndarray) -> float:
    """P(max |T_i| > |t|) for comparisons that share one control (correlations l_i * l_j)."""
    s, ws = _scale_nodes(df)
    z, wz = _nodes(-8.0, 8.0, 96)
    dens = wz * np.exp(-z * z / 2.0) / math.sqrt(2.0 * math.pi)
    inside = np.ones((len(s), len(z)))
    for l in loadings:
        rest = math.sqrt(1.0 - l * l)
        up = (l * z[None, :] + abs(t) * s[:, None]) / rest
        down = (l * z[None, :] - abs(t) * s[:, None]) / rest
        inside *= _phi(up) - _phi(down)
    return float(min(1.0, max(0.0, 1.0 - (ws @ (inside @ dens)) / ws.sum())))


def _rowwise(fn, *series: pd.Series) -> pd.Series:
    def one(*args):
        if any(a is None or (np.isscalar(a) and pd.isna(a)) for a in args):
            return None
        return fn(*args)

    return pd.Series([one(*row) for row in zip(*series)], dtype="float64")


@F.pandas_udf(DoubleType())
def f_pvalue(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _rowwise(f_sf, f, d1, d2)


@F.pandas_udf(DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    return _rowwise(t_two_sided, t, df)


@F.pandas_udf(DoubleType())
def chi2_pvalue(x: pd.Series, df: pd.Series) -> pd.Series:
    return _rowwise(chi2_sf, x, df)


@F.pandas_udf(DoubleType())
def tukey_pvalue(q: pd.Series, k: pd.Series, df: pd.Series) -> pd.Series:
    return _rowwise(tukey_sf, q, k, df)


def _once(fn):
    """The function with its results kept for a batch: all pairs of a test share them."""
    known: dict[tuple, float] = {}

    def one(*args):
        key = tuple(tuple(a) if isinstance(a, np.ndarray) else a for a in args)
        if key not in known:
            known[key] = fn(*args)
        return known[key]

    return one


@F.pandas_udf(DoubleType())
def tukey_critical(p: pd.Series, k: pd.Series, df: pd.Series) -> pd.Series:
    return _rowwise(_once(tukey_quantile), p, k, df)


@F.pandas_udf(DoubleType())
def f_critical(p: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    point = lambda p, d1, d2: upper_point(lambda f: f_sf(f, d1, d2), 1.0 - p)
    return _rowwise(_once(point), p, d1, d2)


@F.pandas_udf(DoubleType())
def dunnett_critical(p: pd.Series, df: pd.Series, loadings: pd.Series) -> pd.Series:
    point = lambda p, df, l: upper_point(
        lambda t: dunnett_two_sided(t, df, l), 1.0 - p
    )
    return _rowwise(_once(point), p, df, loadings)


@F.pandas_udf(DoubleType())
def dunnett_pvalue(t: pd.Series, df: pd.Series, loadings: pd.Series) -> pd.Series:
    return _rowwise(dunnett_two_sided, t, df, loadings)
