"""p-values for already aggregated rows (one row per flag, score or test).

Spark has no distribution functions, so these are Arrow-batched pandas UDFs.
They only ever see report rows, never data rows.
"""

from __future__ import annotations

import math
from functools import wraps

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession, functions as F, types as T

from riskloom.functions.shipping import ship


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz's method)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 1000):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return out


def beta_cdf(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_two_sided(t: float, dof: float) -> float:
    if math.isnan(t) or math.isnan(dof) or dof <= 0:
        return math.nan
    if math.isinf(t):
        return 0.0
    return beta_cdf(dof / 2.0, 0.5, dof / (dof + t * t))


def t_quantile_975(dof: float) -> float:
    """Point with 2.5 % of Student's t above it, by bisection."""
    if math.isnan(dof) or dof <= 0:
        return math.nan
    low, high = 0.0, 1.0
    while t_two_sided(high, dof) > 0.05:
        high *= 2.0
    for _ in range(200):
        mid = (low + high) / 2.0
        low, high = (mid, high) if t_two_sided(mid, dof) > 0.05 else (low, mid)
    return (low + high) / 2.0


def fisher_two_sided(a: float, b: float, c: float, d: float) -> float:
    """Two-sided exact p of a 2x2 table: all tables no likelier than this one.

    Walks outward from the mode and stops once terms no longer matter, so the
    work does not grow with the margins.
    """
    row, col, n = a + b, a + c, a + b + c + d
    low, high = max(0.0, row + col - n), min(row, col)
    if low == high:
        return 1.0

    def log_weight(k):
        return -(
            math.lgamma(k + 1) + math.lgamma(row - k + 1)
            + math.lgamma(col - k + 1) + math.lgamma(n - row - col + k + 1)
        )

    mode = min(max(math.floor((row + 1) * (col + 1) / (n + 2)), low), high)
    peak = log_weight(mode)
    seen = math.exp(log_weight(a) - peak) * (1 + 1e-7)
    total, extreme = 0.0, 0.0
    for start, step in ((mode, 1.0), (mode - 1, -1.0)):
        k, weight = start, math.exp(log_weight(start) - peak) if low <= start <= high else 0.0
        while low <= k <= high and weight > 1e-30:
            total += weight
            if weight <= seen:
                extreme += weight
            if step > 0:
                weight *= (row - k) * (col - k) / ((k + 1) * (n - row - col + k + 1))
            else:
                weight *= k * (n - row - col + k) / ((row - k + 1) * (col - k + 1))
            k += step
    if total and extreme == 0.0:  # the observed table lies beyond the walk
        return seen / total
    return min(1.0, extreme / total)


def _column_function(function):
    """A function of columns that workers apply to batches of doubles."""
    applied = F.pandas_udf(function, T.DoubleType())

    @wraps(function)
    def of(*columns):
        ship(SparkSession.active())
        return applied(*columns)

    return of


def _each(function, *series: pd.Series) -> pd.Series:
    rows = zip(*(s.astype("float64") for s in series))
    return pd.Series(
        [np.nan if any(np.isnan(v) for v in row) else function(*row) for row in rows],
        dtype="float64",
    )


@_column_function
def normal_upper_p(z: pd.Series) -> pd.Series:
    return _each(lambda v: 0.5 * math.erfc(v / math.sqrt(2.0)), z)


@_column_function
def chi2_1dof_p(statistic: pd.Series) -> pd.Series:
    return _each(lambda v: math.erfc(math.sqrt(max(v, 0.0) / 2.0)), statistic)


@_column_function
def student_two_sided_p(t: pd.Series, dof: pd.Series) -> pd.Series:
    return _each(t_two_sided, t, dof)


@_column_function
def student_975(dof: pd.Series) -> pd.Series:
    return _each(t_quantile_975, dof)


@_column_function
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return _each(fisher_two_sided, a, b, c, d)
