"""Upper tails of the F, t and chi-square distributions for small aggregated results."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def beta_share(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return min(max(x, 0.0), 1.0)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    value = 1.0
    # evaluate 1/(1 + d1/(1 + d2/(1 + ...))) from the inside out
    for m in range(max(300, int(4 * math.sqrt(max(a, b)))), 0, -1):    # terms needed grow with the root of the parameters
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        value = 1 + even / (1 + odd / value)
    value = 1 - (a + b) * x / (a + 1) / value
    return front / value


def gamma_share(a: float, x: float) -> float:
    """Regularized lower incomplete gamma function by its power series."""
    if x <= 0:
        return 0.0
    if x > a + 40 + 12 * math.sqrt(a):
        return 1.0
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= x / n
        total += term
    return total * math.exp(a * math.log(x) - x - math.lgamma(a))


def f_upper(f: float, d1: float, d2: float) -> float:
    if f is None or math.isnan(f) or d1 <= 0 or d2 <= 0:
        return math.nan
    return 0.0 if math.isinf(f) else beta_share(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def t_both(t: float, d: float) -> float:
    return f_upper(t * t, 1, d)


def chi_upper(x: float, d: float) -> float:
    return 1 - gamma_share(d / 2, x / 2)


@F.pandas_udf(DoubleType())
def f_tail(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series([f_upper(*v) for v in zip(f, d1, d2)])


@F.pandas_udf(DoubleType())
def t_tail(t: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([t_both(*v) for v in zip(t, d)])


@F.pandas_udf(DoubleType())
def chi_tail(x: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([chi_upper(*v) for v in zip(x, d)])
