"""Quantiles and tail probabilities used by the regression reports."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType

# Fixed value: 97.5 % quantile of the normal distribution.
Z_975 = 1.959963984540054
EXACT_DF = 30


def _t_cdf_two_sided(t: float, df: int) -> float:
    """P(|T| <= t) for whole degrees of freedom, as the finite trigonometric sum."""
    theta = math.atan(t / math.sqrt(df))
    c, s = math.cos(theta), math.sin(theta)
    term, total = (c, c) if df % 2 else (1.0, 1.0)
    if df == 1:
        return 2 * theta / math.pi
    for k in range(3 if df % 2 else 2, df - 1, 2):
        term *= (k - 1) / k * c * c
        total += term
    return 2 / math.pi * (theta + s * total) if df % 2 else s * total


def _t_975(df: int) -> float:
    low, high = 1.0, 20.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _t_cdf_two_sided(mid, df) < 0.95 else (low, mid)
    return (low + high) / 2


T_975 = tuple(_t_975(df) for df in range(1, EXACT_DF + 1))


def t_quantile_975(df: Column) -> Column:
    """97.5 % quantile of Student's t: solved values to 30 df, then the series in 1/df.

    Null without degrees of freedom. The series is off by less than 3e-8 at 31 df.
    """
    z, z3, z5, z7, z9 = (Z_975**k for k in (1, 3, 5, 7, 9))
    n = df.cast("double")
    series = (
        F.lit(z)
        + F.lit((z3 + z) / 4) / n
        + F.lit((5 * z5 + 16 * z3 + 3 * z) / 96) / (n * n)
        + F.lit((3 * z7 + 19 * z5 + 17 * z3 - 15 * z) / 384) / (n * n * n)
        + F.lit((79 * z9 + 776 * z7 + 1482 * z5 - 1920 * z3 - 945 * z) / 92160) / (n * n * n * n)
    )
    solved = F.element_at(F.array(*[F.lit(v) for v in T_975]), df.cast("int"))
    return F.when((df >= 1) & (df <= EXACT_DF), solved).when(df > EXACT_DF, series)


def _incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction."""
    flip = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(
            lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(x) + b * np.log1p(-x)
        ) / a
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    value = d.copy()
    for m in range(1, 400):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            value = value * c * d
        if np.all(np.abs(c * d - 1) < 1e-15):
            break
    part = np.where(x <= 0, 0.0, front * value)
    return np.where(flip, 1 - part, part)


@F.pandas_udf(DoubleType())
def t_p_value(statistic: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p-value of a t statistic."""
    t, n = statistic.to_numpy(float), df.to_numpy(float)
    ok = np.isfinite(t) & (n > 0)
    t, n = np.where(ok, t, 0.0), np.where(ok, n, 1.0)
    p = _incomplete_beta(n / 2, np.full_like(n, 0.5), n / (n + t * t))
    return pd.Series(np.where(ok, p, np.nan)).astype("Float64").where(pd.Series(ok))


@F.pandas_udf(DoubleType())
def f_p_value(statistic: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    """Upper-tail p-value of an F statistic."""
    f, m, n = (s.to_numpy(float) for s in (statistic, df1, df2))
    ok = np.isfinite(f) & (m > 0) & (n > 0)
    f, m, n = np.where(ok, f, 0.0), np.where(ok, m, 1.0), np.where(ok, n, 1.0)
    p = _incomplete_beta(n / 2, m / 2, n / (n + m * f))
    return pd.Series(np.where(ok, p, np.nan)).astype("Float64").where(pd.Series(ok))
