"""Distribution tails for rows that are already aggregated (one per column, group or run).

Spark has no erfc or incomplete beta; these vectorised UDFs never see raw rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTERVAL = T.StructType([T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType())])


@F.pandas_udf(T.DoubleType())
def erfc(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None or v != v else math.erfc(v))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta integral (modified Lentz steps)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


@F.pandas_udf(T.DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a Pearson r over n pairs."""
    def one(rv, nv):
        if rv is None or rv != rv or nv is None or nv < 3:
            return None
        df = nv - 2
        if df == 0 or nv == 2:
            return 1.0
        if abs(rv) >= 1:
            return 0.0
        return incomplete_beta(df / 2, 0.5, 1 - rv * rv)

    return pd.Series([one(a, b) for a, b in zip(r, n)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def binomial_two_sided(a: pd.Series, b: pd.Series) -> pd.Series:
    """Exact p of a vs b discordant pairs under a fair coin."""
    def one(x, y):
        x, y = int(x), int(y)
        n, low = x + y, min(x, y)
        if n == 0:
            return 1.0
        k = np.arange(0, low + 1)
        logs = np.array([math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in k]) - n * math.log(2)
        return float(min(1.0, 2 * np.exp(logs).sum()))

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")


ENDS = (0.025, 0.975)
#: A cumulative sum that falls short of a quantile by less has reached it.
_ROOM = 1e-12


def _at(cumulative: np.ndarray) -> list[int]:
    """Where the cumulative distribution first reaches each end of the interval."""
    return [min(int(np.searchsorted(cumulative, q - _ROOM)), len(cumulative) - 1) for q in ENDS]


def binomial_ends(n: int, k: int) -> tuple[float, float]:
    """The quantiles of Binomial(n, k/n)/n: probabilities follow from the mode by ratios of neighbours, 12 deviations far."""
    if k <= 0 or k >= n:
        return (0.0, 0.0) if k <= 0 else (1.0, 1.0)
    p = k / n
    reach = math.ceil(12 * math.sqrt(n * p * (1 - p))) + 30
    i = np.arange(max(0, k - reach), min(n, k + reach) + 1)
    logs = np.concatenate([[0.0], np.cumsum(np.log((n - i[:-1]) / i[1:] * (p / (1 - p))))])
    mass = np.cumsum(np.exp(logs - logs.max()))
    return tuple(float(i[j] / n) for j in _at(mass / mass[-1]))


def difference_ends(worse: int, same: int, better: int) -> tuple[float, float]:
    """The quantiles of the mean of n steps of -1, 0, +1 taken in these shares, from the transform of their distribution."""
    n = worse + same + better
    down, up = worse / n, better / n
    deviation = math.sqrt(n * max(0.0, up + down - (up - down) ** 2))
    length = 1 << math.ceil(math.log2(min(2 * n + 1, 24 * deviation + 64)))
    angle = 2 * np.pi * np.arange(length) / length
    step = same / n + up * np.exp(1j * angle) + down * np.exp(-1j * angle)
    mass = np.fft.fft(step**n).real / length
    d = np.arange(length) - length // 2 + better - worse
    d = d[(d >= -n) & (d <= n)]
    return tuple(float(d[j] / n) for j in _at(np.cumsum(np.maximum(mass[d % length], 0.0))))


def _each(columns: list[pd.Series], ends) -> pd.DataFrame:
    """The interval of every row, found once for equal rows."""
    rows = pd.concat(columns, axis=1).to_numpy(np.float64)
    out = np.full((len(rows), 2), np.nan)
    ok = np.isfinite(rows).all(axis=1) & (rows[:, 0] > 0 if len(columns) == 2 else rows.sum(axis=1) > 0)
    if ok.any():
        kinds, at = np.unique(rows[ok], axis=0, return_inverse=True)
        out[ok] = np.array([ends(*map(int, k)) for k in kinds])[at.ravel()]
    return pd.DataFrame({c: pd.Series(v).astype(object).where(np.isfinite(v), None) for c, v in zip(("lo", "hi"), out.T)})


@F.pandas_udf(INTERVAL)
def rate_interval(n: pd.Series, k: pd.Series) -> pd.DataFrame:
    """95% percentile interval of k successes in n: what endless resampling of the n outcomes tends to, no draws."""
    return _each([n, k], binomial_ends)


@F.pandas_udf(INTERVAL)
def delta_interval(worse: pd.Series, same: pd.Series, better: pd.Series) -> pd.DataFrame:
    """95% percentile interval of the paired difference from the counts of -1, 0, +1, as rate_interval."""
    return _each([worse, same, better], difference_ends)
