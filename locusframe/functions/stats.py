"""Tail probabilities on NumPy arrays, and as Arrow functions of columns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType



def _lgamma(x):
    return np.vectorize(math.lgamma, otypes=[float])(x)  # made anew: one that has been called cannot be pickled


def _erfc(x):
    return np.vectorize(math.erfc, otypes=[float])(x)


def beta_inc(a, b, x, steps: int = 400):
    """Regularized incomplete beta function by its continued fraction, evaluated from the tail inwards."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    y = np.clip(y, 0, 1)
    tail = np.zeros_like(y)
    for m in range(steps, 0, -1):
        k = m // 2
        even = k * (q - k) * y / ((p + 2 * k - 1) * (p + 2 * k))
        odd = -(p + k) * (p + q + k) * y / ((p + 2 * k) * (p + 2 * k + 1))
        tail = (odd if m % 2 else even) / (1 + tail)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
    front = np.where((y <= 0) | (y >= 1), 0.0, front)
    value = front / (1 + tail)
    value = np.where(y >= 1, 1.0, value)
    return np.where(swap, 1 - value, value)


def t_two_sided(t, df):
    t, df = np.asarray(t, float), np.asarray(df, float)
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def norm_two_sided(z):
    return _erfc(np.abs(np.asarray(z, float)) / math.sqrt(2))


def chi2_sf(x, k, terms: int = 2000):
    """Upper tail of chi-square: power series of the lower part near zero, else the upper part's continued fraction."""
    x, s = np.broadcast_arrays(np.asarray(x, float) / 2, np.asarray(k, float) / 2)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        scale = np.exp(s * np.log(x) - x - _lgamma(s))
    small = x < s + 1
    term, total = 1 / s, 1 / s
    z = np.where(small, x, 0.0)
    for i in range(1, terms):
        term = term * z / (s + i)
        total = total + term
        if not np.any(term > total * 1e-17):
            break
    fraction = np.zeros_like(x)
    y = np.where(small, s + 1, x)
    for i in range(400, 0, -1):
        fraction = i * (s - i) / (y + 2 * i + 1 - s + fraction)
    upper = scale / (y + 1 - s + fraction)
    return np.where(x <= 0, 1.0, np.where(small, 1 - scale * total, upper))


def fisher_2x2(a, b, c, d):
    """Two-sided p of a 2x2 table: tables with the same margins that are no likelier than the one seen."""
    out = []
    for w, x, y, z in zip(*(np.asarray(v, int).ravel() for v in (a, b, c, d)), strict=True):
        row, col, n = w + x, w + y, w + x + y + z
        k = np.arange(max(0, row + col - n), min(row, col) + 1)
        logp = -(_lgamma(k + 1) + _lgamma(row - k + 1) + _lgamma(col - k + 1) + _lgamma(n - row - col + k + 1))
        p = np.exp(logp - logp.max())
        out.append(float(p[p <= p[k == w][0] * (1 + 1e-7)].sum() / p.sum()))
    return np.array(out)


@F.pandas_udf(DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_two_sided(t, df)).where(np.isfinite(t.to_numpy(float)) & (df.to_numpy(float) > 0))


@F.pandas_udf(DoubleType())
def chi2_p(x: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series(chi2_sf(x, k))


@F.pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return pd.Series(norm_two_sided(z))


@F.pandas_udf(DoubleType())
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series(fisher_2x2(a, b, c, d))
