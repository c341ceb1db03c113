"""Statistics: kernels, window border weights, binomial tail, contamination formulas."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def border_weights(window: float) -> tuple[int, int, float, float]:
    """(low, high, weight at low, weight at high) of a window of real length.

    Differences are those of two events placed uniformly within their samples: a whole difference d lies
    within the window with a triangular probability, which is 1 below low and 0 above high.
    """
    low, high = math.floor(window), math.ceil(window)
    if low == high:
        return low, high, 0.5, 0.5
    part = window - low
    at_high = part * part / 2
    at_low = 0.5 + part - part * part / 2
    if low == 0:  # both tails of the difference 0 are cut
        at_low -= (1 - window) ** 2 / 2
    return low, high, at_low, at_high


def window_weight(distance: Column, window: float) -> Column:
    """The weight of a whole distance in a window of real length."""
    low, high, at_low, at_high = border_weights(window)
    return F.when(distance > high, 0.0).when(distance == high, at_high).when(distance == low, at_low).otherwise(1.0)


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function, by Lentz's method; all rows take a step at once."""
    tiny = 1e-300
    safe = lambda v: np.where(np.abs(v) > tiny, v, tiny)
    c, d = np.ones_like(x), 1 / safe(1 - (a + b) * x / (a + 1))
    out = d.copy()
    for m in range(1, 10_000):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / safe(1 + numerator * d)
            c = safe(1 + numerator / c)
            step = c * d
            out *= step
        if (np.abs(step - 1) < 1e-15).all():
            break
    return out


def regularised_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """I_x(a, b) for 0 < x < 1, accurate in the tails."""
    log = np.vectorize(math.lgamma, otypes=[float])
    front = np.exp(log(a + b) - log(a) - log(b) + a * np.log(x) + b * np.log1p(-x))
    low = x < (a + 1) / (a + b + 2)
    p, q, y = np.where(low, a, b), np.where(low, b, a), np.where(low, x, 1 - x)
    tail = front * _beta_fraction(p, q, y) / p
    return np.where(low, tail, 1 - tail)


def binomial_tails(x: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """P(X > x) of binomials with real numbers n of trials, row by row; NaN where an argument is."""
    x, n, p = (np.asarray(v, float) for v in np.broadcast_arrays(x, n, p))
    out = np.where(x < 0, 1.0, 0.0)
    out = np.where((x >= 0) & (x < n) & (p >= 1), 1.0, out)
    inside = (x >= 0) & (x < n) & (p > 0) & (p < 1)
    if inside.any():
        out[inside] = regularised_beta(x[inside] + 1, n[inside] - x[inside], p[inside])
    return np.where(np.isnan(x) | np.isnan(n) | np.isnan(p), np.nan, out)


def binomial_tail(x: float, n: float, p: float) -> float:
    """P(X > x) of one binomial with a real number n of trials."""
    return float(binomial_tails(np.array([x]), np.array([n]), np.array([p]))[0])


def _tails(x: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series(binomial_tails(x.to_numpy(float, na_value=np.nan), n.to_numpy(float, na_value=np.nan), p.to_numpy(float, na_value=np.nan)))


def binomial_tail_column(x: Column, n: Column, p: Column) -> Column:
    """``binomial_tails`` by Arrow batch; null where an argument is."""
    tail = F.pandas_udf(_tails, "double")(x.cast("double"), n.cast("double"), p.cast("double"))
    return F.when(x.isNotNull() & n.isNotNull() & p.isNotNull(), tail)


def contamination(n_spikes: Column, n_violations: Column, t_max: int, censored: float, refractory: float) -> Column:
    """The fraction of foreign events that would cause the violations; null without events."""
    exposure = n_spikes * n_spikes * F.lit(float(refractory - censored))
    left = 1 - n_violations * (F.lit(float(t_max)) - 2 * n_spikes * F.lit(float(censored))) / F.when(exposure != 0, exposure)
    return F.when(left < 0, 1.0).otherwise(1 - F.sqrt(F.greatest(left, F.lit(0.0))))


def gaussian_kernel(sigma: float, truncate: float = 5.0) -> np.ndarray:
    half = math.ceil(truncate * sigma)
    x = np.arange(-half, half + 1)
    return np.exp(-0.5 * (x / sigma) ** 2) / (sigma * math.sqrt(2 * math.pi))
