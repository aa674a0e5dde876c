"""The two Arrow-batched helpers Spark has no built-in for."""

from __future__ import annotations

import html
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


@F.pandas_udf(StringType())
def unescape_entities(text: pd.Series) -> pd.Series:
    """All named and numeric HTML entities, in one pass."""
    return text.map(html.unescape, na_action="ignore")


def _beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta by its continued fraction (modified Lentz)."""
    swap = x > (a + 1.0) / (a + b + 2.0)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1.0 - x, x)
    log_gamma = np.vectorize(math.lgamma, otypes=[float])
    front = np.exp(
        log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * np.log(y) + q * np.log1p(-y)
    ) / p
    tiny = 1e-300
    c = np.ones_like(y)
    d = 1.0 - (p + q) * y / (p + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    frac = d.copy()
    for m in range(1, 500):
        for num in (
            m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)),
            -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            frac = frac * step
        if np.all(np.abs(step - 1.0) < 1e-14):
            break
    value = front * frac
    return np.where(swap, 1.0 - value, value)


@F.pandas_udf(DoubleType())
def beta_quantile(prob: pd.Series, alpha: pd.Series, beta: pd.Series) -> pd.Series:
    """Quantile of Beta(alpha, beta) by bisection, vectorised over the batch."""
    p, a, b = (s.to_numpy(dtype=float) for s in (prob, alpha, beta))
    lo, hi = np.zeros_like(p), np.ones_like(p)
    for _ in range(60):
        mid = (lo + hi) / 2.0
        below = _beta_cdf(np.clip(mid, 1e-15, 1 - 1e-15), a, b) < p
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return pd.Series((lo + hi) / 2.0)
