"""Quantiles of the Beta and Student distributions, by continued fraction and bisection, vectorised over arrays."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

_LGAMMA = np.vectorize(math.lgamma, otypes=[float])


def beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function I_x(a, b) (Lentz's continued fraction on the side where it converges fast)."""
    x, a, b = np.broadcast_arrays(np.clip(np.asarray(x, float), 0, 1), np.asarray(a, float), np.asarray(b, float))
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    tiny = 1e-300
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_LGAMMA(p + q) - _LGAMMA(p) - _LGAMMA(q) + p * np.log(np.maximum(z, tiny)) + q * np.log1p(-z)) / p
    c = np.ones_like(z)
    d = 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 200):
        for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    value = np.where(z <= 0, 0.0, front * h)
    return np.clip(np.where(swap, 1 - value, value), 0, 1)


def beta_quantile(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    p, a, b = np.broadcast_arrays(np.asarray(p, float), np.asarray(a, float), np.asarray(b, float))
    lo, hi = np.zeros_like(p), np.ones_like(p)
    for _ in range(60):
        mid = (lo + hi) / 2
        below = beta_cdf(mid, a, b) < p
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2


def student_quantile(p: np.ndarray | float, df: np.ndarray | float) -> np.ndarray:
    """Quantiles of Student's t for p > 0.5."""
    p, df = np.broadcast_arrays(np.asarray(p, float), np.asarray(df, float))
    x = beta_quantile(2 * (1 - p), df / 2, 0.5)
    return np.sqrt(df * (1 - x) / x)


@lru_cache(maxsize=8)
def grubbs_criticals(most: int, alpha: float = 0.05) -> tuple[float, ...]:
    """Two-sided critical values of the largest deviation of 3 to `most` values, in sample standard deviations."""
    n = np.arange(3, most + 1, dtype=float)
    t = student_quantile(1 - alpha / (2 * n), n - 2)
    return tuple(((n - 1) / np.sqrt(n) * np.sqrt(t * t / (n - 2 + t * t))).tolist())
