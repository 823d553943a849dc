"""Tails of the normal, t, F and chi-squared distributions, and digamma, in numpy and plain Python."""

from __future__ import annotations

import math

import numpy as np


def _fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if not (a > 0 and b > 0) or math.isnan(x):
        return math.nan
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _fraction(b, a, 1 - x) / b


def gammaincc(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if math.isnan(x) or a <= 0:
        return math.nan
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = value = 1 / a
        for n in range(1, 2000):
            term *= x / (a + n)
            value += term
            if term < value * 1e-16:
                break
        return 1 - value * front
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 2000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def t_sf(t: float, df: float) -> float:
    """P(T > t)."""
    if math.isnan(t) or math.isnan(df):
        return math.nan
    if math.isinf(t):
        return float(t < 0)
    half = 0.5 * betainc(df / 2, 0.5, df / (df + t * t))
    return half if t > 0 else 1 - half


def t_ppf(p: float, df: float) -> float:
    """The t with P(T <= t) = p, by bisection."""
    lo, hi = -1.0, 1.0
    while t_sf(hi, df) > 1 - p:
        hi *= 2
    while 1 - t_sf(lo, df) > p:
        lo *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - t_sf(mid, df) < p else (lo, mid)
    return (lo + hi) / 2


def f_sf(f: float, d1: float, d2: float) -> float:
    return betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0 if f <= 0 else math.nan


def chi2_sf(x: float, df: float) -> float:
    return gammaincc(df / 2, x / 2)


def norm_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def digamma(x: np.ndarray) -> np.ndarray:
    """Logarithmic derivative of gamma: recurrence up to 10, then the asymptotic series; reflection below zero; NaN at its poles."""
    x = np.asarray(x, float).copy()
    out = np.zeros_like(x)
    with np.errstate(all="ignore"):
        pole, low = (x <= 0) & (x == np.floor(x)), x < 0
        reflected = np.where(low, -np.pi / np.tan(np.pi * x), 0.0)
        x = np.where(low, 1 - x, x)
        for _ in range(10):
            small = x < 10
            out -= np.where(small, 1 / np.where(small, x, 1.0), 0.0)
            x = np.where(small, x + 1, x)
        s = 1 / (x * x)
        out += np.log(x) - 0.5 / x - s * (1 / 12 - s * (1 / 120 - s * (1 / 252 - s * (1 / 240 - s * (1 / 132)))))
    return np.where(pole, np.nan, out + reflected)
