"""Tails of the F and t distributions by the incomplete beta function."""

from __future__ import annotations

import math


def beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if not 0 < x < 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * beta_fraction(a, b, x) / a
    return 1 - front * beta_fraction(b, a, 1 - x) / b


def f_tail(f: float, d1: float, d2: float) -> float:
    """The chance of an F value above ``f``."""
    if math.isnan(f):
        return math.nan
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if math.isfinite(f) else 0.0


def t_quantile(p: float, df: float) -> float:
    """The value that a t variable stays under with chance ``p`` of at least a half."""
    low, high = 0.0, 1.0
    upper = lambda t: f_tail(t * t, 1, df) / 2
    while upper(high) > 1 - p:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if upper(middle) > 1 - p else (low, middle)
    return (low + high) / 2
