"""Small numeric helpers for the driver: Student's t and search grids."""

from __future__ import annotations

import math
import random


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 400):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + term * d
            c = 1.0 + term / c
            d, c = 1.0 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return out


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_tail(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    return beta_share(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


def t_quantile(p: float, df: float) -> float:
    """Quantile of Student's t by bisection."""
    if p < 0.5:
        return -t_quantile(1 - p, df)
    lo, hi = 0.0, 1.0
    while 1 - t_tail(hi, df) / 2 < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - t_tail(mid, df) / 2 < p else (lo, mid)
    return (lo + hi) / 2


def interval(mean: float, sd: float, n: int, confidence: float = 0.95) -> tuple[float, float]:
    """t-interval of a mean; (0, 0) without values, (mean, mean) where there is no spread."""
    if n == 0:
        return 0.0, 0.0
    if n == 1 or not sd:
        return mean, mean
    half = t_quantile((1 + confidence) / 2, n - 1) * sd / math.sqrt(n)
    return mean - half, mean + half


def correlation_p(r: float, n: int) -> float:
    """p-value of a correlation of ``n`` rows."""
    if n < 3 or not math.isfinite(r):
        return float("nan")
    return 0.0 if abs(r) >= 1 else t_tail(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def log_grid(low: float, high: float, n: int) -> list[float]:
    return [10 ** (math.log10(low) + k * (math.log10(high) - math.log10(low)) / (n - 1)) for k in range(n)]


def random_grid(axes: dict[str, list], trials: int, seed: int) -> list[dict]:
    """Distinct random points of the product of ``axes``."""
    total = math.prod(len(v) for v in axes.values())
    out = []
    for at in random.Random(seed).sample(range(total), min(trials, total)):
        point = {}
        for name, values in axes.items():
            at, k = divmod(at, len(values))
            point[name] = values[k]
        out.append(point)
    return out
