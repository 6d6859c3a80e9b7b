"""Distribution functions for the Python side of grouped operators (no SciPy)."""

from __future__ import annotations

import math


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised I_x(a, b), by the continued fraction on its fast side."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    total = d
    for m in range(1, 300):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + step * d) or tiny)
            c = (1 + step / c) or tiny
            total *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * total


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F > f)."""
    return 1.0 if f <= 0 else incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def t_two_sided(t: float, dof: float) -> float:
    return incomplete_beta(dof / 2, 0.5, dof / (dof + t * t))


def normal_quantile(p: float) -> float:
    """By bisection on erf: exact enough for sampling plans."""
    low, high = -9.0, 9.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if (1 + math.erf(mid / math.sqrt(2))) / 2 < p else (low, mid)
    return (low + high) / 2
