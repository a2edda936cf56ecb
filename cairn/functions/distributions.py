"""Distribution functions in closed or iterated form, for the driver's few test statistics."""

from __future__ import annotations

import math


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function: series below a + 1, continued fraction above."""
    if x <= 0:
        return 0.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return total * scale
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - scale * h


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or 1e-300)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * h


def chi2_sf(x: float, k: float) -> float:
    return 1 - gamma_p(k / 2, x / 2)


def t_sf2(t: float, df: float) -> float:
    """Two-sided p of a t statistic."""
    return beta_i(df / 2, 0.5, df / (df + t * t))


def f_sf(f: float, a: float, b: float) -> float:
    return beta_i(b / 2, a / 2, b / (b + a * f)) if f > 0 else 1.0


def _root(fn, lo: float, hi: float) -> float:
    for _ in range(200):
        mid = (lo + hi) / 2
        if fn(mid) < 0:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def t_quantile(p: float, df: float) -> float:
    return _root(lambda t: (1 - t_sf2(t, df) / 2 if t >= 0 else t_sf2(t, df) / 2) - p, -1e4, 1e4)


def chi2_quantile(p: float, k: float) -> float:
    return _root(lambda x: gamma_p(k / 2, x / 2) - p, 0.0, 1e5)
