"""Student-t and chi-square tails and quantiles for real-valued degrees of freedom."""

from __future__ import annotations

import math


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d, f = 1.0, 0.0, 1.0
    for k in range(1000):
        m = k // 2
        if k == 0:
            term = 1.0
        elif k % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + term * d) if abs(1 + term * d) > 1e-300 else 1e300
        c = 1 + term / c if abs(c) > 1e-300 else 1e300
        f *= c * d
        if k and abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1) if f != 1 else front


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|)."""
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def _solve(f, lo: float, hi: float) -> float:
    """Root of an increasing function by bisection."""
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return (lo + hi) / 2


def t_quantile(p: float, df: float) -> float:
    """Upper quantiles, p > 0.5."""
    return _solve(lambda t: 2 * (1 - p) and -(t_two_sided(t, df) - 2 * (1 - p)), 0.0, 1e6)


def gamma_inc(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function by its series or continued fraction."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-17 * abs(total):
            k += 1
            term *= x / k
            total += term
        return front * total
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for k in range(1, 1000):
        an = -k * (k - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return 1 - front * h


def chi2_quantile(p: float, df: float) -> float:
    return 2 * _solve(lambda x: gamma_inc(df / 2, x) - p, 0.0, 10 * df + 1000)
