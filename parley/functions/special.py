"""Tail probabilities, from series and continued fractions."""

from __future__ import annotations

import math
from functools import cache


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    out = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    b, c = x + 1 - a, 1e300
    d = 1 / b
    out = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def f_upper(f: float, d1: float, d2: float) -> float:
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def chi2_upper(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


@cache
def _u_ways(n: int, m: int) -> tuple[int, ...]:
    """How many of the orders of n and m distinct values give U = 0, 1, ...: coefficients of a Gaussian binomial."""
    ways = [1] + [0] * (n * m)
    for i in range(1, n + 1):
        for j in range(n * m, m + i - 1, -1):
            ways[j] -= ways[j - m - i]
        for j in range(i, n * m + 1):
            ways[j] += ways[j - i]
    return tuple(ways)


def mann_whitney(u: float, n: int, m: int, tie_term: float, exact_below: int = 8) -> float:
    """Two-sided p of U: exact if one sample is at most exact_below and nothing ties, else by the normal
    approximation with tie and continuity correction. tie_term: sum over ties of t**3 - t."""
    if not n or not m:
        return math.nan
    high = max(u, n * m - u)
    if tie_term == 0 and min(n, m) <= exact_below:
        ways = _u_ways(n, m)
        return min(1.0, 2 * sum(ways[math.ceil(high) :]) / sum(ways))
    total = n + m
    sd = math.sqrt(n * m / 12 * ((total + 1) - tie_term / (total * (total - 1))))
    return 1.0 if sd == 0 else min(1.0, normal_two_sided(max(0.0, (high - n * m / 2 - 0.5)) / sd))
