"""Distribution functions applied to aggregated rows (one row per test).

Neither Spark nor numpy ships the incomplete beta and gamma functions, so the
few scalar formulas live here. They run as UDFs on summary rows only, never on
the facts.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql import types as T


def norm_sf2(z):
    """Two-sided normal tail."""
    return None if z is None else math.erfc(abs(z) / math.sqrt(2.0))


def norm_cdf(z):
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def norm_ppf(p):
    """Normal quantile by bisection on erfc, refined with Newton steps."""
    if p is None or not 0.0 < p < 1.0:
        return None
    lo, hi = -40.0, 40.0
    for _ in range(60):
        mid = 0.5 * (lo + hi)
        if norm_cdf(mid) < p:
            lo = mid
        else:
            hi = mid
    x = 0.5 * (lo + hi)
    for _ in range(2):
        dens = math.exp(-0.5 * x * x) / math.sqrt(2 * math.pi)
        if dens > 0:
            x -= (norm_cdf(x) - p) / dens
    return x


def beta_inc(a, b, x):
    """Regularised incomplete beta I_x(a, b) by Lentz's continued fraction."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_inc(b, a, 1.0 - x)
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 10000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for coef in (even, odd):
            d = 1.0 + coef * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + coef / c
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * total / a


def gamma_q(a, x):
    """Upper regularised incomplete gamma Q(a, x)."""
    if x <= 0.0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1.0
            term *= x / n
            total += term
        return max(0.0, 1.0 - total * scale)
    tiny = 1e-300
    b = x + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    h = d
    for i in range(1, 10000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return scale * h


def t_sf2(t, df):
    """Two-sided Student tail."""
    if t is None or df is None or df <= 0:
        return None
    return beta_inc(df / 2.0, 0.5, df / (df + t * t))


def t_cdf(t, df):
    tail = 0.5 * t_sf2(t, df)
    return 1.0 - tail if t > 0 else tail


def t_ppf(p, df):
    """Student quantile by bisection."""
    if p is None or df is None or df <= 0:
        return None
    lo, hi = -1.0, 1.0
    while t_cdf(lo, df) > p:
        lo *= 2.0
    while t_cdf(hi, df) < p:
        hi *= 2.0
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if t_cdf(mid, df) < p:
            lo = mid
        else:
            hi = mid
    return 0.5 * (lo + hi)


def f_sf(f, d1, d2):
    if f is None or d1 is None or d2 is None or d1 <= 0 or d2 <= 0:
        return None
    return 1.0 if f <= 0 else beta_inc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def chi2_sf(x, df):
    if x is None or df is None or df <= 0:
        return None
    return gamma_q(df / 2.0, x / 2.0)


_double = T.DoubleType()
norm_sf2_udf = F.udf(norm_sf2, _double)
t_sf2_udf = F.udf(t_sf2, _double)
t_ppf_udf = F.udf(t_ppf, _double)
f_sf_udf = F.udf(f_sf, _double)
chi2_sf_udf = F.udf(chi2_sf, _double)
norm_cdf_udf = F.udf(lambda z: None if z is None else norm_cdf(z), _double)
