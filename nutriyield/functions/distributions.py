"""Student-t quantile as a column of built-in functions, and its numpy form.

Used once per (group, variable) for confidence intervals, never per raw row.
The CDF is the regularised incomplete beta function (one continued fraction for
all degrees of freedom); the quantile is found by Newton steps from the normal
quantile, which lies to its left, where the steps rise without overshooting.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

def _norm_ppf(p: float) -> float:
    """Inverse standard normal CDF by bisection on erf (scalar, done once)."""
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        if 0.5 * (1 + math.erf(mid / math.sqrt(2))) < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function, to machine precision."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    f, m = d.copy(), 0
    while True:
        m += 1
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        step = np.ones_like(x)
        for n in (even, odd):
            d, c = 1 + n * d, 1 + n / c
            d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            step = step * d * c
        f = f * step
        if np.all(np.abs(step - 1) < 3e-16) or m > 1_000_000:
            return f


def _log_beta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(u) + math.lgamma(v) - math.lgamma(u + v) for u, v in zip(a, b)])


def t_cdf_abs(t: np.ndarray, nu: np.ndarray) -> np.ndarray:
    """P(|T| <= t) for ``nu`` > 0 and t > 0."""
    y = t * t / (nu + t * t)  # I_y(1/2, nu/2)
    half, a = np.full_like(nu, 0.5), nu / 2
    front = np.exp(half * np.log(y) + a * np.log1p(-y) - _log_beta(half, a))
    left = y < 1.5 / (a + 2.5)
    out = np.empty_like(t)
    if left.any():
        out[left] = front[left] * _beta_fraction(half[left], a[left], y[left]) / 0.5
    if (~left).any():
        r = ~left
        out[r] = 1 - front[r] * _beta_fraction(a[r], half[r], 1 - y[r]) / a[r]
    return out


def t_quantile_np(p: float, nu: np.ndarray) -> np.ndarray:
    """Quantile of Student's t (p > 0.5) for an array of degrees of freedom."""
    nu = np.asarray(nu, dtype=float)
    res = np.full(nu.shape, np.nan)
    ok = np.isfinite(nu) & (nu >= 1)
    if ok.any():
        v = np.floor(nu[ok])
        t = np.full_like(v, _norm_ppf(p))
        log_scale = -_log_beta(np.full_like(v, 0.5), v / 2) - 0.5 * np.log(v)
        for _ in range(500):
            density = np.exp(log_scale - (v + 1) / 2 * np.log1p(t * t / v))
            step = (2 * p - 1 - t_cdf_abs(t, v)) / (2 * density)
            t = t + step
            if np.all(np.abs(step) <= 1e-13 * t):
                break
        res[ok] = t
    return res


def t_quantile(p: float, df_col, steps: int = 16, panels: int = 1024, shift: int = 50) -> Column:
    """Column of ``qt(p, df)`` (0.5 < p < 1) in built-in functions; NULL below one degree of freedom.

    With u = sqrt(nu) tan(a), P(0 < T < t) is a constant times the integral of
    cos(a)^(nu - 1) up to atan(t / sqrt(nu)): smooth for every nu, so Simpson's rule
    with a fixed number of panels is exact to rounding.  Newton steps from the normal
    quantile rise to the root without overshooting.  The constant holds
    Gamma((nu + 1) / 2) / Gamma(nu / 2): its series at nu + 2 * shift, taken back by
    the recurrence.
    """
    c = F.col(df_col) if isinstance(df_col, str) else df_col
    nu = F.floor(c.cast("double")).cast("double")
    x = nu / 2 + shift
    series = F.sqrt(x) * (1 - 1 / (8 * x) + 1 / (128 * x ** 2) + 5 / (1024 * x ** 3) - 21 / (32768 * x ** 4) - 399 / (262144 * x ** 5) + 869 / (4194304 * x ** 6))
    ratio = F.aggregate(F.sequence(F.lit(0), F.lit(shift - 1)), series, lambda acc, j: acc * (nu + 2 * j) / (nu + 2 * j + 1))
    density0 = ratio / F.sqrt(nu * math.pi)

    def newton(t: Column, _: Column) -> Column:
        top = F.atan(t / F.sqrt(nu))
        power = lambda i: F.when(i == panels, F.pow(1 + t * t / nu, -(nu - 1) / 2)).otherwise(F.pow(F.cos(top * i / panels), nu - 1))
        weight = lambda i: F.when((i == 0) | (i == panels), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
        area = F.aggregate(F.sequence(F.lit(0), F.lit(panels)), F.lit(0.0), lambda acc, i: acc + weight(i) * power(i)) * top / (3 * panels)
        below = density0 * F.sqrt(nu) * area
        return t + (p - 0.5 - below) / (density0 * F.pow(1 + t * t / nu, -(nu + 1) / 2))

    root = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(_norm_ppf(p)), newton)
    return F.when(nu >= 1, root)
