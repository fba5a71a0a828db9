"""p-values of the two-sample and correlation tests.

All take already aggregated statistics, so they run on one row per comparison.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Sizes of both samples up to which the two-sample p-value is exact.
EXACT_SIZE = 10_000


def exact_kolmogorov_pvalue_of(d: float, n: int, m: int) -> float:
    """Exact chance that two samples of one continuous law, of sizes ``n`` and ``m``, lie ``d`` apart or more.

    Every merged order of the samples is a lattice path from (0, 0) to (n, m). ``out[i]`` is the share of the paths to
    (i, k - i) that have left the band |i/n - j/m| < d, one antidiagonal k after the other; a share needs no large
    numbers and loses no digits where it is small.
    """
    common = math.gcd(n, m)
    up, right = m // common, n // common
    # The statistic is a whole multiple of 1 / lcm(n, m).
    far = round(d * n * up)
    if far <= 0:
        return 1.0
    out = np.zeros(n + 1)
    for k in range(1, n + m + 1):
        low, high = max(0, k - m), min(n, k)
        i = np.arange(low, high + 1)
        below = np.where(i > 0, out[i - 1], 0.0)
        share = (i * below + (k - i) * out[i]) / k
        out[i] = np.where(np.abs(i * up - (k - i) * right) >= far, 1.0, share)
    return float(min(1.0, out[n]))


def kolmogorov_pvalue(d: Column, n: Column, m: Column) -> Column:
    """Two-sample Kolmogorov p-value for statistic ``d``: exact up to ``EXACT_SIZE`` rows a sample, asymptotic beyond."""
    exact = exact_kolmogorov_pvalue_of

    @F.pandas_udf("double")
    def small(ds: pd.Series, ns: pd.Series, ms: pd.Series) -> pd.Series:
        found = (None if pd.isna(x) else exact(float(x), int(a), int(b)) for x, a, b in zip(ds, ns, ms))
        return pd.Series(list(found), dtype="float64")

    is_small = F.greatest(n, m) <= EXACT_SIZE
    # Python calls run for every branch: what is not small goes in as NULL.
    return F.when(is_small, small(F.when(is_small, d), n, m)).otherwise(asymptotic_kolmogorov_pvalue(d, n, m))


def asymptotic_kolmogorov_pvalue(d: Column, n: Column, m: Column) -> Column:
    """Limit of the p-value for large samples."""
    n, m = n.cast("double"), m.cast("double")
    lam = d * F.sqrt(F.try_divide(n * m, n + m))
    terms = F.transform(
        F.sequence(F.lit(1), F.lit(100)),
        lambda k: F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * lam * lam),
    )
    tail = F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)
    # The alternating series only converges for lam away from 0, where the value is 1.
    return F.when(lam < 0.2, 1.0).when(lam.isNotNull(), F.least(F.greatest(tail, F.lit(0.0)), F.lit(1.0)))


def beta_fraction(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b) by the continued fraction."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_fraction(b, a, 1.0 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for i in range(1, 500):
        even = i * (b - i) * x / ((a + 2 * i - 1) * (a + 2 * i))
        odd = -(a + i) * (a + b + i) * x / ((a + 2 * i) * (a + 2 * i + 1))
        for step in (even, odd):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * value / a


#: Degrees of freedom above which the t distribution is replaced by the corrected normal.
LARGE_DOF = 1_000_000


def correlation_pvalue_of(r: float, n: int) -> float:
    """Two-sided p-value of a correlation coefficient over ``n`` pairs."""
    if n is None or r is None or math.isnan(r) or n < 3:
        return float("nan")
    dof = n - 2
    if dof > LARGE_DOF:
        # The beta fraction loses digits here; the normal tail with its 1/dof term does not.
        if abs(r) >= 1.0:
            return 0.0
        t = abs(r) * math.sqrt(dof / ((1.0 - r) * (1.0 + r)))
        if t * t > 0.1 * dof:
            return 0.0
        return math.erfc(t * (1.0 - (t * t + 1.0) / (4.0 * dof)) / math.sqrt(2.0))
    # t = r*sqrt(dof/(1-r^2)), so dof/(dof+t^2) is exactly 1-r^2.
    return beta_fraction(dof / 2.0, 0.5, max(0.0, 1.0 - r * r))


def correlation_pvalue(r: Column, n: Column) -> Column:
    """Column form of :func:`correlation_pvalue_of`, for aggregated rows."""
    scalar = correlation_pvalue_of

    @F.pandas_udf("double")
    def pvalue(rs: pd.Series, ns: pd.Series) -> pd.Series:
        return pd.Series([scalar(float(r), int(n)) for r, n in zip(rs, ns)])

    return pvalue(r, n)


def chi2_quantile(p: float, dof: int) -> float:
    """Chi-square quantile by bisection on the regularised lower gamma series."""

    def cdf(x: float) -> float:
        a, half = dof / 2.0, x / 2.0
        term = 1.0 / a
        total, k = term, 1
        while term > total * 1e-15 and k < 10_000:
            term *= half / (a + k)
            total += term
            k += 1
        return total * math.exp(a * math.log(half) - half - math.lgamma(a))

    low, high = 1e-12, 10.0 * dof + 100.0
    for _ in range(200):
        mid = (low + high) / 2.0
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return (low + high) / 2.0
