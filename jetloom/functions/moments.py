"""Aggregates that stay defined on constant columns.

Spark merges partial moments in floating point, so the variance of a constant column can
come out as 1e-32 instead of 0; and under ANSI arithmetic ``corr`` raises when it is 0.
Constancy is therefore decided by minimum and maximum, which are exact.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def variance(c: Column | str) -> Column:
    """Population variance, exactly 0 on a constant column."""
    c = _col(c)
    return F.when(F.min(c) == F.max(c), F.lit(0.0)).otherwise(F.var_pop(c))


def deviation(c: Column | str) -> Column:
    """Population standard deviation, exactly 0 on a constant column."""
    c = _col(c)
    return F.when(F.min(c) == F.max(c), F.lit(0.0)).otherwise(F.stddev_pop(c))


def correlation(a: Column | str, b: Column | str) -> Column:
    """Pearson correlation over rows where both are present; NULL for a constant column."""
    a, b = _col(a), _col(b)
    both_a, both_b = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(a, b), deviation(both_a) * deviation(both_b))
