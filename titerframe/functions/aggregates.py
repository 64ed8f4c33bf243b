"""Aggregate expressions over finite values only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import finite


def _where(x: Column, condition: Column | None) -> Column:
    x = finite(x)
    return x if condition is None else F.when(condition, x)


def quantile(x: Column, q: float, condition: Column | None = None) -> Column:
    """Exact quantile with linear interpolation. Spark keeps a group's distinct values: use it where groups are files."""
    return F.percentile(_where(x, condition), F.lit(float(q)))


def median(x: Column, condition: Column | None = None) -> Column:
    return quantile(x, 0.5, condition)


def mean(x: Column, condition: Column | None = None) -> Column:
    return F.avg(_where(x, condition))


def sd(x: Column, condition: Column | None = None) -> Column:
    """Sample standard deviation, null for fewer than two values."""
    v = _where(x, condition)
    return F.when(F.count(v) >= 2, F.stddev_samp(v))


def spread(x: Column) -> Column:
    return F.max(finite(x)) - F.min(finite(x))


def percent_of(part: Column, whole: Column) -> Column:
    """100 * rows with ``part`` / rows with ``whole``, null if there are none."""
    n = F.count_if(whole)
    return 100.0 * F.count_if(part & whole) / F.when(n > 0, n)


def concordance(x: Column, y: Column) -> Column:
    """Concordance correlation coefficient."""
    both = finite(x).isNotNull() & finite(y).isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    gap = F.avg(x) - F.avg(y)
    den = F.var_pop(x) + F.var_pop(y) + gap * gap
    return 2.0 * F.covar_pop(x, y) / F.when(den > 0, den)
