"""Numeric column expressions. NaN counts as missing everywhere: comparisons with it are false, not true."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Denominators below this are no denominators.
TINY = 1e-12
#: Scores and verdicts by least value. Fixed values.
PERCENT_RULES = ((0.0, 0, "Negative"), (5.0, 1, "Low"), (20.0, 2, "Moderate"), (60.0, 3, "Strong"))
RATIO_RULES = ((1.0, 0, "Negative"), (2.0, 1, "Low"), (4.0, 2, "Moderate"), (6.0, 3, "Strong"))
#: Ordinal scores by largest percentage. Fixed values.
CDC_SCORES = ((10.0, 1), (20.0, 2), (50.0, 4), (80.0, 6))


def finite(x: Column) -> Column:
    """``x``, or null where it is NaN or infinite."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """``x`` within bounds; null stays null (``greatest`` and ``least`` alone would skip it)."""
    out = x
    if low is not None:
        out = F.greatest(F.lit(low), out)
    if high is not None:
        out = F.least(F.lit(high), out)
    return F.when(x.isNotNull(), out)


def asinh_t(x: Column, cofactor: Column | float) -> Column:
    c = cofactor if isinstance(cofactor, Column) else F.lit(float(cofactor))
    return F.asinh(x / F.greatest(c, F.lit(TINY)))


def sinh_inverse(t: Column, cofactor: Column) -> Column:
    """Back from :func:`asinh_t`; null unless both are finite and the cofactor is positive."""
    return F.when((finite(cofactor) > 0) & finite(t).isNotNull(), F.sinh(t) * cofactor)


def log1p_clipped(x: Column) -> Column:
    return F.log1p(clip(x, low=0.0))


def safe_ratio(num: Column, den: Column) -> Column:
    den = F.when(F.abs(finite(den)) >= TINY, den)
    return finite(num) / den


def fluorescence_index(sample: Column, negative: Column, positive: Column) -> Column:
    """Percent of the way from the negative to the positive control."""
    return safe_ratio(finite(sample) - finite(negative), finite(positive) - finite(negative)) * 100.0


def corrected_fraction(raw: Column, negative: Column, positive: Column) -> Column:
    """Control-corrected percentage, clipped to 0..100; null where undefined or the controls are equal."""
    span = F.when(finite(positive) != finite(negative), positive - negative)
    return clip((finite(raw) - negative) / span * 100.0, 0.0, 100.0)


def red_green_ratio(red: Column, green: Column) -> Column:
    return red / clip(green, low=1e-6)


def cdc_score(percent: Column, missing_as_8: bool = False) -> Column:
    """Ordinal score 1, 2, 4, 6 or 8 of a percentage; missing stays missing unless asked otherwise."""
    out = F.lit(8)
    for most, score in reversed(CDC_SCORES):
        out = F.when(percent <= most, F.lit(score)).otherwise(out)
    p = finite(percent)
    return F.when(p.isNull(), F.lit(8 if missing_as_8 else None)).otherwise(out).cast("int")


def rule_of(value: Column, rules=PERCENT_RULES) -> Column:
    """Struct (score, verdict) of the rule with the largest lower bound <= value; the lowest rule if none."""
    ordered = sorted(rules)
    make = lambda r: F.struct(F.lit(r[1]).alias("score"), F.lit(r[2]).alias("verdict"))
    out = make(ordered[0])
    for rule in ordered[1:]:
        out = F.when(value >= rule[0], make(rule)).otherwise(out)
    return F.when(finite(value).isNotNull(), out)


def call(percent: Column, cutoff: float) -> Column:
    p = finite(percent)
    return F.when(p.isNull(), "not_available").when(p >= cutoff, "positive").otherwise("negative")


def borderline(percent: Column, low: float = 15.0, high: float = 25.0) -> Column:
    return F.coalesce(finite(percent).between(low, high), F.lit(False))


def well_column(well: Column) -> Column:
    digits = F.regexp_extract(well, r"(\d+)$", 1)
    return F.when(digits != "", digits).cast("int")


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function; Hastings' rational formula for erf, absolute error below 1.5e-7."""
    z = F.abs(x) / math.sqrt(2)
    t = 1.0 / (1.0 + 0.3275911 * z)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1.0 - poly * F.exp(-z * z)
    return 0.5 * (1.0 + F.when(x < 0, -erf).otherwise(erf))


def normal_sf(x: Column) -> Column:
    """Upper tail of the standard normal distribution, to about 12 digits: a power series near 0, a continued fraction beyond."""
    z = F.abs(x) / math.sqrt(2)
    square = z * z
    series, fraction = F.lit(1.0), z
    for k in range(40, 0, -1):
        series = 1.0 + 2.0 * square / (2 * k + 1) * series
        fraction = z + (k / 2.0) / fraction
    near = 1.0 - 2.0 / math.sqrt(math.pi) * z * F.exp(-square) * series
    far = F.exp(-square) / (math.sqrt(math.pi) * fraction)
    tail = 0.5 * F.when(z < 2.0, near).otherwise(far)
    return F.when(x < 0, 1.0 - tail).otherwise(tail)


def gaussian2_logpdf(x: Column, y: Column, mean_x: Column, mean_y: Column, var_x: Column, var_y: Column, cov: Column) -> Column:
    """Log density of a 2-D Gaussian by the closed-form inverse of its covariance."""
    det = var_x * var_y - cov * cov
    dx, dy = x - mean_x, y - mean_y
    square = (var_y * dx * dx - 2.0 * cov * dx * dy + var_x * dy * dy) / det
    return -0.5 * (square + F.log(det) + 2.0 * math.log(2 * math.pi))


def precision_recall_f1(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Rates of counts; where there is nothing to find and nothing found they are 1."""
    empty = (tp + fp + fn) == 0

    def rate(num: Column, den: Column) -> Column:
        return F.when(empty, 1.0).when(den == 0, 0.0).otherwise(num / F.when(den != 0, den))

    return rate(tp, tp + fp), rate(tp, tp + fn), rate(2.0 * tp, 2 * tp + fp + fn)


def oks(distance: Column, scale: Column | float, k: float = 0.1) -> Column:
    """Object keypoint similarity."""
    s = scale if isinstance(scale, Column) else F.lit(float(scale))
    return F.exp(-(distance * distance) / (2.0 * (k * s) * (k * s)))


def skip_outliers(z: Column, limit: float = 8.0) -> Column:
    return clip(z, -limit, limit)


def zero_if_not_finite(x: Column) -> Column:
    return F.coalesce(finite(x), F.lit(0.0))
