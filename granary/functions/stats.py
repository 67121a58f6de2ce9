"""Distribution functions as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abramowitz & Stegun 7.1.26 (error function).
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)

# Abramowitz & Stegun 26.2.23 (normal quantile).
QUANTILE_C = (2.515517, 0.802853, 0.010328)
QUANTILE_D = (1.432788, 0.189269, 0.001308)
Z_LIMIT = 3.5
P_FLOOR = 1e-6


def erf(x: Column) -> Column:
    z = F.abs(x)
    t = 1.0 / (1.0 + ERF_P * z)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    return F.signum(x) * (1.0 - poly * F.exp(-z * z))


def norm_cdf(z: Column) -> Column:
    return 0.5 * (1.0 + erf(z / math.sqrt(2.0)))


def tail_root(p: Column) -> Column:
    return F.sqrt(-2.0 * F.log(F.when(p < 0.5, p).otherwise(1.0 - p)))


def norm_quantile(p: Column, t: Column | None = None) -> Column:
    """Rational approximation, +-3.5 at the ends; ``t`` is ``tail_root(p)`` if that is a column already."""
    t = tail_root(p) if t is None else t
    c0, c1, c2 = QUANTILE_C
    d1, d2, d3 = QUANTILE_D
    z = t - (c0 + t * (c1 + c2 * t)) / (1.0 + t * (d1 + t * (d2 + d3 * t)))
    return (
        F.when(p <= 0, F.lit(-Z_LIMIT))
        .when(p >= 1, F.lit(Z_LIMIT))
        .otherwise(F.when(p < 0.5, F.lit(-1.0)).otherwise(F.lit(1.0)) * z)
    )


def clip(col: Column, low: float, high: float) -> Column:
    """NULL-preserving clamp (greatest/least alone would skip NULL)."""
    return F.when(col.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), col)))


def wilson_hilferty(x: Column, shape: Column, scale: Column) -> Column:
    """Cube-root transform under which a gamma variable is nearly standard normal."""
    spread = 1.0 / (9.0 * shape)
    return (F.pow(x / (shape * scale), F.lit(1.0 / 3.0)) - (1.0 - spread)) / F.sqrt(spread)


def gamma_cdf_from_z(x: Column, shape: Column, scale: Column, z: Column) -> Column:
    """Gamma distribution function, given the transformed value ``z`` as a column."""
    return (
        F.when(x <= 0, F.lit(0.0))
        .when((shape * scale <= 0) | (shape <= 0), F.lit(0.5))
        .otherwise(clip(norm_cdf(z), 0.0, 1.0))
    )


def gamma_cdf(x: Column, shape: Column, scale: Column) -> Column:
    return gamma_cdf_from_z(x, shape, scale, wilson_hilferty(x, shape, scale))


def chi2_tail_2df(x: Column) -> Column:
    return F.when(x <= 0, F.lit(1.0)).otherwise(F.exp(-0.5 * x))


def two_sided_p(z: Column) -> Column:
    return clip(2.0 * (1.0 - norm_cdf(F.abs(z))), 0.0, 1.0)


def chi2_tail(x: Column, df: Column) -> Column:
    """Upper tail of chi-square by the Wilson-Hilferty cube root."""
    spread = 2.0 / (9.0 * df)
    z = (F.pow(F.greatest(x, F.lit(0.0)) / df, F.lit(1.0 / 3.0)) - (1.0 - spread)) / F.sqrt(spread)
    return F.when(x.isNotNull(), clip(1.0 - norm_cdf(z), 0.0, 1.0))


def f_tail(x: Column, above: Column, below: Column) -> Column:
    """Upper tail of the F distribution with ``above`` and ``below`` degrees of freedom (Paulson's cube root)."""
    a, b = 2.0 / (9.0 * above), 2.0 / (9.0 * below)
    root = F.pow(F.greatest(x, F.lit(0.0)), F.lit(1.0 / 3.0))
    z = ((1.0 - b) * root - (1.0 - a)) / F.sqrt(b * root * root + a)
    return F.when(x.isNotNull(), clip(1.0 - norm_cdf(z), 0.0, 1.0))


def chi2_tail_normal(stat: Column, df: Column) -> Column:
    """Upper tail of chi-square by its normal approximation."""
    return clip(1.0 - norm_cdf((stat - df) / F.sqrt(2.0 * df)), 0.0, 1.0)
