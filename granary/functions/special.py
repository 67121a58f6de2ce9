"""Special functions to about twelve digits as Column expressions, and the maximum-likelihood gamma fit built on them."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Coefficients of the asymptotic series of ln Gamma, digamma and trigamma (Bernoulli numbers).
LOG_GAMMA_SERIES = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)
DIGAMMA_SERIES = (-1 / 12, 1 / 120, -1 / 252, 1 / 240, -1 / 132)
TRIGAMMA_SERIES = (1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66)
# Normal quantile, Wichura (1988), algorithm AS 241: centre, and tail down to probabilities of 1e-11.
QUANTILE_CENTRE = (
    (3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125,
     45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727),
    (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077,
     21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610),
)
QUANTILE_TAIL = (
    (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504,
     1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550,
     0.148103976427480074590, 0.0151986665636164571966, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
QUANTILE_CUT, QUANTILE_CENTRE_SHIFT, QUANTILE_TAIL_SHIFT = 0.425, 0.180625, 1.6
#: Steps that carry an argument up to where the asymptotic series are exact.
SHIFT = 8
#: Newton steps of the gamma fit; from its start value three are enough for twelve digits.
NEWTON_STEPS = 5


def polynomial(coefficients: tuple[float, ...], x: Column | np.ndarray) -> Column | np.ndarray:
    """c0 + c1 x + c2 x^2 + ... by Horner's rule."""
    out = float(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * x + float(c)
    return out


def log_gamma(x: Column) -> Column:
    """ln Gamma of positive numbers."""
    y = x + float(SHIFT)
    product = x
    for k in range(1, SHIFT):
        product = product * (x + float(k))
    series = polynomial(LOG_GAMMA_SERIES, 1.0 / (y * y)) / y
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(product)


def digamma(x: Column | np.ndarray, log: Callable = F.log) -> Column | np.ndarray:
    """Derivative of ln Gamma for positive numbers: columns, or arrays with their own ``log``."""
    y = x + float(SHIFT)
    below = sum((1.0 / (x + float(k)) for k in range(1, SHIFT)), 1.0 / x)
    return log(y) - 0.5 / y + polynomial(DIGAMMA_SERIES, 1.0 / (y * y)) / (y * y) - below


def trigamma(x: Column | np.ndarray) -> Column | np.ndarray:
    """Derivative of digamma for positive numbers."""
    y = x + float(SHIFT)
    below = sum((1.0 / ((x + float(k)) * (x + float(k))) for k in range(1, SHIFT)), 1.0 / (x * x))
    return 1.0 / y + 0.5 / (y * y) + polynomial(TRIGAMMA_SERIES, 1.0 / (y * y)) / (y * y * y) + below


def gamma_shape_start(gap: np.ndarray) -> np.ndarray:
    """Shape whose ln a - digamma(a) is about ``gap``, the log of the mean less the mean log; within 1.5 %."""
    return (3.0 - gap + np.sqrt((gap - 3.0) * (gap - 3.0) + 24.0 * gap)) / (12.0 * gap)


def gamma_shape_step(shape: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """One Newton step of the likelihood equation in 1 / shape, where it is nearly a line (Minka 2002)."""
    slope = shape * shape * (1.0 / shape - trigamma(shape))
    return 1.0 / (1.0 / shape + (np.log(shape) - digamma(shape, np.log) - gap) / slope)


@F.pandas_udf(T.DoubleType())
def gamma_shape(gap: pd.Series) -> pd.Series:
    """The shape of the gamma distribution of largest likelihood, a batch of rows at a time; missing where ``gap`` is."""
    at = np.asarray(gap, dtype="float64")
    with np.errstate(all="ignore"):
        shape = gamma_shape_start(at)
        for _ in range(NEWTON_STEPS):
            shape = gamma_shape_step(shape, at)
    return pd.Series(shape)


@F.pandas_udf(T.DoubleType())
def _gamma_p(shape: pd.Series, x: pd.Series, log_gamma_of_shape: pd.Series) -> pd.Series:
    """P(shape, x) of positive arguments, a batch of rows at a time; missing where an argument is."""
    a_all, v_all, lg_all = (np.asarray(c, dtype="float64") for c in (shape, x, log_gamma_of_shape))
    out = np.full(len(a_all), np.nan)
    usable = ~(np.isnan(a_all) | np.isnan(v_all))
    low = usable & (v_all < a_all + 1.0)
    with np.errstate(all="ignore"):
        weight = np.exp(a_all * np.log(v_all) - v_all - lg_all)
        for at, method in ((low, _power_series), (usable & ~low, _continued_fraction)):
            if at.any():
                out[at] = method(a_all[at], v_all[at], weight[at])
    return pd.Series(out)


def _terms(a: np.ndarray) -> np.ndarray:
    return np.ceil(9.0 * np.sqrt(a)).astype("int64") + 40


def _power_series(a: np.ndarray, v: np.ndarray, weight: np.ndarray) -> np.ndarray:
    term = 1.0 / a
    total = term.copy()
    # A term that no longer changes the total stays so small: terms fall from here on, as v < a + 1.
    for k in range(1, int(_terms(a).max()) + 1):
        term = term * v / (a + k)
        total += term
        if not (term > 1e-17 * total).any():
            break
    return weight * total


def _continued_fraction(a: np.ndarray, v: np.ndarray, weight: np.ndarray) -> np.ndarray:
    first = v + 1.0 - a
    c, d = np.full(len(a), 1e300), 1.0 / first
    h = d.copy()
    for k in range(1, int(_terms(a).max()) + 1):
        numerator, b = -k * (k - a), first + 2.0 * k
        d = 1.0 / (b + numerator * d)
        c = b + numerator / c
        h *= c * d
        if not (np.abs(c * d - 1.0) > 1e-16).any():
            break
    return 1.0 - weight * h


def gamma_p(shape: Column, x: Column) -> Column:
    """Regularised lower incomplete gamma function P(shape, x).

    Below shape + 1 the power series, above it the continued fraction by Lentz's rule; both take a number of terms
    that grows with the root of the shape, and end where no row of the batch changes any more.
    """
    inside = _gamma_p(shape, F.greatest(x, F.lit(1e-300)), log_gamma(shape))
    return F.when(x <= 0, F.lit(0.0)).when(x.isNotNull() & shape.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), inside)))


def normal_quantile(p: Column) -> Column:
    """Quantile of the standard normal distribution for probabilities of 1e-11 and more on either side."""
    q = p - 0.5
    ratio = lambda pair, at: polynomial(pair[0], at) / polynomial(pair[1], at)
    tail = F.sqrt(-F.log(F.when(q < 0, p).otherwise(1.0 - p)))
    centre = q * ratio(QUANTILE_CENTRE, QUANTILE_CENTRE_SHIFT - q * q)
    return F.when(F.abs(q) <= QUANTILE_CUT, centre).otherwise(F.signum(q) * ratio(QUANTILE_TAIL, tail - QUANTILE_TAIL_SHIFT))
