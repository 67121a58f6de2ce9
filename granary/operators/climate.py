"""Standardised precipitation index and thermal anomaly for many series at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import special
from granary.functions.nulls import attach, nan_is_missing, stage
from granary.functions.stats import P_FLOOR, Z_LIMIT, clip, gamma_cdf_from_z, norm_quantile, tail_root, wilson_hilferty
from granary.operators.features import _series, full_rolling_sum
from granary.operators.ordered import fits, over_history
from granary.session import cut_lineage

# Sample sizes below which no index is given.
MIN_PERIODS = 12
MIN_POSITIVE = 3
TINY = 1e-6
#: Values whose mean log is that close to the log of their mean count as all equal.
NO_SPREAD = 1e-15
#: Ways to fit the gamma distribution: a closed formula with approximate tails, or maximum likelihood with exact ones.
CLOSED, LIKELIHOOD = "closed", "likelihood"


def _fit_sums(value: str, over=lambda c: c, end: str = "") -> dict[str, Column]:
    """Counts and means the fit needs, as aggregates or over a window; ``end`` closes their names."""
    x = F.col(value)
    positive = F.when(x > 0, x)
    return {
        f"__n{end}": over(F.count(x)),
        f"__n_pos{end}": over(F.count(positive)),
        f"__mean{end}": over(F.avg(positive)),
        f"__mean_log{end}": over(F.avg(F.when(x > 0, F.log(F.greatest(x, F.lit(TINY)))))),
    }


def _fit_parameters(min_periods: int, end: str = "", fit: str = CLOSED) -> dict[str, Column]:
    """Gamma fit of the positive values, closed (Thom 1958) or by maximum likelihood; NULL for small samples."""
    n, n_pos, mean, mean_log = (F.col(f"{c}{end}") for c in ("__n", "__n_pos", "__mean", "__mean_log"))
    gap = F.log(F.greatest(mean, F.lit(TINY))) - mean_log
    if fit == LIKELIHOOD:
        found = special.gamma_shape(gap)
    else:
        found = (1.0 + F.sqrt(1.0 + 4.0 * gap / 3.0)) / (4.0 * gap)
    shape = F.when(gap <= NO_SPREAD, F.lit(1.0)).otherwise(found)
    usable = (n >= min_periods) & (n_pos >= MIN_POSITIVE)
    return {f"q_zero{end}": F.when(usable, (n - n_pos) / n), f"shape{end}": F.when(usable, shape), f"scale{end}": F.when(usable, mean / shape)}


@nan_is_missing
def gamma_fit(accumulated: DataFrame, keys: list[str], value: str, min_periods: int = MIN_PERIODS, fit: str = CLOSED) -> DataFrame:
    """One row per series with ``q_zero``, ``shape`` and ``scale``.

    Sums only, so partial aggregates meet in the shuffle and series length is irrelevant.
    """
    sums = accumulated.groupBy(*keys).agg(*[c.alias(n) for n, c in _fit_sums(value).items()])
    return sums.select(*keys, *[c.alias(n) for n, c in _fit_parameters(min_periods, fit=fit).items()])


@nan_is_missing
def spi(
    df: DataFrame,
    value: str,
    group: str | list[str] | None,
    order_by: str | list[str],
    scale: int | list[int] = 3,
    min_periods: int = MIN_PERIODS,
    bounded: bool | None = None,
    fit: str = CLOSED,
) -> DataFrame:
    """Adds ``spi_{scale}`` for each scale: the gamma-normalised rolling sum of each series.

    Series known or counted to be short share one shuffle for all scales and for the fit;
    long ones fit by a separate aggregate that is joined back. ``fit`` is ``closed`` or
    ``likelihood``; both need the same four sums of a series.
    """
    if fit not in (CLOSED, LIKELIHOOD):
        raise ValueError(f"unknown fit {fit!r}")
    keys, order = _series(df, group, order_by)
    short = fits(df, keys, bounded)
    scales = [scale] if isinstance(scale, int) else list(scale)
    acc = {k: f"__acc{k}" for k in scales}
    out = over_history(df, keys, order, max(scales), lambda w: {acc[k]: full_rolling_sum(value, k, w) for k in scales}, short)
    sums = lambda over: {n: c for k in scales for n, c in _fit_sums(acc[k], over, str(k)).items()}
    fitted = {n: c for k in scales for n, c in _fit_parameters(min_periods, str(k), fit).items()}
    if short:
        whole = Window.partitionBy(*keys)
        out = out.withColumns(sums(lambda c: c.over(whole))).withColumns(fitted)
    else:
        # Read twice below, and built from ranged positions: compute it once.
        out = cut_lineage(out)
        totals = out.groupBy(*keys).agg(*[c.alias(n) for n, c in sums(lambda c: c).items()])
        out = attach(out, totals.select(*keys, *[c.alias(n) for n, c in fitted.items()]), keys, "left")
    indices = _exact_indices if fit == LIKELIHOOD else _indices
    return indices(out, scales).select(*df.columns, *[f"spi_{k}" for k in scales])


def _exact_indices(fitted: DataFrame, scales: list[int]) -> DataFrame:
    """Indices by the incomplete gamma function and the exact normal quantile."""
    of = lambda name, k: F.col(f"{name}{k}")

    # All scales together, so that rows go to the vectorised function once.
    below = fitted.withColumns({f"__below{k}": special.gamma_p(of("shape", k), of("__acc", k) / of("scale", k)) for k in scales})

    def probability(k: int) -> Column:
        mixed = F.when(of("__acc", k) <= 0, of("q_zero", k)).otherwise(of("q_zero", k) + (1.0 - of("q_zero", k)) * of("__below", k))
        return clip(mixed, P_FLOOR, 1.0 - P_FLOOR)

    staged = stage(below, {f"__p{k}": probability(k) for k in scales})
    known = lambda k: of("__acc", k).isNotNull() & of("q_zero", k).isNotNull()
    return staged.withColumns({f"spi_{k}": F.when(known(k), clip(special.normal_quantile(of("__p", k)), -Z_LIMIT, Z_LIMIT)) for k in scales})


def _indices(fitted: DataFrame, scales: list[int]) -> DataFrame:
    """Indices from the sums and fitted parameters of all scales together.

    Each formula repeats its argument many times, so the arguments are staged, once for all
    scales: a later filter on an index must not unfold them into one another.
    """
    of = lambda name, k: F.col(f"{name}{k}")
    staged = stage(fitted, {f"__wh{k}": wilson_hilferty(of("__acc", k), of("shape", k), of("scale", k)) for k in scales})

    def probability(k: int) -> Column:
        below = gamma_cdf_from_z(of("__acc", k), of("shape", k), of("scale", k), of("__wh", k))
        mixed = F.when(of("__acc", k) <= 0, of("q_zero", k)).otherwise(of("q_zero", k) + (1.0 - of("q_zero", k)) * below)
        return clip(mixed, P_FLOOR, 1.0 - P_FLOOR)

    staged = stage(staged, {f"__p{k}": probability(k) for k in scales})
    staged = stage(staged, {f"__t{k}": tail_root(of("__p", k)) for k in scales})
    known = lambda k: of("__acc", k).isNotNull() & of("q_zero", k).isNotNull()
    return staged.withColumns({f"spi_{k}": F.when(known(k), clip(norm_quantile(of("__p", k), of("__t", k)), -Z_LIMIT, Z_LIMIT)) for k in scales})


@nan_is_missing
def thermal_anomaly(
    df: DataFrame,
    value: str,
    date: str,
    group: str | list[str] | None = None,
    name: str = "anomalia_termica_z",
    bounded: bool = False,
) -> DataFrame:
    """Z-score against the same calendar month of the series; 0 where there is no spread.

    By default aggregate and join back: the aggregate combines before the shuffle, and a
    hot (series, month) pair is split by the adaptive join. ``bounded`` promises short
    series, for which a window saves the second pass over the input.
    """
    keys = [group] if isinstance(group, str) else list(group or [])
    dated = df.withColumn("__mes", F.month(date))
    if bounded:
        month = Window.partitionBy(*keys, "__mes")
        joined = dated.withColumns({"__mu": F.avg(value).over(month), "__sd": F.stddev_samp(value).over(month)})
    else:
        stats = (
            dated.filter(F.col("__mes").isNotNull())
            .groupBy(*keys, "__mes")
            .agg(F.avg(value).alias("__mu"), F.stddev_samp(value).alias("__sd"))
        )
        joined = attach(dated, stats, [*keys, "__mes"], "left")
    flat = F.col("__sd").isNull() | (F.col("__sd") == 0)
    z = F.when(flat, F.lit(0.0)).otherwise((F.col(value) - F.col("__mu")) / F.col("__sd"))
    return joined.withColumn(name, F.when(F.col(value).isNotNull() & F.col("__mes").isNotNull(), z)).drop(
        "__mes", "__mu", "__sd"
    )
