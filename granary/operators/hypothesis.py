"""A battery of tests evaluated for all series at once.

Every test takes ``keys`` (the columns naming a series) and returns one row per series.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.casting import to_double
from granary.functions.nulls import attach, safe_divide
from granary.functions.special import normal_quantile, polynomial
from granary.functions.stats import chi2_tail_2df, chi2_tail_normal, clip, norm_cdf, two_sided_p
from granary.operators.features import add_difference
from granary.operators.lagged import lagged_products, unit_root, unit_root_p
from granary.operators.ordered import over_history, row_positions, running_total
from granary.session import cut_lineage, written

# Minimum sample sizes, significance level and decision words.
MIN_NORMALITY, MIN_TREND, MIN_STATIONARITY, MIN_GROUP = 8, 10, 15, 3
ALPHA = 0.05
SMALL_SPREAD = 1e-6
INSUFFICIENT, REJECT, KEEP = "INSUFICIENTE", "RECHAZA_H0", "NO_RECHAZA_H0"
UP, DOWN, NO_TREND = "ASCENDENTE", "DESCENDENTE", "ESTACIONARIA_SIN_TENDENCIA"
STATIONARY, NOT_STATIONARY = "ESTACIONARIA", "NO_ESTACIONARIA"
NORMALITY, TREND = "NORMALIDAD_JARQUE_BERA", "MANN_KENDALL_TENDENCIA"
STATIONARITY, GROUPS = "ESTACIONARIEDAD_ADF_KPSS", "KRUSKAL_WALLIS"
CATEGORIES = {NORMALITY: "Distribución", TREND: "Tendencia", STATIONARITY: "Estacionariedad", GROUPS: "Grupos_Regionales"}
# 5 % point of the Dickey-Fuller test with constant; KPSS level critical values.
ADF_CENTRE = 2.86
KPSS_POINTS = ((0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01))
# Shapiro-Wilk test, Royston (1995), AS R94: weights of the two outer order statistics by 1 / sqrt(n), then mean
# and log spread of the transformed statistic by n (up to 11 values) or by ln n.
SHAPIRO_LIMIT = 5_000
SHAPIRO_OUTER = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
SHAPIRO_NEXT = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
SHAPIRO_SMALL_LIMIT = (-2.273, 0.459)
SHAPIRO_SMALL_MEAN = (0.5440, -0.39978, 0.025054, -0.0006714)
SHAPIRO_SMALL_SPREAD = (1.3822, -0.77857, 0.062767, -0.0020322)
SHAPIRO_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
SHAPIRO_SPREAD = (-0.4803, -0.082676, 0.0030302)
# Rounds of the distributed search for a median slope, and the longest series that is searched inside one task instead.
SEARCH_ROUNDS = 64
SLOPE_LIMIT = 20_000


def _numbers(df: DataFrame, value: str) -> DataFrame:
    return df.withColumn(value, to_double(F.col(value), dict(df.dtypes)[value])).filter(F.col(value).isNotNull())


def _decide(enough: Column, p: Column, alpha: float = ALPHA) -> Column:
    return F.when(~enough, INSUFFICIENT).when(p < alpha, REJECT).otherwise(KEEP)


def normality(df: DataFrame, keys: list[str], value: str, shapiro: bool = False) -> DataFrame:
    """Jarque-Bera from population moments, in one mergeable aggregate.

    With ``shapiro``, series of up to 5,000 values also get the Shapiro-Wilk test (two more columns), and the smaller of both
    p-values decides.
    """
    moments =_numbers(df, value).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_observations"),
        F.var_pop(value).alias("__var"),
        F.skewness(value).alias("__skew"),
        F.kurtosis(value).alias("__excess"),
    )
    flat = F.col("__var") <= 0
    skew = F.when(flat, F.lit(0.0)).otherwise(F.col("__skew"))
    excess = F.when(flat, F.lit(-3.0)).otherwise(F.col("__excess"))
    enough = F.col("n_observations") >= MIN_NORMALITY
    jb = F.col("n_observations") / 6.0 * (skew * skew + excess * excess / 4.0)
    p = chi2_tail_2df(jb)
    more = []
    if shapiro:
        moments = attach(moments, shapiro_wilk(df, keys, value).drop("n"), keys, "left")
        p = F.least(p, F.col("shapiro_pvalue"))  # least skips NULL
        more = [F.when(enough, F.col(c)).alias(c) for c in ("shapiro_statistic", "shapiro_pvalue")]
    return moments.select(
        *keys,
        "n_observations",
        F.when(enough, jb).alias("statistic"),
        F.when(enough, p).alias("p_value"),
        F.when(enough, skew).alias("skewness"),
        F.when(enough, excess + 3.0).alias("kurtosis"),
        (enough & (p < 0.05)).alias("alpha_05_rejected"),
        (enough & (p < 0.01)).alias("alpha_01_rejected"),
        _decide(enough, p, 0.05).alias("decision"),
        *more,
    )


def shapiro_wilk(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, shapiro_statistic, shapiro_pvalue) of series of 6 to 5,000 values, after Royston (1995).

    Order statistics meet their normal scores by position; longer series are left out before anything is sorted, so each
    window is short. Constant series have no statistic.
    """
    clean = _numbers(df, value)
    sizes = clean.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("__mu")).where(F.col("n").between(6, SHAPIRO_LIMIT))
    kept = attach(clean.select(*keys, value), sizes, keys, "inner").withColumn("__x", F.col(value) - F.col("__mu"))
    placed = row_positions(kept, keys, [F.col("__x").asc()], "pos", bounded=True)
    score = normal_quantile((F.col("pos") + 1 - 0.375) / (F.col("n") + 0.25))
    placed = placed.select(*keys, "n", "pos", "__x", score.alias("__m"))
    at = lambda k, c: F.max(F.when(F.col("pos") == k, F.col(c)))
    last = F.col("n") - 1
    inside = (F.col("pos") >= 2) & (F.col("pos") < last - 1)
    sums = placed.groupBy(*keys, "n").agg(
        F.sum(F.col("__m") * F.col("__m")).alias("mm"),
        F.sum(F.when(inside, F.col("__m") * F.col("__x"))).alias("mx"),
        F.sum(F.col("__x") * F.col("__x")).alias("xx"),
        at(last, "__m").alias("m1"), at(last - 1, "__m").alias("m2"),
        (at(last, "__x") - at(0, "__x")).alias("x1"), (at(last - 1, "__x") - at(1, "__x")).alias("x2"),
    )
    n, mm, m1, m2 = (F.col(c) for c in ("n", "mm", "m1", "m2"))
    root = 1.0 / F.sqrt(n)
    weighed = sums.withColumns({"a1": m1 / F.sqrt(mm) + polynomial(SHAPIRO_OUTER, root), "a2": m2 / F.sqrt(mm) + polynomial(SHAPIRO_NEXT, root)})
    a1, a2 = F.col("a1"), F.col("a2")
    rest = (mm - 2.0 * m1 * m1 - 2.0 * m2 * m2) / (1.0 - 2.0 * a1 * a1 - 2.0 * a2 * a2)
    top = F.col("mx") / F.sqrt(rest) + a1 * F.col("x1") + a2 * F.col("x2")
    w = weighed.select(*keys, "n", F.when(F.col("xx") > 0, F.least(F.lit(1.0), top * top / F.col("xx"))).alias("w"))
    size, spread = n.cast("double"), F.log(F.greatest(1.0 - F.col("w"), F.lit(1e-300)))
    small_y = -F.log(F.greatest(polynomial(SHAPIRO_SMALL_LIMIT, size) - spread, F.lit(1e-300)))
    small = (small_y - polynomial(SHAPIRO_SMALL_MEAN, size)) / F.exp(polynomial(SHAPIRO_SMALL_SPREAD, size))
    large = (spread - polynomial(SHAPIRO_MEAN, F.log(size))) / F.exp(polynomial(SHAPIRO_SPREAD, F.log(size)))
    p = clip(1.0 - norm_cdf(F.when(n <= 11, small).otherwise(large)), 0.0, 1.0)
    return w.select(*keys, "n", F.col("w").alias("shapiro_statistic"), p.alias("shapiro_pvalue"))


def rank_concordance(placed: DataFrame, keys: list[str], value: str, sizes: DataFrame, bounded: bool | None = None) -> DataFrame:
    """Sum of sign(x_j - x_i) over all i < j, per series, from n log n rows.

    Two positions first differ in exactly one binary digit, counted from the top. At that
    digit's level the earlier one sits in the left half and the later one in the right half
    of the same block, so per block it is enough to walk the distinct values once and count
    the left members below and above each right member.
    """
    with_n = attach(placed, sizes, keys, "inner")
    levels = F.greatest(F.ceil(F.log2(F.col("n").cast("double"))).cast("int"), F.lit(1))
    spread = with_n.withColumn("level", F.explode(F.sequence(F.lit(0), levels - 1)))
    half = F.expr("shiftright(pos, level)")
    halves = spread.select(*keys, "n", "level", value, (half % 2).alias("side"), F.expr("shiftright(pos, level + 1)").alias("block"))
    counted = halves.groupBy(*keys, "n", "level", "block", value).agg(
        F.count_if(F.col("side") == 0).alias("left"), F.count_if(F.col("side") == 1).alias("right")
    )
    group = [*keys, "n", "level", "block"]
    walked = running_total(counted, group, [F.col(value).asc()], {"below": F.col("left")}, bounded)
    width = F.expr("shiftleft(1L, level)")
    all_left = F.least(width, F.col("n") - F.col("block") * 2 * width)
    signed = F.col("right") * (2 * F.col("below") + F.col("left") - all_left)
    return walked.groupBy(*keys).agg(F.sum(signed).cast("bigint").alias("statistic_s"))


def _not_rising(y: np.ndarray) -> int:
    """Number of i < j with y[j] <= y[i], by counting in halves level by level."""
    n = len(y)
    rank = np.unique(y, return_inverse=True)[1].astype(np.int64)
    pos, total, level = np.arange(n), 0, 0
    while (1 << level) < n:
        block, right = pos >> (level + 1), (pos >> level) & 1
        # Within a block: higher ranks first, and among equals the left half first.
        order = np.lexsort((right, -rank, block))
        left = 1 - right[order]
        seen = np.cumsum(left)
        starts = np.flatnonzero(np.diff(block[order], prepend=-1))
        before = np.where(starts > 0, seen[starts - 1], 0)
        inside = seen - np.repeat(before, np.diff(np.append(starts, n)))
        total += int(inside[left == 0].sum())
        level += 1
    return total


def _kth_slope(x: np.ndarray, k: int) -> float:
    """k-th smallest pair slope by bisection on the slope value."""
    pos = np.arange(len(x), dtype=float)
    steps = np.diff(x)
    low, high = float(steps.min()), float(steps.max())
    if _not_rising(x - low * pos) >= k:
        return low
    for _ in range(200):
        mid = low + (high - low) / 2.0
        if mid <= low or mid >= high or high - low <= 1e-14 * max(1.0, abs(high)):
            break
        if _not_rising(x - mid * pos) >= k:
            high = mid
        else:
            low = mid
    return high


def _median_slope(x: np.ndarray) -> float:
    pairs = len(x) * (len(x) - 1) // 2
    lower = _kth_slope(x, (pairs + 1) // 2)
    return lower if pairs % 2 else (lower + _kth_slope(x, pairs // 2 + 1)) / 2.0


def _slopes_in_tasks(placed: DataFrame, keys: list[str], value: str) -> DataFrame:
    schema = T.StructType([f for f in placed.schema.fields if f.name in keys] + [T.StructField("sens_slope", T.DoubleType())])
    names = [f.name for f in schema.fields]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("pos")[value].to_numpy(dtype=float)
        row = {k: pdf[k].iloc[0] for k in keys}
        row["sens_slope"] = _median_slope(x) if len(x) > 1 else 0.0
        return pd.DataFrame([row], columns=names)

    grouped = placed.select(*keys, "pos", value).groupBy(*keys)
    return grouped.applyInPandas(solve, schema)


def _slopes_by_search(placed: DataFrame, keys: list[str], value: str, sizes: DataFrame, probes: int = 16) -> DataFrame:
    """The same median for series too long for a task: a (probes + 1)-ary search in which
    each round counts, as a Spark job, the pairs at or below every probed slope."""
    placed, sizes = cut_lineage(placed), cut_lineage(sizes)
    steps = over_history(
        placed, keys, [F.col("pos")], 1, lambda w: {"__step": F.col(value) - F.lag(value).over(w)}, None
    )
    edges = steps.groupBy(*keys).agg(F.min("__step").alias("low"), F.max("__step").alias("high"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    brackets = attach(edges, sizes, keys, "inner").select(
        *keys, "n", "low", "high",
        F.explode(F.array(F.floor((pairs + 1) / 2), F.floor(pairs / 2) + 1)).alias("__k"),
    ).distinct()
    # One unit below the smallest slope nothing qualifies, so the bracket is half-open.
    brackets = written(brackets.withColumn("low", F.col("low") - (F.abs("low") * 1e-9 + 1e-9)), "slopes")
    for n_rounds in range(SEARCH_ROUNDS + 1):
        open_ = brackets.filter(F.col("high") - F.col("low") > 1e-14 * F.greatest(F.lit(1.0), F.abs("high")))
        if open_.isEmpty():
            break
        if n_rounds == SEARCH_ROUNDS:
            raise RuntimeError(f"median slopes did not settle in {SEARCH_ROUNDS} rounds")
        probe = F.transform(
            F.sequence(F.lit(1), F.lit(probes)),
            lambda i: F.struct(
                i.alias("__i"), (F.col("low") + (F.col("high") - F.col("low")) * i / (probes + 1)).alias("slope")
            ),
        )
        asked = open_.select(*keys, "__k", F.explode(probe).alias("p")).select(*keys, "__k", "p.__i", "p.slope")
        tilted = placed.alias("l").join(
            asked.alias("r"), [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in keys] or F.lit(True)
        ).select(*[F.col(f"l.{c}") for c in keys], "__k", "__i", "pos", (F.col(value) - F.col("slope") * F.col("pos")).alias("y"))
        # Pairs with y_j <= y_i, from the concordance of y and its tied pairs:
        # S = rising - falling and rising + falling + tied = all pairs.
        name = [*keys, "__k", "__i"]
        sign = rank_concordance(tilted, name, "y", attach(asked.select(*name), sizes, keys, "inner"))
        ties = tilted.groupBy(*name, "y").agg(F.count(F.lit(1)).alias("c")).groupBy(*name).agg(
            F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("tied")
        )
        counts = attach(attach(attach(asked, sign, name, "left"), ties, name, "left"), sizes, keys, "left")
        at_most = (pairs - F.col("statistic_s") + F.col("tied")) / 2
        hit = at_most >= F.col("__k")
        narrowed = counts.groupBy(*keys, "__k").agg(
            F.max(F.when(~hit, F.col("slope"))).alias("__low"), F.min(F.when(hit, F.col("slope"))).alias("__high")
        )
        brackets = written(
            attach(brackets, narrowed, [*keys, "__k"], "left").select(
                *keys, "n", F.coalesce("__low", "low").alias("low"), F.coalesce("__high", "high").alias("high"), "__k"
            ),
            "slopes",
        )
    return brackets.groupBy(*keys).agg(F.avg("high").alias("sens_slope"))


def median_slopes(
    placed: DataFrame, keys: list[str], value: str, sizes: DataFrame, bounded: bool | None = None, limit: int = SLOPE_LIMIT
) -> DataFrame:
    """Theil-Sen slope per series over positions 0, 1, 2, ... (exact median of pair slopes).

    A series that is longer than ``limit`` in spite of ``bounded=True`` is an error, found before its rows meet in a task.
    """
    if bounded:
        too_long = F.raise_error(F.lit(f"a series has more than the {limit} rows that bounded=True stands for"))
        return _slopes_in_tasks(placed.withColumn("pos", F.when(F.col("pos") < limit, F.col("pos")).otherwise(too_long)), keys, value)
    if bounded is None and (sizes.agg(F.max("n")).first()[0] or 0) <= limit:
        return _slopes_in_tasks(placed, keys, value)
    short = attach(placed, sizes.filter(F.col("n") <= limit).select(*keys, F.lit(1).alias("__s")), keys, "inner").drop("__s")
    long_sizes = sizes.filter(F.col("n") > limit)
    long = attach(placed, long_sizes.select(*keys, F.lit(1).alias("__s")), keys, "inner").drop("__s")
    return _slopes_in_tasks(short, keys, value).unionByName(_slopes_by_search(long, keys, value, long_sizes))


def positions(df: DataFrame, keys: list[str], value: str, order: list[str], bounded: bool | None = None) -> DataFrame:
    """(keys, pos, value) of the non-missing observations of each series in order."""
    return row_positions(_numbers(df, value), keys, [F.col(o).asc_nulls_last() for o in order], "pos", bounded).select(
        *keys, "pos", value
    )


def series_sizes(placed: DataFrame, keys: list[str]) -> DataFrame:
    return placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def mann_kendall(
    df: DataFrame, keys: list[str], value: str, order: list[str], bounded: bool | None = None
) -> DataFrame:
    """Monotone trend: S, Z (no tie correction), two-sided p and Sen's slope."""
    placed = positions(df, keys, value, order, bounded)
    sizes = series_sizes(placed, keys)
    s = rank_concordance(placed, keys, value, sizes, bounded)
    slopes = median_slopes(placed, keys, value, sizes, bounded)
    joined = attach(attach(sizes, s, keys, "left"), slopes, keys, "left")
    n, stat = F.col("n"), F.col("statistic_s")
    z = F.when(stat == 0, F.lit(0.0)).otherwise((stat - F.signum(stat)) / F.sqrt(n * (n - 1) * (2 * n + 5) / 18.0))
    enough = n >= MIN_TREND
    p = two_sided_p(z)
    return joined.select(
        *keys,
        n.alias("n_observations"),
        F.when(enough, stat).otherwise(F.lit(0).cast("bigint")).alias("statistic_s"),
        F.when(enough, z).otherwise(F.lit(0.0)).alias("z_score"),
        F.when(enough, p).otherwise(F.lit(1.0)).alias("p_value"),
        F.when(enough, F.col("sens_slope")).otherwise(F.lit(0.0)).alias("sens_slope"),
        F.when(~enough, INSUFFICIENT)
        .when(p >= ALPHA, NO_TREND)
        .when(stat > 0, UP)
        .otherwise(DOWN)
        .alias("trend_direction"),
        _decide(enough, p).alias("decision"),
    )


def dickey_fuller(df: DataFrame, keys: list[str], value: str, order: list[str], bounded: bool | None = None) -> DataFrame:
    """Lag-0 regression of the difference on the lagged level, from regression sums."""
    clean = _numbers(df, value)
    steps = add_difference(clean, value, keys, order, bounded)
    dy, y = f"{value}_diff", f"{value}_prev"
    fit = steps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_count(dy, y).alias("m"),
        F.regr_slope(dy, y).alias("slope"),
        F.regr_sxx(dy, y).alias("sxx"),
        F.regr_sxy(dy, y).alias("sxy"),
        F.regr_syy(dy, y).alias("syy"),
    )
    residual = F.greatest(F.col("syy") - F.col("sxy") * F.col("slope"), F.lit(0.0)) / F.col("m")
    error = F.sqrt(F.try_divide(residual, F.nullif(F.col("sxx"), F.lit(0.0))))
    t = safe_divide(F.col("slope"), error)
    enough = F.col("n") >= MIN_STATIONARITY
    return fit.select(
        *keys,
        F.col("n").alias("n_observations"),
        F.when(enough, t).alias("adf_statistic"),
        F.when(enough, 1.0 / (1.0 + F.exp(-2.0 * (t + ADF_CENTRE)))).alias("adf_pvalue"),
    )


def augmented_dickey_fuller(
    df: DataFrame, keys: list[str], value: str, order: list[str], bounded: bool | None = None, lags: int | None = None
) -> DataFrame:
    """Unit-root test whose number of lagged differences has the smallest AIC, with MacKinnon's p-value."""
    fit = unit_root(positions(df, keys, value, order, bounded), keys, value, lags)
    enough = F.col("n") >= MIN_STATIONARITY
    return fit.select(
        *keys,
        F.col("n").alias("n_observations"),
        F.when(enough, F.col("lags")).alias("adf_lags"),
        F.when(enough, F.col("t")).alias("adf_statistic"),
        F.when(enough, unit_root_p(F.col("t"))).alias("adf_pvalue"),
    )


def kpss(df: DataFrame, keys: list[str], value: str, order: list[str], bounded: bool | None = None) -> DataFrame:
    """Level-stationarity statistic; lag count after Hobijn, Franses & Ooms (1998)."""
    placed = positions(df, keys, value, order, bounded)
    stats = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("__mu"))
    resid = attach(placed, stats, keys, "inner").select(*keys, "n", "pos", (F.col(value) - F.col("__mu")).alias("e"))
    lagged_sums = lambda lag_table: lagged_products(resid, keys, "e", lag_table)
    n = F.col("n")
    base = resid.groupBy(*keys).agg(F.max("n").alias("n"), F.sum(F.col("e") * F.col("e")).alias("sse"))
    pilot = base.select(*keys, F.greatest(F.floor(F.pow(n, F.lit(2.0 / 9.0))), F.lit(1)).cast("int").alias("lags"))
    first = lagged_sums(pilot).groupBy(*keys).agg(F.sum("c").alias("__s0"), F.sum(F.col("j") * F.col("c")).alias("__s1"))
    # Hobijn et al.: s0 = var + 2 sum c_j / n, s1 = 2 sum j c_j / n.
    tuned = attach(base, first, keys, "left").withColumn(
        "__ratio", safe_divide(2.0 * F.col("__s1") / n, (F.col("sse") + 2.0 * F.col("__s0")) / n)
    )
    gamma = 1.1447 * F.pow(F.col("__ratio") * F.col("__ratio"), F.lit(1.0 / 3.0))
    lags = F.least(F.floor(gamma * F.pow(n, F.lit(1.0 / 3.0))).cast("int"), (n - 1).cast("int"))
    chosen = tuned.select(*keys, "n", "sse", F.coalesce(lags, F.lit(0)).alias("lags"))
    weights = attach(
        lagged_sums(chosen.filter("lags >= 1").select(*keys, "lags")), chosen.select(*keys, "lags"), keys, "inner"
    ).groupBy(*keys).agg(F.sum((1.0 - F.col("j") / (F.col("lags") + 1.0)) * F.col("c")).alias("__w"))
    long_run = attach(chosen, weights, keys, "left").select(
        *keys, "n", "lags", ((F.col("sse") + 2.0 * F.coalesce("__w", F.lit(0.0))) / n).alias("s2")
    )
    sums = running_total(resid, keys, [F.col("pos")], {"__before": F.col("e")}, bounded)
    eta = sums.groupBy(*keys).agg(F.sum(F.pow(F.col("__before") + F.col("e"), F.lit(2.0))).alias("eta"))
    stat = safe_divide(F.col("eta") / (n * n), F.col("s2"))
    p = F.lit(KPSS_POINTS[-1][1])
    for (x0, p0), (x1, p1) in reversed(list(zip(KPSS_POINTS, KPSS_POINTS[1:]))):
        p = F.when(stat < x1, p0 + (stat - x0) * ((p1 - p0) / (x1 - x0))).otherwise(p)
    p = F.when(stat <= KPSS_POINTS[0][0], F.lit(KPSS_POINTS[0][1])).otherwise(p)
    enough = n >= MIN_STATIONARITY
    return attach(long_run, eta, keys, "inner").select(
        *keys,
        n.alias("n_observations"),
        "lags",
        F.when(enough, stat).alias("kpss_statistic"),
        F.when(enough & stat.isNotNull(), p).alias("kpss_pvalue"),
    )


def stationarity(
    df: DataFrame,
    keys: list[str],
    value: str,
    order: list[str],
    with_kpss: bool = False,
    bounded: bool | None = None,
    lags: int | None = 0,
) -> DataFrame:
    """Unit-root test, optionally crossed with KPSS, and the combined status.

    ``lags=0`` regresses on the level alone; None or a larger number lets AIC choose among up to so many lagged differences
    (None: the usual bound for the length of the series) and adds their number as ``adf_lags``.
    """
    adf = dickey_fuller(df, keys, value, order, bounded) if lags == 0 else augmented_dickey_fuller(df, keys, value, order, bounded, lags)
    if with_kpss:
        adf = attach(adf, kpss(df, keys, value, order, bounded).drop("n_observations", "lags"), keys, "left")
    else:
        adf = adf.withColumns({c: F.lit(None).cast("double") for c in ("kpss_statistic", "kpss_pvalue")})
    enough = F.col("n_observations") >= MIN_STATIONARITY
    a = F.coalesce(F.col("adf_pvalue") < ALPHA, F.lit(False))
    k = F.coalesce(F.col("kpss_pvalue") >= ALPHA, F.lit(True))
    return adf.withColumns(
        {
            "status": F.when(~enough, INSUFFICIENT)
            .when(a & k, "ESTACIONARIA_ESTRICTA")
            .when(~a & ~k, "NO_ESTACIONARIA_INTEGRADA")
            .when(a & ~k, "ESTACIONARIA_CON_TENDENCIA")
            .otherwise("NO_CONCLUYENTE"),
            "decision": F.when(~enough, INSUFFICIENT).when(a, STATIONARY).otherwise(NOT_STATIONARY),
        }
    )


def group_differences(
    df: DataFrame, keys: list[str], value: str, group: str, alpha: float = ALPHA, bounded: bool | None = None
) -> DataFrame:
    """Kruskal-Wallis across the levels of ``group`` with at least three observations.

    Values collapse to (value, group) counts before ranking, so neither a hot group nor a
    hot value travels row by row, and ranks need no single-partition sort.
    """
    rows = _numbers(df, value).filter(F.col(group).isNotNull())
    cells = rows.groupBy(*keys, group, value).agg(F.count(F.lit(1)).alias("c"))
    kept = cells.groupBy(*keys, group).agg(F.sum("c").alias("n_g")).filter(F.col("n_g") >= MIN_GROUP)
    inside = attach(cells, kept, [*keys, group], "inner")
    per_value = inside.groupBy(*keys, value).agg(F.sum("c").alias("n_v"))
    before = running_total(per_value, keys, [F.col(value).asc()], {"__before": F.col("n_v")}, bounded)
    ranks = before.select(*keys, value, (F.col("__before") + (F.col("n_v") + 1) / 2.0).alias("__rank"))
    ranked = attach(inside, ranks, [*keys, value], "inner")
    sums = ranked.groupBy(*keys, group).agg(F.sum(F.col("c") * F.col("__rank")).alias("r"), F.max("n_g").alias("n_g"))
    total = sums.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_groups"), F.sum("n_g").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("n_g")).alias("q")
    )
    n = F.col("n")
    h = 12.0 / (n * (n + 1.0)) * F.col("q") - 3.0 * (n + 1.0)
    enough = F.col("n_groups") >= 2
    p = chi2_tail_normal(h, F.col("n_groups") - 1.0)
    return total.select(
        *keys,
        "n_groups",
        F.when(enough, h).alias("statistic"),
        F.when(enough, p).alias("p_value"),
        _decide(enough, p, alpha).alias("decision"),
    )


def _mart(df: DataFrame, test: str, stat: str, p: str) -> DataFrame:
    decision = F.col("decision")
    meaning = (
        F.when(decision == INSUFFICIENT, "Muestra insuficiente")
        .when(decision.isin(REJECT, STATIONARY), "Evidencia contra la hipótesis nula al 5 %")
        .otherwise("Sin evidencia contra la hipótesis nula al 5 %")
    )
    return df.select(
        "variable",
        F.lit(CATEGORIES[test]).alias("categoria_prueba"),
        F.lit(test).alias("prueba"),
        F.round(stat, 4).alias("estadistico"),
        F.round(p, 6).alias("p_valor"),
        decision.alias("decision"),
        meaning.alias("interpretacion"),
    )


def full_battery(
    df: DataFrame,
    columns: list[str],
    order: list[str],
    group: str | None = None,
    alpha: float = ALPHA,
    bounded: bool | None = None,
) -> DataFrame:
    """Long result table: one row per variable and test, from one unpivot of the input."""
    present = [c for c in columns if c in df.columns]
    have = dict(df.dtypes)
    extra = [group] if group and group in df.columns else []
    numbers = df.select(*order, *extra, *[to_double(F.col(c), have[c]).alias(c) for c in present])
    long = numbers.unpivot([*order, *extra], present, "variable", "value")
    keys = ["variable"]
    parts = [
        _mart(normality(long, keys, "value"), NORMALITY, "statistic", "p_value"),
        _mart(mann_kendall(long, keys, "value", order, bounded), TREND, "z_score", "p_value"),
        _mart(stationarity(long, keys, "value", order, bounded=bounded), STATIONARITY, "adf_statistic", "adf_pvalue"),
    ]
    if extra:
        parts.append(
            _mart(group_differences(long, keys, "value", group, alpha, bounded), GROUPS, "statistic", "p_value")
        )
    return reduce(DataFrame.unionByName, parts)


def kendall_tau(df: DataFrame, keys: list[str], x: str, y: str, bounded: bool | None = None) -> DataFrame:
    """Kendall's tau-b per series, through the concordance of y ordered by (x, y)."""
    have = dict(df.dtypes)
    both = df.select(*keys, to_double(F.col(x), have[x]).alias("__x"), to_double(F.col(y), have[y]).alias("__y")).dropna(
        subset=["__x", "__y"]
    )
    placed = row_positions(both, keys, [F.col("__x"), F.col("__y")], "pos", bounded)
    sizes = series_sizes(placed, keys)
    raw = rank_concordance(placed.select(*keys, "pos", "__y"), keys, "__y", sizes, bounded)
    pairs = lambda c: F.col(c) * (F.col(c) - 1) / 2.0
    cells = both.groupBy(*keys, "__x", "__y").agg(F.count(F.lit(1)).alias("c"))
    tied = lambda by, name: (
        (cells.groupBy(*keys, by).agg(F.sum("c").alias("c")) if by else cells).groupBy(*keys).agg(F.sum(pairs("c")).alias(name))
    )
    out = attach(attach(sizes, raw, keys, "left"), tied("__x", "tx"), keys, "left")
    out = attach(attach(out, tied("__y", "ty"), keys, "left"), tied(None, "txy"), keys, "left")
    # Pairs tied in x were ordered by y and counted as rising; take them out again.
    s = F.col("statistic_s") - (F.col("tx") - F.col("txy"))
    spread = F.sqrt((pairs("n") - F.col("tx")) * (pairs("n") - F.col("ty")))
    return out.select(*keys, F.col("n").alias("n_observations"), safe_divide(s, spread).alias("tau"))


def spearman(df: DataFrame, keys: list[str], x: str, y: str, bounded: bool | None = None) -> DataFrame:
    """Pearson correlation of average ranks, from distinct (x, y) cells."""
    cells = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, x, y).agg(F.count(F.lit(1)).alias("c"))

    def ranks(col: str, name: str) -> DataFrame:
        counted = cells.groupBy(*keys, col).agg(F.sum("c").alias("n"))
        before = running_total(counted, keys, [F.col(col).asc()], {"__before": F.col("n")}, bounded)
        return before.select(*keys, col, (F.col("__before") + (F.col("n") + 1) / 2.0).alias(name))

    both = attach(attach(cells, ranks(x, "rx"), [*keys, x], "inner"), ranks(y, "ry"), [*keys, y], "inner")
    c, rx, ry = F.col("c"), F.col("rx"), F.col("ry")
    # Average ranks always have mean (n + 1) / 2; centring first keeps the sums small.
    n = both.groupBy(*keys).agg(F.sum("c").alias("n_observations"))
    mid = (F.col("n_observations") + 1) / 2.0
    centred = attach(both, n, keys, "inner")
    sums = centred.groupBy(*keys).agg(
        F.max("n_observations").alias("n_observations"),
        F.sum(c * (rx - mid) * (ry - mid)).alias("sxy"),
        F.sum(c * (rx - mid) * (rx - mid)).alias("sxx"),
        F.sum(c * (ry - mid) * (ry - mid)).alias("syy"),
    )
    return sums.select(*keys, "n_observations", safe_divide(F.col("sxy"), F.sqrt(F.col("sxx") * F.col("syy"))).alias("rho"))
