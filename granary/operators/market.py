"""Market questions: size, growth, stability, concentration, gaps, relations and composites.

Every question has a parametric and a robust reading; ``question_mart`` stores both.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.nulls import attach, nan_is_missing, safe_divide, stage
from granary.functions.stats import chi2_tail, f_tail
from granary.operators.hypothesis import ALPHA, INSUFFICIENT, KEEP, REJECT, normality
from granary.operators.ordered import over_history, row_positions, running_total
from granary.operators.quantiles import exact_quantiles, median_and_mad, medians
from granary.session import cut_lineage, written


@nan_is_missing
def shares(df: DataFrame, keys: list[str], item: str, value: str) -> DataFrame:
    """Total per item and its share of the group; items are aggregated, and kept, before totals, so ``df`` is read once."""
    totals = written(df.groupBy(*keys, item).agg(F.sum(value).alias("total")), "shares")
    groups = totals.groupBy(*keys).agg(F.sum("total").alias("__all"))
    return attach(totals, groups, keys, "left").select(
        *keys, item, "total", safe_divide(F.col("total"), F.col("__all")).alias("share")
    )


@nan_is_missing
def growth_rate(df: DataFrame, keys: list[str], period: str, value: str, name: str = "cagr") -> DataFrame:
    """Compound growth per period between the first and the last period of each group."""
    ends = df.groupBy(*keys).agg(
        F.min_by(value, period).alias("first"),
        F.max_by(value, period).alias("last"),
        (F.max(period) - F.min(period)).alias("span"),
    )
    ratio = safe_divide(F.col("last"), F.col("first"))
    return ends.select(*keys, "span", F.when((F.col("span") > 0) & (ratio > 0), F.pow(ratio, 1.0 / F.col("span")) - 1.0).alias(name))


@nan_is_missing
def centre_and_spread(df: DataFrame, keys: list[str], value: str, bounded: bool | None = None) -> DataFrame:
    """Mean, median, coefficient of variation and IQR over median."""
    plain = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("__sd"))
    robust = exact_quantiles(df, keys, value, {"__q1": 0.25, "median": 0.5, "__q3": 0.75}, bounded)
    return attach(plain, robust, keys, "left").select(
        *keys,
        "mean",
        "median",
        safe_divide(F.col("__sd"), F.col("mean")).alias("cv"),
        safe_divide(F.col("__q3") - F.col("__q1"), F.col("median")).alias("iqr_over_median"),
    )


@nan_is_missing
def concentration(df: DataFrame, keys: list[str], item: str, value: str, k: int = 5, bounded: bool | None = None) -> DataFrame:
    """Herfindahl index, share of the k largest items and Gini coefficient per group."""
    cells = shares(df, keys, item, value)
    placed = row_positions(cells, keys, [F.col("total").asc(), F.col(item).asc()], "__pos", bounded)
    sizes = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.sum("total").alias("__all"))
    ranked = attach(placed, sizes, keys, "inner")
    n = F.col("__n")
    sums = ranked.groupBy(*keys).agg(
        F.max("__n").alias("items"),
        F.sum(F.col("share") * F.col("share")).alias("hhi"),
        F.sum(F.when(F.col("__pos") >= n - k, F.col("share")).otherwise(0.0)).alias("cr_k"),
        F.sum((F.col("__pos") + 1) * F.col("total")).alias("__weighted"),
        F.max("__all").alias("__all"),
    )
    items = F.col("items")
    gini = safe_divide(2.0 * F.col("__weighted"), items * F.col("__all")) - (items + 1) / items
    return sums.select(*keys, "items", "hhi", "cr_k", gini.alias("gini"))


@nan_is_missing
def lorenz(df: DataFrame, keys: list[str], item: str, value: str, bounded: bool | None = None) -> DataFrame:
    """Cumulative item and value shares, smallest items first."""
    cells = shares(df, keys, item, value)
    order = [F.col("total").asc(), F.col(item).asc()]
    walked = running_total(cells, keys, order, {"__v": F.col("share"), "__c": F.lit(1).cast("bigint")}, bounded)
    sizes = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return attach(walked, sizes, keys, "inner").select(
        *keys, item, ((F.col("__c") + 1) / F.col("__n")).alias("item_share"), (F.col("__v") + F.col("share")).alias("value_share")
    )


@nan_is_missing
def gap_rate(offer: DataFrame, supply: DataFrame, keys: list[str], offered: str, supplied: str) -> DataFrame:
    """(offer - supply) / offer on the keys of the offer."""
    joined = attach(offer, supply, keys, "left")
    return joined.withColumn("gap", safe_divide(F.col(offered) - F.coalesce(supplied, F.lit(0.0)), F.col(offered)))


@nan_is_missing
def autocorrelation(df: DataFrame, keys: list[str], order: list[str], value: str, lag: int = 1, bounded: bool | None = None) -> DataFrame:
    """Pearson correlation of a series with itself ``lag`` rows earlier."""
    sort = [F.col(o) for o in order]
    pairs = over_history(df, keys, sort, lag, lambda w: {"__back": F.lag(value, lag).over(w)}, bounded)
    return pearson(pairs, keys, value, "__back", f"r_{lag}")


@nan_is_missing
def pearson(df: DataFrame, keys: list[str], x: str, y: str, name: str = "r") -> DataFrame:
    """Correlation over complete pairs; NULL without variation."""
    return df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(F.nanvl(F.corr(x, y), F.lit(None).cast("double")).alias(name))


@nan_is_missing
def lagged_pearson(df: DataFrame, keys: list[str], order: list[str], x: str, y: str, lag: int, bounded: bool | None = None) -> DataFrame:
    """Correlation of ``x`` with ``y`` ``lag`` rows earlier."""
    sort = [F.col(o) for o in order]
    pairs = over_history(df, keys, sort, lag, lambda w: {"__back": F.lag(y, lag).over(w)}, bounded)
    return pearson(pairs, keys, x, "__back", f"r_lag_{lag}")


@nan_is_missing
def line_slope(df: DataFrame, keys: list[str], x: str, y: str, name: str = "slope") -> DataFrame:
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias(name))


@nan_is_missing
def elasticity(df: DataFrame, keys: list[str], quantity: str, price: str) -> DataFrame:
    """Slope of ln(price) on ln(quantity) over positive pairs."""
    positive = df.filter((F.col(quantity) > 0) & (F.col(price) > 0))
    return positive.groupBy(*keys).agg(F.regr_slope(F.log(price), F.log(quantity)).alias("elasticity"), F.count(F.lit(1)).alias("pairs"))


@nan_is_missing
def seasonal_profile(df: DataFrame, keys: list[str], date: str, value: str, bounded: bool | None = None) -> DataFrame:
    """Mean and median per calendar month and the mean's ratio to the overall mean."""
    dated = df.withColumn("mes_num", F.month(date))
    per_month = dated.groupBy(*keys, "mes_num").agg(F.avg(value).alias("mean"))
    middle = medians(dated, [*keys, "mes_num"], value, "median", bounded)
    overall = df.groupBy(*keys).agg(F.avg(value).alias("__all"))
    out = attach(attach(per_month, middle, [*keys, "mes_num"], "left"), overall, keys, "left")
    return out.select(*keys, "mes_num", "mean", "median", safe_divide(F.col("mean"), F.col("__all")).alias("seasonal_index"))


def peak_months(profile: DataFrame, keys: list[str]) -> DataFrame:
    """Month with the highest mean and with the highest median; the earlier one on ties."""
    best = lambda c: F.max_by("mes_num", F.struct(F.col(c), -F.col("mes_num")))
    return profile.groupBy(*keys).agg(best("mean").alias("peak_mean"), best("median").alias("peak_median"))


@nan_is_missing
def value_ratio(df: DataFrame, keys: list[str], value: str, amount: str, bounded: bool | None = None) -> DataFrame:
    """Ratio of sums and ratio of medians."""
    plain = df.groupBy(*keys).agg(F.sum(value).alias("__v"), F.sum(amount).alias("__a"))
    joined = attach(attach(plain, medians(df, keys, value, "__mv", bounded), keys, "left"), medians(df, keys, amount, "__ma", bounded), keys, "left")
    return joined.select(
        *keys,
        safe_divide(F.col("__v"), F.col("__a")).alias("ratio_sums"),
        safe_divide(F.col("__mv"), F.col("__ma")).alias("ratio_medians"),
    )


@nan_is_missing
def composite_score(df: DataFrame, item: str, weights: dict[str, float], bounded: bool | None = None) -> DataFrame:
    """Weighted z-score and weighted percentile rank over items (one row per item).

    Ranks come back by a join on the values, and a floating sum that is computed again may differ in its last digit, so
    the items are fixed first.
    """
    df = cut_lineage(df.select(item, *weights))
    stats = df.agg(*[f(c).alias(f"__{t}_{c}") for c in weights for f, t in ((F.avg, "mu"), (F.stddev_samp, "sd"))], F.count(F.lit(1)).alias("__n"))
    out = df.join(stats, on=F.lit(True), how="left")
    for c in weights:
        counted = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("__k"))
        below = running_total(counted, [], [F.col(c).asc()], {f"__below_{c}": F.col("__k")}, bounded).drop("__k")
        out = attach(out, below, [c], "left")
    z = sum(w * F.coalesce(safe_divide(F.col(c) - F.col(f"__mu_{c}"), F.col(f"__sd_{c}")), F.lit(0.0)) for c, w in weights.items())
    rank = sum(w * F.coalesce(safe_divide(F.col(f"__below_{c}"), F.col("__n") - 1.0), F.lit(0.0)) for c, w in weights.items())
    return out.select(item, z.alias("z_score"), rank.alias("percentile_score"))


# Layout of the mart and the skewness beyond which the robust engine is chosen.
SKEW_LIMIT = 1.0
PARAMETRIC, ROBUST = "PARAMETRICO", "ROBUSTO"


@nan_is_missing
def dual_answer(question: str, title: str, unit: str, plain: DataFrame, robust: DataFrame) -> DataFrame:
    """One mart row from two one-value frames."""
    p, q = plain.toDF("metrica_parametrica"), robust.toDF("metrica_no_parametrica")
    return p.join(q, on=F.lit(True), how="left").select(
        F.lit(question).alias("pregunta_id"), F.lit(title).alias("titulo"), F.lit(unit).alias("unidad"), "metrica_parametrica", "metrica_no_parametrica"
    )


@nan_is_missing
def question_mart(answers: list[DataFrame], sample: DataFrame, value: str) -> DataFrame:
    """Answers plus the engine to prefer: robust when the sample is skewed or not normal."""
    shape = normality(sample, [], value).select(
        F.when(F.col("alpha_05_rejected") | (F.abs("skewness") > SKEW_LIMIT), ROBUST).otherwise(PARAMETRIC).alias("motor")
    )
    rows = reduce(DataFrame.unionByName, answers).join(shape, on=F.lit(True), how="left")
    chosen = F.when(F.col("motor") == ROBUST, F.col("metrica_no_parametrica")).otherwise(F.col("metrica_parametrica"))
    return rows.withColumn("metrica_elegida", chosen)


@nan_is_missing
def monthly_harmonised(df: DataFrame, keys: list[str], date: str, price: str, volume: str, bounded: bool | None = None) -> DataFrame:
    """Daily rows to months: median price, summed volume."""
    dated = df.withColumn("mes", F.trunc(F.col(date).cast("date"), "MM"))
    volumes = dated.groupBy(*keys, "mes").agg(F.sum(volume).alias("volumen"))
    return attach(volumes, medians(dated, [*keys, "mes"], price, "precio_mediano", bounded), [*keys, "mes"], "left")


@nan_is_missing
def forecast_errors(df: DataFrame, keys: list[str], actual: str, predicted: str, parameters: int = 1) -> DataFrame:
    """WAPE, RMSE and adjusted R squared from one aggregate."""
    e = F.col(actual) - F.col(predicted)
    sums = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.abs(e)).alias("__abs"),
        F.sum(actual).alias("__y"),
        F.sum(e * e).alias("__sse"),
        F.var_pop(actual).alias("__var"),
    )
    n = F.col("n")
    r2 = 1.0 - safe_divide(F.col("__sse"), F.col("__var") * n)
    return sums.select(
        *keys,
        safe_divide(F.col("__abs"), F.col("__y")).alias("wape"),
        F.sqrt(F.col("__sse") / n).alias("rmse"),
        (1.0 - (1.0 - r2) * safe_divide(n - 1.0, n - 1.0 - parameters)).alias("r2_adj"),
    )


@nan_is_missing
def ljung_box(df: DataFrame, keys: list[str], order: list[str], value: str, lags: int = 5, bounded: bool | None = None) -> DataFrame:
    """Q statistic over the first ``lags`` autocorrelations, its p-value and the decision."""
    mu = df.groupBy(*keys).agg(F.avg(value).alias("__mu"))
    centred = attach(df.filter(F.col(value).isNotNull()), mu, keys, "inner").withColumn("__e", F.col(value) - F.col("__mu"))
    sort = [F.col(o) for o in order]
    back = over_history(centred, keys, sort, lags, lambda w: {f"__b{k}": F.lag("__e", k).over(w) for k in range(1, lags + 1)}, bounded)
    sums = back.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("__e") * F.col("__e")).alias("__c0"), *[F.sum(F.col("__e") * F.col(f"__b{k}")).alias(f"__c{k}") for k in range(1, lags + 1)]
    )
    n = F.col("n")
    rho2 = sum(F.pow(safe_divide(F.col(f"__c{k}"), F.col("__c0")), F.lit(2.0)) / (n - k) for k in range(1, lags + 1))
    q = sums.select(*keys, (n * (n + 2) * rho2).alias("ljung_box_q"))
    return _judged(q, chi2_tail(F.col("ljung_box_q"), F.lit(float(lags))))


@nan_is_missing
def levene(df: DataFrame, keys: list[str], value: str, group: str, bounded: bool | None = None) -> DataFrame:
    """Median-centred Levene statistic (analysis of variance of absolute deviations), its p-value and the decision."""
    rows = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull())
    centre = medians(rows, [*keys, group], value, "__med", bounded)
    dev = attach(rows, centre, [*keys, group], "inner").withColumn("__z", F.abs(F.col(value) - F.col("__med")))
    per = dev.groupBy(*keys, group).agg(F.count(F.lit(1)).alias("__n"), F.avg("__z").alias("__m"), F.var_pop("__z").alias("__v"))
    total = per.groupBy(*keys).agg(
        F.sum("__n").alias("n"), F.count(F.lit(1)).alias("k"), (F.sum(F.col("__n") * F.col("__m")) / F.sum("__n")).alias("__grand")
    )
    parts = attach(per, total, keys, "inner").groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.max("k").alias("k"),
        F.sum(F.col("__n") * F.pow(F.col("__m") - F.col("__grand"), F.lit(2.0))).alias("__between"),
        F.sum(F.col("__n") * F.col("__v")).alias("__within"),
    )
    w = safe_divide((F.col("n") - F.col("k")) * F.col("__between"), (F.col("k") - 1.0) * F.col("__within"))
    tested = parts.select(*keys, F.col("k").alias("n_groups"), w.alias("levene_w"), (F.col("k") - 1.0).alias("__above"), (F.col("n") - F.col("k")).alias("__below"))
    return _judged(tested, f_tail(F.col("levene_w"), F.col("__above"), F.col("__below"))).drop("__above", "__below")


@nan_is_missing
def granger(df: DataFrame, keys: list[str], order: list[str], cause: str, effect: str, bounded: bool | None = None) -> DataFrame:
    """One-lag F statistic, its p-value and the decision: does the cause's last value help to predict the effect?

    Residual sums of squares of both regressions follow from centred moments.
    """
    sort = [F.col(o) for o in order]
    lagged = over_history(df, keys, sort, 1, lambda w: {"__y1": F.lag(effect).over(w), "__x1": F.lag(cause).over(w)}, bounded)
    full = lagged.filter(F.col("__y1").isNotNull() & F.col("__x1").isNotNull() & F.col(effect).isNotNull())
    s = lambda a, b: F.covar_pop(a, b) * F.count(F.lit(1))
    m = full.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("t"),
        s(effect, effect).alias("yy"), s("__y1", "__y1").alias("aa"), s("__x1", "__x1").alias("bb"),
        s("__y1", "__x1").alias("ab"), s("__y1", effect).alias("ay"), s("__x1", effect).alias("by"),
    )
    c = F.col
    restricted = c("yy") - safe_divide(c("ay") * c("ay"), c("aa"))
    det = c("aa") * c("bb") - c("ab") * c("ab")
    explained = safe_divide(c("ay") * c("ay") * c("bb") - 2.0 * c("ay") * c("by") * c("ab") + c("by") * c("by") * c("aa"), det)
    free = c("yy") - explained
    f = safe_divide(restricted - free, free) * (c("t") - 3.0)
    tested = m.select(*keys, c("t").alias("n"), f.alias("granger_f"))
    return _judged(tested, f_tail(F.col("granger_f"), F.lit(1.0), F.col("n") - 3.0))


def _judged(df: DataFrame, p: Column) -> DataFrame:
    """Adds the p-value and whether it rejects at the usual level."""
    judged = stage(df, {"p_valor": p})
    return judged.withColumn("decision", F.when(F.col("p_valor").isNull(), INSUFFICIENT).when(F.col("p_valor") < ALPHA, REJECT).otherwise(KEEP))


@nan_is_missing
def benjamini_hochberg(df: DataFrame, p: str, ties: list[str], q: float = 0.05, keys: list[str] = (), bounded: bool | None = None) -> DataFrame:
    """Adjusted p-values and rejections; the running minimum starts at the largest p.

    The step-up rule only needs, for each p, the smallest p_j * m / j with p_j >= p. Tied
    p-values share the largest rank, so distinct values suffice and the minimum runs over
    slices of distinct values rather than raw rows.
    """
    keys = list(keys)
    counted = df.filter(F.col(p).isNotNull()).groupBy(*keys, p).agg(F.count(F.lit(1)).alias("__c"))
    ranked = running_total(counted, keys, [F.col(p).asc()], {"__before": F.col("__c")}, bounded)
    sizes = counted.groupBy(*keys).agg(F.sum("__c").alias("__m"))
    raw = attach(ranked, sizes, keys, "inner").withColumn("__raw", F.col(p) * F.col("__m") / (F.col("__before") + F.col("__c")))
    smallest = running_minimum(raw, keys, [F.col(p).desc()], "__raw", "p_ajustado", bounded)
    adjusted = smallest.select(*keys, p, F.least(F.lit(1.0), "p_ajustado").alias("p_ajustado"))
    return attach(df, adjusted, [*keys, p], "left").withColumn("rechaza_fdr", F.col("p_ajustado") <= q)


@nan_is_missing
def running_minimum(df: DataFrame, keys: list[str], order: list[Column], value: str, name: str, bounded: bool | None = None) -> DataFrame:
    """Minimum of all rows so far, in the given order, for groups of any size."""
    from pyspark.sql import Window

    from granary.functions.nulls import same_keys
    from granary.operators.ordered import fits

    if fits(df, keys, bounded):
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, F.min(value).over(w))
    ranged = cut_lineage(df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("__slice", F.spark_partition_id()))
    earlier = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranged.groupBy("__slice", *keys).agg(F.min(value).alias("__min")).select("__slice", *keys, F.min("__min").over(earlier).alias("__carry"))
    joined = ranged.alias("l").join(carried.alias("r"), same_keys("l", "r", ["__slice", *keys]), "left").select("l.*", "r.__carry")
    w = Window.partitionBy("__slice", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn(name, F.least(F.min(value).over(w), "__carry")).drop("__slice", "__carry")


@nan_is_missing
def control_alerts(df: DataFrame, keys: list[str], value: str, width: float = 3.0, bounded: bool | None = None) -> DataFrame:
    """Red outside both limits, yellow outside one, green otherwise."""
    plain = df.groupBy(*keys).agg(F.avg(value).alias("__mu"), F.stddev_samp(value).alias("__sd"))
    limits = attach(plain, median_and_mad(df, keys, value, bounded), keys, "left")
    joined = attach(df, limits, keys, "left")
    sigma = F.coalesce(F.abs(F.col(value) - F.col("__mu")) > width * F.col("__sd"), F.lit(False))
    mad = F.coalesce(F.abs(F.col(value) - F.col("median")) > width * F.col("mad"), F.lit(False))
    level = F.when(sigma & mad, "ROJO").when(sigma | mad, "AMARILLO").otherwise("VERDE")
    return joined.withColumn("alerta", level).drop("__mu", "__sd", "median", "mad")
