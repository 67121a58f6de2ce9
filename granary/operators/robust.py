"""Outlier scores, winsorising, robust scaling and flagged imputation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.nulls import attach, nan_is_missing, safe_divide
from granary.operators.ordered import fits, running_total
from granary.operators.quantiles import exact_quantiles, median_and_mad

# Scale of the modified z-score, its alert level and the drift limit.
MAD_SCALE, MAD_ALERT, DRIFT_LIMIT = 0.6745, 3.5, 0.10


@nan_is_missing
def modified_z(df: DataFrame, keys: list[str], value: str, bounded: bool | None = None) -> DataFrame:
    """0.6745 |x - median| / MAD and an alert beyond 3.5."""
    joined = attach(df, median_and_mad(df, keys, value, bounded), keys, "left")
    score = MAD_SCALE * safe_divide(F.abs(F.col(value) - F.col("median")), F.col("mad"))
    return joined.withColumn("z_mad", score).withColumn("alerta_mad", F.coalesce(F.col("z_mad") > MAD_ALERT, F.lit(False))).drop("median", "mad")


@nan_is_missing
def winsorise(df: DataFrame, keys: list[str], value: str, low: float = 0.01, high: float = 0.99, bounded: bool | None = None) -> DataFrame:
    """Values pulled in to the chosen quantiles of their group."""
    limits = exact_quantiles(df, keys, value, {"__lo": low, "__hi": high}, bounded)
    inside = F.when(F.col(value).isNotNull(), F.greatest("__lo", F.least("__hi", value)))
    return attach(df, limits, keys, "left").withColumn(f"{value}_wins", inside).drop("__lo", "__hi")


@nan_is_missing
def robust_scale(df: DataFrame, keys: list[str], value: str, bounded: bool | None = None) -> DataFrame:
    """(x - median) / IQR; NULL without spread."""
    limits = exact_quantiles(df, keys, value, {"__q1": 0.25, "__q2": 0.5, "__q3": 0.75}, bounded)
    scaled = safe_divide(F.col(value) - F.col("__q2"), F.col("__q3") - F.col("__q1"))
    return attach(df, limits, keys, "left").withColumn(f"{value}_robust", scaled).drop("__q1", "__q2", "__q3")


def _flagged(df: DataFrame, value: str, filled, method: str) -> DataFrame:
    gap = F.col(value).isNull() & filled.isNotNull()
    return df.withColumns(
        {
            f"{value}_is_imputed": gap,
            f"{value}_impute_algo": F.when(gap, method).otherwise("ORIGINAL"),
            value: F.coalesce(F.col(value), filled),
        }
    )


@nan_is_missing
def impute_zero(df: DataFrame, value: str) -> DataFrame:
    return _flagged(df, value, F.lit(0.0), "ZERO_FILL")


@nan_is_missing
def impute_mode(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Most frequent value of the group, the smallest on ties."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    top = counts.groupBy(*keys).agg(F.max("__c").alias("__top"))
    leaders = attach(counts, top, keys, "inner").filter("__c = __top").groupBy(*keys).agg(F.min(value).alias("__mode"))
    return _flagged(attach(df, leaders, keys, "left"), value, F.col("__mode"), "MODE").drop("__mode")


@nan_is_missing
def interpolate(df: DataFrame, keys: list[str], position: str, value: str, bounded: bool | None = None) -> DataFrame:
    """Linear fill between the nearest known neighbours of a numeric position; ends stay open.

    Beyond the group limit known rows are numbered by a running count, and a gap joins
    the known rows just before and just after it.
    """
    order = [F.col(position).asc()]
    known = F.col(value).isNotNull()
    point = F.when(known, F.struct(F.col(position).alias("x"), F.col(value).alias("y")))
    if fits(df, keys, bounded):
        w = Window.partitionBy(*keys).orderBy(position)
        back = F.last(point, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        ahead = F.first(point, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
        placed = df.withColumns({"__a": back, "__b": ahead})
    else:
        seen = running_total(df, keys, order, {"__n": known.cast("bigint")}, bounded=False)
        seen = seen.withColumn("__k", F.col("__n") + known.cast("bigint"))
        points = seen.filter(known).select(*keys, F.col("__k").alias("__at"), point.alias("__p"))
        before = points.select(*keys, F.col("__at").alias("__k"), F.col("__p").alias("__a"))
        after = points.select(*keys, (F.col("__at") - 1).alias("__n"), F.col("__p").alias("__b"))
        placed = attach(attach(seen, before, [*keys, "__k"], "left"), after, [*keys, "__n"], "left").drop("__n", "__k")
    a, b = F.col("__a"), F.col("__b")
    line = a["y"] + (b["y"] - a["y"]) * safe_divide((F.col(position) - a["x"]).cast("double"), (b["x"] - a["x"]).cast("double"))
    return _flagged(placed, value, line, "LINEAR").drop("__a", "__b")


@nan_is_missing
def drift_check(original: DataFrame, imputed: DataFrame, value: str) -> DataFrame:
    """Relative change of the standard deviation and whether it stays below the limit."""
    before = original.agg(F.stddev_samp(value).alias("sd_original"))
    after = imputed.agg(F.stddev_samp(value).alias("sd_imputado"))
    drift = F.abs(safe_divide(F.col("sd_imputado") - F.col("sd_original"), F.col("sd_original")))
    return before.join(after, on=F.lit(True), how="left").withColumn("deriva", drift).withColumn("aceptable", F.col("deriva") < DRIFT_LIMIT)
