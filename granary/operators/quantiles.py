"""Exact interpolated quantiles for groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.nulls import attach, nan_is_missing
from granary.operators.ordered import fits, running_total


@nan_is_missing
def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float], bounded: bool | None = None
) -> DataFrame:
    """One row per group with a linearly interpolated quantile for each name.

    ``percentile`` keeps every distinct value of a group in one task's memory; beyond
    the group limit the order statistics are looked up in a running count instead.
    """
    present = df.filter(F.col(value).isNotNull())
    names = list(probs)
    if fits(present, keys, bounded):
        # One aggregate function for all probabilities: a single value map per group.
        packed = F.percentile(value, F.array(*[F.lit(float(probs[n])) for n in names]))
        grouped = present.groupBy(*keys).agg(packed.alias("__q"))
        return grouped.select(*keys, *[F.col("__q")[i].alias(n) for i, n in enumerate(names)])

    counted = present.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    before = running_total(counted, keys, [F.col(value).asc()], {"__before": F.col("__n")}, bounded=False)
    sizes = counted.groupBy(*keys).agg(F.sum("__n").alias("__size"))
    placed = attach(before, sizes, keys, "inner")
    aggregates = []
    for i, n in enumerate(names):
        rank = F.lit(float(probs[n])) * (F.col("__size") - 1)
        for side, at in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
            here = (F.col("__before") <= at) & (at < F.col("__before") + F.col("__n"))
            aggregates.append(F.max(F.when(here, F.col(value).cast("double"))).alias(f"__{side}{i}"))
    picked = placed.groupBy(*keys).agg(F.max("__size").alias("__size"), *aggregates)
    out = []
    for i, n in enumerate(names):
        rank = F.lit(float(probs[n])) * (F.col("__size") - 1)
        lo, hi = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        out.append((lo + (hi - lo) * (rank - F.floor(rank))).alias(n))
    return picked.select(*keys, *out)


@nan_is_missing
def medians(df: DataFrame, keys: list[str], value: str, name: str, bounded: bool | None = None) -> DataFrame:
    return exact_quantiles(df, keys, value, {name: 0.5}, bounded)


@nan_is_missing
def median_and_mad(
    df: DataFrame, keys: list[str], value: str, bounded: bool | None = None
) -> DataFrame:
    """Per group: ``median`` and the median absolute deviation ``mad``."""
    centre = medians(df, keys, value, "median", bounded)
    away = attach(df, centre, keys, "inner").withColumn("__dev", F.abs(F.col(value) - F.col("median")))
    spread = medians(away, keys, "__dev", "mad", bounded)
    return attach(centre, spread, keys, "left")
