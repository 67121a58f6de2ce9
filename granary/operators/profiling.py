"""Column profiles, calendar coverage and categorical summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.casting import to_day, to_double
from granary.functions.nulls import attach, fold_nan, nan_is_missing, numeric_columns
from granary.operators.quantiles import exact_quantiles
from granary.session import written

# Quantiles of a profile and the Tukey fence factor.
PROFILE_QUANTILES = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
FENCE = 1.5
#: Up to so many groups, quartiles are sent to the values.
FEW_GROUPS = 10_000
MISSING_LIST_LIMIT = 50


def column_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """One row per column: null count and share, distinct count, cardinality ratio."""
    df = fold_nan(df)
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    aggregates = [F.count(F.lit(1)).alias("__n")]
    for c in df.columns:
        aggregates += [F.count(c).alias(f"{c}__present"), distinct(F.col(c)).alias(f"{c}__distinct")]
    wide = df.agg(*aggregates)
    entries = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.lit(t).alias("dtype"),
                (F.col("__n") - F.col(f"{c}__present")).alias("null_count"),
                F.col(f"{c}__distinct").alias("unique_count"),
            )
            for c, t in df.dtypes
        ]
    )
    rows = wide.select("__n", F.explode(entries).alias("e")).select("__n", "e.*")
    n = F.nullif(F.col("__n"), F.lit(0))
    return rows.select(
        "column",
        "dtype",
        F.col("__n").alias("total_rows"),
        "null_count",
        F.coalesce(F.round(F.try_divide(F.col("null_count") * 100.0, n), 2), F.lit(0.0)).alias("null_percentage"),
        "unique_count",
        F.coalesce(F.round(F.try_divide(F.col("unique_count") * 1.0, n), 4), F.lit(0.0)).alias("cardinality_ratio"),
    )


def melt_numbers(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, value) rows of the numeric columns, missing values left out."""
    chosen = columns or numeric_columns(df)
    have = dict(df.dtypes)
    numbers = df.select(*[to_double(F.col(c), have[c]).alias(c) for c in chosen])
    return numbers.unpivot([], chosen, "column", "value").filter(F.col("value").isNotNull())


@nan_is_missing
def numeric_profile(
    df: DataFrame, columns: list[str] | None = None, approximate: bool = False, bounded: bool | None = None
) -> DataFrame:
    """Moments, quantiles and the number of values outside the Tukey fences."""
    long = melt_numbers(df, columns)
    moments = long.groupBy("column").agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    if approximate:
        packed = F.percentile_approx("value", [float(p) for p in PROFILE_QUANTILES.values()], 10000)
        quantiles = long.groupBy("column").agg(packed.alias("q")).select(
            "column", *[F.col("q")[i].alias(n) for i, n in enumerate(PROFILE_QUANTILES)]
        )
    else:
        quantiles = exact_quantiles(long, ["column"], "value", PROFILE_QUANTILES, bounded)
    # A row per column; read twice below.
    stats = written(attach(moments, quantiles, ["column"], "inner").withColumn("iqr", F.col("p75") - F.col("p25")), "profile")
    outliers = outside_fences(long, stats.select("column", "p25", "p75"), ["column"], "value")
    joined = attach(stats, outliers, ["column"], "left")
    shown = ["mean", "std", "median", "min", "max", "p01", "p05", "p25", "p75", "p95", "p99", "iqr"]
    return joined.select("column", *[F.round(c, 4).alias(c) for c in shown], "outliers_iqr_count")


@nan_is_missing
def outside_fences(
    long: DataFrame, quartiles: DataFrame, keys: list[str], value: str, factor: float = FENCE
) -> DataFrame:
    """Values strictly beyond p25 - k*iqr or p75 + k*iqr, counted per key.

    Few groups go to the values, as a join on few keys would bring all values of a key to one task.
    """
    quartiles = written(quartiles.select(*keys, "p25", "p75"), "quartiles")
    if quartiles.count() <= FEW_GROUPS:
        quartiles = F.broadcast(quartiles)
    width = F.col("p75") - F.col("p25")
    outside = (F.col(value) < F.col("p25") - factor * width) | (F.col(value) > F.col("p75") + factor * width)
    return attach(long, quartiles, keys, "inner").groupBy(*keys).agg(F.count_if(outside).alias("outliers_iqr_count"))


# Calendar units by frequency code: (truncation unit, months per step).
FREQUENCIES = {"MS": ("MM", 1), "QS": ("QUARTER", 3), "YS": ("YEAR", 12)}


def _period(date: Column, freq: str) -> Column:
    return F.trunc(date, FREQUENCIES[freq][0])


def _expected_bounds(days: DataFrame, freq: str) -> DataFrame:
    """First and last period whose start lies between the first and last observation."""
    unit_months = FREQUENCIES[freq][1]
    edges = days.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    start = _period(F.col("lo"), freq)
    first = F.when(start == F.col("lo"), start).otherwise(F.add_months(start, unit_months))
    return edges.select("lo", "hi", first.alias("first"), _period(F.col("hi"), freq).alias("last"))


def _days(df: DataFrame, date: str, extra: list[str] = ()) -> DataFrame:
    return df.select(to_day(F.col(date)).alias("day"), *extra).filter(F.col("day").isNotNull())


def expected_periods(df: DataFrame, date: str, freq: str = "MS") -> DataFrame:
    """Every calendar period from the first full one to the last observation."""
    step = F.make_interval(months=F.lit(FREQUENCIES[freq][1]))
    bounds = _expected_bounds(_days(df, date), freq).filter(F.col("first") <= F.col("last"))
    return bounds.select(F.explode(F.sequence("first", "last", step)).alias("period"))


def actual_periods(df: DataFrame, date: str, freq: str = "MS") -> DataFrame:
    return _days(df, date).select(_period(F.col("day"), freq).alias("period")).distinct()


def missing_periods(df: DataFrame, date: str, freq: str = "MS") -> DataFrame:
    return expected_periods(df, date, freq).join(actual_periods(df, date, freq), "period", "left_anti")


def first_missing(df: DataFrame, date: str, freq: str = "MS", limit: int = MISSING_LIST_LIMIT) -> DataFrame:
    return missing_periods(df, date, freq).orderBy("period").limit(limit)


def temporal_coverage(df: DataFrame, date: str, freq: str = "MS") -> DataFrame:
    """One row: range, expected, actual and missing period counts, gap flag."""
    edges = _days(df, date).agg(
        F.min("day").alias("earliest_date"),
        F.max("day").alias("latest_date"),
        F.count_distinct(_period(F.col("day"), freq)).alias("actual_periods_count"),
    )
    expected = expected_periods(df, date, freq).agg(F.count(F.lit(1)).alias("expected_periods_count"))
    missing = missing_periods(df, date, freq).agg(F.count(F.lit(1)).alias("missing_periods_count"))
    # Three one-row frames side by side.
    return (
        edges.join(expected, how="left", on=F.lit(True))
        .join(missing, how="left", on=F.lit(True))
        .withColumn("has_gaps", F.col("missing_periods_count") > 0)
    )


def gaps_by_group(df: DataFrame, date: str, group: str, freq: str = "MS") -> DataFrame:
    """Groups that miss periods of the overall range, with the number missed.

    Counting a group's distinct expected periods avoids pairing groups with periods.
    """
    days = _days(df.filter(F.col(group).isNotNull()), date, [group])
    overall = _days(df, date)
    bounds = _expected_bounds(overall, freq).select("first", "last")
    months = F.months_between(F.col("last"), F.col("first")) / FREQUENCIES[freq][1] + 1
    seen = days.select(F.col(group).cast("string").alias("group"), _period(F.col("day"), freq).alias("period")).distinct()
    inside = seen.join(bounds, on=F.col("period").between(F.col("first"), F.col("last")), how="inner")
    # Groups seen only before the first full period miss every expected one.
    hits = inside.groupBy("group").agg(F.count(F.lit(1)).alias("__hit"))
    groups = attach(seen.select("group").distinct(), hits, ["group"], "left")
    total = bounds.select(F.greatest(F.round(months).cast("bigint"), F.lit(0)).alias("__all"))
    counted = groups.join(total, how="left", on=F.lit(True))
    return counted.select(
        "group", (F.col("__all") - F.coalesce(F.col("__hit"), F.lit(0))).alias("missing_periods")
    ).filter("missing_periods > 0")


def category_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct count and modal category per column; NULL counts as the text ``None``."""
    present = [c for c in columns if c in df.columns]
    text = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("None")).alias(c) for c in present])
    counts = text.unpivot([], present, "columna", "categoria").groupBy("columna", "categoria").agg(
        F.count(F.lit(1)).alias("n")
    )
    # Ordering by (count, smallest text) inside max_by keeps one candidate per task.
    top = counts.groupBy("columna").agg(
        F.count(F.lit(1)).alias("cardinalidad_unica"),
        F.max("n").alias("frecuencia_dominante"),
        F.sum("n").alias("__total"),
    )
    leaders = attach(counts, top.select("columna", "frecuencia_dominante"), ["columna"], "inner").filter(
        "n = frecuencia_dominante"
    )
    modal = leaders.groupBy("columna").agg(F.min("categoria").alias("categoria_dominante"))
    return attach(top, modal, ["columna"], "left").select(
        "columna",
        "cardinalidad_unica",
        "categoria_dominante",
        "frecuencia_dominante",
        F.round(F.col("frecuencia_dominante") * 100.0 / F.col("__total"), 2).alias("porcentaje_dominante"),
    )


@nan_is_missing
def group_mean(df: DataFrame, group: str, value: str, name: str = "mean") -> DataFrame:
    """Mean per group, lowest first; NULL groups are left out."""
    return (
        df.filter(F.col(group).isNotNull())
        .groupBy(group)
        .agg(F.avg(value).alias(name))
        .orderBy(F.col(name).asc_nulls_last(), group)
    )


def layer_counts(layers: dict[str, DataFrame]) -> DataFrame:
    rows = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("layer"), "rows") for n, df in layers.items()]
    return reduce(DataFrame.unionByName, rows)


def label_counts(df: DataFrame, label: Column, name: str = "label") -> DataFrame:
    return df.groupBy(label.alias(name)).agg(F.count(F.lit(1)).alias("n"))


@nan_is_missing
def month_climatology(df: DataFrame, keys: list[str], date: str, value: str) -> DataFrame:
    """Mean and sample deviation per series and calendar month."""
    return (
        df.filter(F.col(date).isNotNull())
        .groupBy(*keys, F.month(date).alias("mes"))
        .agg(F.avg(value).alias("media"), F.stddev_samp(value).alias("desv"))
    )
