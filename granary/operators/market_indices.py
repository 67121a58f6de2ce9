"""Price change, terms of trade and base-100 indices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.nulls import attach, nan_is_missing, safe_divide
from granary.operators.features import _series
from granary.operators.ordered import fits, over_history, row_positions


@nan_is_missing
def yoy_inflation(
    df: DataFrame, price: str, group=None, order_by=(), lag: int = 12, name: str = "inflacion_yoy", bounded: bool | None = None
) -> DataFrame:
    """Percentage change against the row ``lag`` periods earlier; NULL on a zero base."""
    keys, order = _series(df, group, order_by)

    def build(w):
        base = F.lag(price, lag).over(w)
        return {name: safe_divide(F.col(price) - base, base) * 100.0}

    return over_history(df, keys, order, lag, build, bounded)


@nan_is_missing
def yoy_inflation_calendar(
    df: DataFrame, price: str, period: str, group: list[str], months: int = 12, name: str = "inflacion_yoy"
) -> DataFrame:
    """Same change against the calendar period ``months`` earlier, whatever rows are missing."""
    base = df.select(*group, F.add_months(period, months).alias(period), F.col(price).alias("__base"))
    joined = attach(df, base, [*group, period], "left")
    return joined.withColumn(name, safe_divide(F.col(price) - F.col("__base"), F.col("__base")) * 100.0).drop("__base")


@nan_is_missing
def terms_of_trade(
    inputs: DataFrame, products: DataFrame, keys: list[str], input_price: str, product_price: str, name: str = "terminos_intercambio"
) -> DataFrame:
    """Input price over product price, aligned on ``keys``; periods of either side are kept."""
    left = inputs.select(*keys, F.col(input_price).alias("__in")).alias("l")
    right = products.select(*keys, F.col(product_price).alias("__out")).alias("r")
    joined = left.join(right, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys], "full_outer")
    return joined.select(
        *[F.coalesce(F.col(f"l.{k}"), F.col(f"r.{k}")).alias(k) for k in keys],
        F.col("__in").alias(input_price),
        F.col("__out").alias(product_price),
        safe_divide(F.col("__in"), F.col("__out")).alias(name),
    )


@nan_is_missing
def kth_value(df: DataFrame, value: str, group, order_by, k: int = 0, bounded: bool | None = None) -> DataFrame:
    """Per series: the k-th non-missing value (negative k counts from the end); no row if out of range."""
    keys, order = _series(df, group, order_by)
    present = df.filter(F.col(value).isNotNull())
    names = [order_by] if isinstance(order_by, str) else list(order_by)
    if k in (0, -1):
        # The ends need no ordering at all: an aggregate with map-side combining.
        pick = F.min_by if k == 0 else F.max_by
        return present.groupBy(*keys).agg(pick(value, F.struct(*names)).alias("base"))
    if k < 0:
        order = [F.col(n).desc_nulls_first() for n in names]
    placed = row_positions(present, keys, order, "__pos", bounded)
    return placed.filter(F.col("__pos") == (k if k >= 0 else -k - 1)).select(*keys, F.col(value).alias("base"))


@nan_is_missing
def price_index(
    df: DataFrame, price: str, group, order_by, base_idx: int = 0, name: str = "indice_base100", bounded: bool | None = None
) -> DataFrame:
    """Level relative to the base period, times 100; all NULL when the base is zero or absent."""
    keys, _ = _series(df, group, order_by)
    base = kth_value(df, price, group, order_by, base_idx, bounded)
    joined = attach(df, base, keys, "left")
    return joined.withColumn(name, safe_divide(F.col(price), F.col("base")) * 100.0).drop("base")


@nan_is_missing
def latest(df: DataFrame, group: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Value of each column in the newest row of every group."""
    return df.groupBy(*group).agg(*[F.max_by(c, F.struct(*order)).alias(c) for c in columns])


@nan_is_missing
def forward_fill(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, bounded: bool | None = None) -> DataFrame:
    """Last known value up to the current row.

    Beyond the group limit the known rows are numbered and each row joins the known row
    whose number equals the count of known rows so far.
    """
    sort = [F.col(o).asc_nulls_last() for o in order]
    if fits(df, keys, bounded):
        w = Window.partitionBy(*keys).orderBy(*sort).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, F.last(value, ignorenulls=True).over(w))
    from granary.operators.ordered import running_total

    known = F.col(value).isNotNull().cast("bigint")
    counted = running_total(df, keys, sort, {"__seen": known}, bounded=False).withColumn("__seen", F.col("__seen") + known)
    source = counted.filter(F.col(value).isNotNull()).select(*keys, "__seen", F.col(value).alias(name))
    return attach(counted, source, [*keys, "__seen"], "left").drop("__seen")
