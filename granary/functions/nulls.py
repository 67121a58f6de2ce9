"""One null model: NaN becomes NULL once, at the edge."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOATING = (T.FloatType, T.DoubleType)
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def nan_to_null(col: Column) -> Column:
    return F.when(~F.isnan(col), col)


def fold_nan(df: DataFrame) -> DataFrame:
    """NaN to NULL in every floating column."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, FLOATING)]
    return df.withColumns({c: nan_to_null(F.col(c)) for c in floats}) if floats else df


def nan_is_missing(fn: Callable) -> Callable:
    """An operator that sees NULL for every NaN of the tables it is given.

    Tables are not folded when they are read: filters on floating columns then still reach the scan.
    """

    @functools.wraps(fn)
    def folded(*args, **kwargs):
        fold = lambda x: fold_nan(x) if isinstance(x, DataFrame) else x
        return fn(*map(fold, args), **{k: fold(v) for k, v in kwargs.items()})

    return folded


def columns_of(df: DataFrame, kinds: tuple) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_of(df, NUMERIC)


def text_columns(df: DataFrame) -> list[str]:
    return columns_of(df, (T.StringType,))


def safe_divide(num: Column, den: Column) -> Column:
    """NULL instead of an error or infinity when the denominator is zero."""
    return F.try_divide(num, F.nullif(den, F.lit(0.0)))


def same_keys(left: str, right: str, keys: list[str]) -> Column:
    """Null-safe equality over ``keys`` of two aliased frames."""
    cond = F.lit(True)
    for i, k in enumerate(keys):
        eq = F.col(f"{left}.`{k}`").eqNullSafe(F.col(f"{right}.`{k}`"))
        cond = eq if i == 0 else cond & eq
    return cond


def attach(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join ``right`` (unique on ``keys``, null-safe) and keep each key column once.

    No broadcast hint: the optimiser broadcasts only when measured sizes allow it,
    and otherwise splits skewed partitions of the larger side.
    """
    extra = [c for c in right.columns if c not in keys]
    if not keys:
        return left.join(right, how=how, on=F.lit(True))
    l, r = left.alias("l"), right.alias("r")
    return l.join(r, same_keys("l", "r", keys), how).select(
        *[F.col(f"l.`{c}`") for c in left.columns], *[F.col(f"r.`{c}`") for c in extra]
    )


def stage(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns that the optimiser evaluates exactly once per row.

    ``withColumns`` alone does not promise that: a filter on a derived column is pushed
    below its projection with the whole expression copied into every mention. The
    one-element ``inline`` is a boundary that neither rule crosses.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
