"""Sums over pairs of observations a few steps apart, for series of any length.

A series is cut into blocks of positions, and each block also gets the last rows of the block before it (its halo). A
block then holds every pair that ends in it, so its sums need no join, and the sums of all blocks add up. About n rows
are shuffled however many lags are asked for, and one task holds a block and its halo, never a whole long series.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.nulls import attach
from granary.functions.stats import norm_cdf
from granary.functions.special import polynomial
from granary.operators.ordered import group_limit

# MacKinnon (1994), distribution of the Dickey-Fuller statistic with constant, one variable.
TAU_STAR, TAU_MIN, TAU_MAX = -1.61, -18.83, 2.74
TAU_SMALL = (2.1659, 1.4412, 0.038269)
TAU_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
# Rows of a moment block that are turned into a matrix at a time.
CHUNK = 8_192


def with_halo(placed: DataFrame, keys: list[str], depth: Column, block: Column, pos: str = "pos") -> DataFrame:
    """``placed`` (with column ``pos``) plus __block: each row in its own block of positions, and in the next one if it is among the
    last ``depth`` rows of its own. ``block`` must not be smaller than ``depth``."""
    own = F.floor(F.col(pos) / block)
    late = (F.col(pos) % block) >= block - depth
    return placed.withColumn("__own", own).withColumn("__block", F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own)))).drop("__own")


def sums_over_blocks(
    placed: DataFrame, keys: list[str], value: str, lags: DataFrame, reach: int, sums: Callable[[np.ndarray, int, int, int], np.ndarray]
) -> DataFrame:
    """(keys, i, total): component i of ``sums`` added up over the blocks of each series.

    ``lags`` has one row per series with column lags; a block's halo is lags + ``reach`` rows. ``sums(x, start, first, lags)`` gets the
    values of a block with its halo, the index of the first row of its own, and that row's position in the series.
    """
    limit = group_limit(placed)
    rows = attach(placed.select(*keys, "pos", value), lags.select(*keys, "lags"), keys, "inner")
    depth = F.col("lags") + reach
    size = F.greatest(F.lit(limit), depth)
    blocks = with_halo(rows, keys, depth, size).withColumn("__first", F.col("__block") * size)
    fields = [f for f in rows.schema.fields if f.name in keys]
    schema = T.StructType(fields + [T.StructField("part", T.ArrayType(T.DoubleType()))])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        first, n_lags = int(pdf["__first"].iloc[0]), int(pdf["lags"].iloc[0])
        start = int(np.searchsorted(pdf["pos"].to_numpy(), first))
        x = pdf[value].to_numpy(float)
        part = sums(x, start, first, n_lags) if start < len(x) else np.zeros(0)  # a halo without a block
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in keys), part]], columns=[f.name for f in schema.fields])

    parts = blocks.groupBy(*keys, "__block").applyInPandas(solve, schema)
    return parts.select(*keys, F.posexplode("part").alias("i", "x")).groupBy(*keys, "i").agg(F.sum("x").alias("total"))


def lagged_products(placed: DataFrame, keys: list[str], value: str, lags: DataFrame) -> DataFrame:
    """(keys, j, c): sum of x_t x_{t-j} for j = 1 .. lags of each series."""

    def sums(x: np.ndarray, start: int, first: int, n_lags: int) -> np.ndarray:
        out = np.zeros(n_lags)
        for j in range(1, n_lags + 1):
            begin = max(start, j)  # in the first block there is nothing before
            out[j - 1] = x[begin:] @ x[begin - j : len(x) - j] if begin < len(x) else 0.0
        return out

    return sums_over_blocks(placed, keys, value, lags, 0, sums).select(*keys, (F.col("i") + 1).alias("j"), F.col("total").alias("c"))


def _design(y: np.ndarray, ends: np.ndarray, lags: int) -> np.ndarray:
    """Rows [1, y before, earlier differences 1 .. lags, difference] at the given indices of y."""
    dy = np.diff(y)
    return np.column_stack([np.ones(len(ends)), y[ends - 1], *[dy[ends - 1 - j] for j in range(1, lags + 1)], dy[ends - 1]])


def moment_matrices(placed: DataFrame, keys: list[str], value: str, lags: DataFrame) -> DataFrame:
    """(keys, i, total): flattened moment matrix of the lagged regression over all rows that have every lag, then the first lags + 1 values."""

    def sums(x: np.ndarray, start: int, first: int, n_lags: int) -> np.ndarray:
        width = n_lags + 3
        ends = np.arange(max(start, n_lags + 1) if first == 0 else start, len(x))
        total = np.zeros((width, width))
        for k in range(0, len(ends), CHUNK):
            z = _design(x, ends[k : k + CHUNK], n_lags)
            total += z.T @ z
        head = np.zeros(n_lags + 1)
        if first == 0:
            head[: min(len(x), n_lags + 1)] = x[: n_lags + 1]
        return np.concatenate([total.ravel(), head])

    return sums_over_blocks(placed, keys, value, lags, 1, sums)


def _swept(m: np.ndarray, order: list[int]) -> list[np.ndarray]:
    """What is left of a moment matrix after eliminating the first 0, 1, 2, ... variables of ``order``."""
    left = [m[np.ix_(order, order)]]
    while len(left[-1]) > 1:
        a = left[-1]
        left.append(a[1:, 1:] - np.outer(a[1:, 0], a[0, 1:]) / a[0, 0] if a[0, 0] > 0 else a[1:, 1:])
    return left


def lag_of_least_aic(m: np.ndarray, rows: int) -> int:
    """Number of lagged differences with the smallest AIC, all fitted to the rows of ``m``; ties: the fewest."""
    width = len(m)
    left = _swept(m, list(range(width)))
    aic = [rows * math.log(max(left[2 + k][-1, -1], 1e-300) / rows) + 2.0 * (2 + k) for k in range(width - 2)]
    return int(np.argmin(aic))


def unit_root_t(m: np.ndarray, rows: int, lags: int) -> float | None:
    """t statistic of the level in the regression on a constant, the level and ``lags`` differences, from its moment matrix."""
    order = [0, *range(2, 2 + lags), 1, 2 + lags]
    level = _swept(m, order)[1 + lags]
    if level[0, 0] <= 1e-12 * max(m[1, 1], 1e-300) or rows <= lags + 2:
        return None
    slope = level[0, 1] / level[0, 0]
    rest = max(level[1, 1] - slope * level[0, 1], 0.0) / (rows - lags - 2)
    return None if rest == 0 else float(slope / math.sqrt(rest / level[0, 0]))


def unit_root(placed: DataFrame, keys: list[str], value: str, most: int | None = None) -> DataFrame:
    """(keys, n, lags, t): augmented Dickey-Fuller statistic with a constant; the number of lagged differences is that of least AIC.

    Up to ``most`` lags are tried, by default ceil(12 (n / 100)^(1/4)), but no more than n // 2 - 2, all on the rows that have
    every lag; the chosen one is fitted anew to all rows that it has. Nothing but one moment matrix a series is kept.
    """
    stats = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("__mu"))
    n = F.col("n").cast("double")
    rule = F.ceil(12.0 * F.pow(n / 100.0, F.lit(0.25))) if most is None else F.lit(most)
    sized = stats.withColumn("lags", F.greatest(F.lit(0), F.least(rule, F.floor(n / 2.0) - 2)).cast("int"))
    centred = attach(placed, stats.select(*keys, "__mu"), keys, "inner").select(*keys, "pos", (F.col(value) - F.col("__mu")).alias("x"))
    sums = moment_matrices(centred, keys, "x", sized)
    whole = sums.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "total"))), lambda s: s["total"]).alias("sums"))
    kinds = T.StructType([T.StructField("lags", T.IntegerType()), T.StructField("t", T.DoubleType())])

    @F.pandas_udf(kinds)
    def solve(sums_: pd.Series, n_: pd.Series, lags_: pd.Series) -> pd.DataFrame:
        found = []
        for s, n, most_ in zip(sums_, n_.astype(int), lags_.astype(int)):
            width = most_ + 3
            m, head = np.array(s[: width * width]).reshape(width, width), np.array(s[width * width :])
            lags = lag_of_least_aic(m, n - 1 - most_) if n - 1 - most_ > most_ + 2 else 0
            keep = [*range(2 + lags), width - 1]
            own = m[np.ix_(keep, keep)]
            if most_ > lags:  # rows near the start that have enough lags for this fit
                z = _design(head, np.arange(lags + 1, most_ + 1), lags)
                own = own + z.T @ z
            found.append((lags, unit_root_t(own, n - 1 - lags, lags)))
        return pd.DataFrame(found, columns=["lags", "t"])

    out = attach(sized.select(*keys, "n", "lags"), whole, keys, "inner").withColumn("__fit", solve("sums", "n", "lags"))
    return out.select(*keys, "n", "__fit.lags", "__fit.t")


def unit_root_p(t: Column) -> Column:
    """p-value of the statistic by MacKinnon's response surface."""
    z = F.when(t <= TAU_STAR, polynomial(TAU_SMALL, t)).otherwise(polynomial(TAU_LARGE, t))
    return F.when(t > TAU_MAX, F.lit(1.0)).when(t < TAU_MIN, F.lit(0.0)).when(t.isNotNull(), norm_cdf(z))
