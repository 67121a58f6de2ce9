"""Order statistics of sliding windows, for windows too long to hold an array a row.

A series is cut into blocks of positions with the last rows of the block before (see ``lagged.with_halo``). In a block the window
is kept as a sorted list: a step puts one value in and takes one out, the median is read from its middle, and the median of
distances from it is found by halving, as distances grow to both sides of it. A task holds a block and its halo, never a whole
long series.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.nulls import nan_to_null
from granary.operators.lagged import with_halo
from granary.operators.ordered import group_limit, row_positions

#: Numbers of windows that are laid out side by side at a time.
CHUNK = 1 << 20


def median_distance(ordered: list[float], centre: float) -> float:
    """Median of |x - centre| over a sorted list."""
    n = len(ordered)
    at = bisect_left(ordered, centre)

    def smallest(k: int) -> float:
        """The k-th smallest distance (from 1): i of the k are below the centre."""
        low, high = max(0, k - (n - at)), min(k, at)
        while low < high:
            i = (low + high) // 2
            # one more from below is right if it is no further away than the last one taken from above
            if centre - ordered[at - 1 - i] < ordered[at + k - i - 1] - centre:
                low = i + 1
            else:
                high = i
        below = centre - ordered[at - low] if low else -np.inf
        above = ordered[at + k - low - 1] - centre if k > low else -np.inf
        return max(below, above)

    return smallest((n + 1) // 2) if n % 2 else (smallest(n // 2) + smallest(n // 2 + 1)) / 2.0


def sliding_medians(x: np.ndarray, size: int, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Median and median distance from it of the last ``size`` values at each index from ``start`` on; NaN is no value."""
    held = sorted(v for v in x[max(0, start - size + 1) : start].tolist() if v == v)
    centres, spreads = np.full(len(x) - start, np.nan), np.full(len(x) - start, np.nan)
    values = x.tolist()
    for t in range(start, len(values)):
        if values[t] == values[t]:
            insort(held, values[t])
        if t > start and t >= size and values[t - size] == values[t - size]:
            del held[bisect_left(held, values[t - size])]
        if held:
            n = len(held)
            centres[t - start] = centre = (held[(n - 1) // 2] + held[n // 2]) / 2.0
            spreads[t - start] = median_distance(held, centre)
    return centres, spreads


def sliding_variation(x: np.ndarray, size: int, start: int) -> np.ndarray:
    """Sample deviation over mean of the same windows; NaN with fewer than two values or a mean of zero."""
    if start >= len(x):
        return np.zeros(0)
    padded = np.concatenate([np.full(size - 1, np.nan), x])
    windows = np.lib.stride_tricks.sliding_window_view(padded, size)[start:]
    out = np.full(len(windows), np.nan)
    step = max(1, CHUNK // size)
    for k in range(0, len(windows), step):
        w = windows[k : k + step]
        known = ~np.isnan(w)
        n = known.sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = np.where(known, w, 0.0).sum(axis=1) / n
            off = np.where(known, w - mean[:, None], 0.0)
            out[k : k + step] = np.where((n > 1) & (mean != 0), np.sqrt((off * off).sum(axis=1) / (n - 1)) / mean, np.nan)
    return out


def rolling_robust(
    df: DataFrame, keys: list[str], order: list[Column], value: str, size: int, names: tuple[str, str, str], bounded: bool | None = None
) -> DataFrame:
    """``df`` with variation, median and MAD (``names``) of the last ``size`` rows of each series. ``order`` must be total."""
    block = max(group_limit(df), size)
    placed = row_positions(df.withColumn("__x", F.col(value).cast("double")), keys, order, "__pos", bounded)
    blocks = with_halo(placed, keys, F.lit(size - 1), F.lit(block), "__pos")
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])
    kept = df.columns

    def solve(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("__pos")
        first = rows["__block"][0].as_py() * block
        start = int(np.searchsorted(rows["__pos"].to_numpy(), first))
        x = rows["__x"].to_numpy().astype(float)
        centres, spreads = sliding_medians(x, size, start)
        out = rows.slice(start).select(kept)
        for name, numbers in zip(names, (sliding_variation(x, size, start), centres, spreads)):
            out = out.append_column(name, pa.array(numbers, pa.float64()))
        return out

    out = blocks.groupBy(*keys, "__block").applyInArrow(solve, schema)
    return out.withColumns({n: nan_to_null(F.col(n)) for n in names})
