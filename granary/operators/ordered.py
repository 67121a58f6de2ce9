"""Order-dependent primitives that do not depend on group sizes.

A Spark window puts each of its groups into one task. That is the best plan while
groups are small, and no plan at all when one group holds a third of the table. Every
function here therefore has two routes with the same result:

* ``window``: the plain window, taken only if the largest group is known or counted
  to fit ``group_limit``;
* ``ranged``: the rows are range-partitioned by (keys, order), so a large group spans
  many partitions, and small per-slice totals carry the state from slice to slice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.nulls import same_keys
from granary.session import cut_lineage

GROUP_LIMIT_CONF = "granary.groupLimit"
GROUP_LIMIT = 1_000_000


def group_limit(df: DataFrame) -> int:
    """Rows one task may hold for a single group."""
    return int(df.sparkSession.conf.get(GROUP_LIMIT_CONF, str(GROUP_LIMIT)))


def largest_group(df: DataFrame, keys: list[str]) -> int:
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    return counts.agg(F.max("__rows")).first()[0] or 0


def fits(df: DataFrame, keys: list[str], bounded: bool | None) -> bool:
    """``bounded=True`` is the caller's promise (e.g. one row per calendar month);
    ``None`` counts, with map-side partial counts, so hot keys cost nothing extra."""
    return largest_group(df, keys) <= group_limit(df) if bounded is None else bounded


def _window(keys: list[str], order: list[Column]):
    return Window.partitionBy(*keys).orderBy(*order)


def running_total(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    values: dict[str, Column],
    bounded: bool | None = None,
) -> DataFrame:
    """Adds ``name`` = sum of the expression over all earlier rows of the group
    (0 on the first row) for each item of ``values``. ``order`` must be total."""
    if fits(df, keys, bounded):
        w = _window(keys, order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({n: F.coalesce(F.sum(v).over(w), F.lit(0)) for n, v in values.items()})

    names = list(values)
    parts = [f"__v{i}" for i in range(len(names))]
    ranged = df.withColumns({p: values[n] for p, n in zip(parts, names)})
    # The checkpoint freezes which row sits in which slice before it is used twice.
    ranged = cut_lineage(
        ranged.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys], *order).withColumn(
            "__slice", F.spark_partition_id()
        )
    )
    # At most (groups + slices) rows: a group of g slices has g totals.
    totals = ranged.groupBy("__slice", *keys).agg(*[F.sum(p).alias(p) for p in parts])
    earlier = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__slice", *keys, *[F.sum(p).over(earlier).alias(f"{p}_off") for p in parts])
    on = ["__slice", *keys]
    joined = ranged.alias("l").join(offsets.alias("r"), same_keys("l", "r", on), "left")
    joined = joined.select("l.*", *[F.col(f"r.{p}_off") for p in parts])
    local = _window(on, order).rowsBetween(Window.unboundedPreceding, -1)
    return joined.select(
        *[c for c in df.columns],
        *[
            (F.coalesce(F.sum(p).over(local), F.lit(0)) + F.coalesce(F.col(f"{p}_off"), F.lit(0))).alias(n)
            for p, n in zip(parts, names)
        ],
    )


def row_positions(
    df: DataFrame, keys: list[str], order: list[Column], name: str = "pos", bounded: bool | None = None
) -> DataFrame:
    """Zero-based position of each row within its group."""
    if fits(df, keys, bounded):
        return df.withColumn(name, F.row_number().over(_window(keys, order)).cast("bigint") - 1)
    return running_total(df, keys, order, {name: F.lit(1).cast("bigint")}, bounded=False)


def over_history(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    depth: int,
    build: Callable[[object], dict[str, Column]],
    bounded: bool | None = None,
) -> DataFrame:
    """Columns that look back at most ``depth`` rows within their group.

    ``build`` receives the ordered window and returns new columns using ``lag`` up to
    ``depth`` or frames inside ``rowsBetween(-depth, 0)``. On the ranged route a group is
    cut into blocks of equal length, and each block also receives the last ``depth``
    rows of the block before it.
    """
    if fits(df, keys, bounded):
        return df.withColumns(build(_window(keys, order)))
    block = max(group_limit(df), depth)
    placed = row_positions(df, keys, order, "__pos", bounded=False)
    home = F.floor(F.col("__pos") / block)
    tail = (F.col("__pos") % block) >= block - depth
    spread = placed.withColumn("__home", home).withColumn(
        "__block", F.explode(F.when(tail, F.array(home, home + 1)).otherwise(F.array(home)))
    )
    w = Window.partitionBy(*keys, "__block").orderBy("__pos")
    out = spread.withColumns(build(w)).filter(F.col("__home") == F.col("__block"))
    return out.drop("__pos", "__home", "__block")


def average_ranks(df: DataFrame, keys: list[str], value: str, name: str = "avg_rank", bounded: bool | None = None) -> DataFrame:
    """One row per distinct (keys, value): ``n`` copies and their shared average rank.

    Ties collapse before anything is ordered, so a hot value is a single row.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_total(counted, keys, [F.col(value).asc()], {"__before": F.col("n")}, bounded)
    return ranked.select(*keys, value, "n", (F.col("__before") + (F.col("n") + 1) / 2.0).alias(name))
