"""Left joins of indicator tables onto a base table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.nulls import same_keys


def consolidate_features(base: DataFrame, indicators: list[DataFrame], keys: list[str]) -> DataFrame:
    """Each indicator joins on the keys both sides have; NULL keys match NULL keys.

    Repeated indicator keys multiply base rows; columns with the same name on both
    sides get the suffixes ``_x`` and ``_y``.
    """
    out = base
    for item in indicators:
        common = [k for k in keys if k in out.columns and k in item.columns]
        if not common:
            continue
        clash = (set(out.columns) & set(item.columns)) - set(common)
        l, r = out.alias("l"), item.alias("r")
        left = [F.col(f"l.`{c}`").alias(f"{c}_x" if c in clash else c) for c in out.columns]
        right = [F.col(f"r.`{c}`").alias(f"{c}_y" if c in clash else c) for c in item.columns if c not in common]
        out = l.join(r, same_keys("l", "r", common), "left").select(*left, *right)
    return out
