"""Flattening of nested analytic responses into positional columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Nesting of the response, down to the value tuples.
RESPONSE_SCHEMA = (
    "results array<struct<result: struct<data: struct<dsr: struct<"
    "DS: array<struct<PH: array<struct<DM0: array<struct<C: array<string>>>>>>>>>>>>"
)


def response_rows(df: DataFrame, column: str, keep: list[str] = ()) -> DataFrame:
    """One row per non-empty tuple: ``keep`` columns plus ``C`` (array of text).

    Only the first placeholder of a data shape is read; malformed text gives no rows.
    """
    parsed = df.select(*keep, F.from_json(column, RESPONSE_SCHEMA, {"mode": "PERMISSIVE"}).alias("r"))
    shapes = parsed.select(*keep, F.explode("r.results").alias("s")).select(*keep, F.explode("s.result.data.dsr.DS").alias("d"))
    tuples = shapes.select(*keep, F.explode(F.try_element_at("d.PH", F.lit(1))["DM0"]).alias("t"))
    return tuples.select(*keep, F.col("t.C").alias("C")).filter(F.size("C") > 0)


def flatten_response(df: DataFrame, column: str, width: int | None = None, keep: list[str] = ()) -> DataFrame:
    """``col_0 .. col_{n-1}``; without a width the longest tuple decides (one extra pass)."""
    rows = response_rows(df, column, keep)
    n = width if width is not None else (rows.agg(F.max(F.size("C"))).first()[0] or 0)
    return rows.select(*keep, *[F.get("C", F.lit(i)).alias(f"col_{i}") for i in range(n)])
