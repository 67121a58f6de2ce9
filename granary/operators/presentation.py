"""Data behind the charts and the executive summary (drawing is left to the reader's tool)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.labels import classify_inflation, classify_spi, classify_thermal
from granary.operators.ordered import row_positions


def spi_band(value: Column) -> Column:
    """Band between the drawn thresholds -1.5, -1, 0 and 1."""
    return (
        F.when(value.isNull(), "sin_dato")
        .when(value <= -1.5, "severa")
        .when(value <= -1.0, "moderada")
        .when(value < 0.0, "seca")
        .when(value < 1.0, "humeda")
        .otherwise("muy_humeda")
    )


def heat_side(z: Column) -> Column:
    """Colour side of an anomaly bar; a missing value counts as not cold."""
    return F.when(F.coalesce(z, F.lit(0.0)) >= 0, "calido").otherwise("frio")


def dual_curve(df: DataFrame, keys: list[str], price: str, change: str | None = None) -> DataFrame:
    """Price and optional change as two curves in long form; absent points are left out."""
    curves = [c for c in (price, change) if c and c in df.columns]
    return df.select(*keys, *curves).unpivot(keys, curves, "curva", "valor").filter(F.col("valor").isNotNull())


def ranking(df: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """Mean per group with its place, lowest first."""
    means = df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.avg(value).alias(name))
    placed = row_positions(means, [], [F.col(name).asc_nulls_last(), F.col(group)], "__pos")
    return placed.select(group, name, (F.col("__pos") + 1).cast("bigint").alias("puesto"))


def executive_summary(layers: dict[str, DataFrame], gold: DataFrame, period: str, tie: str) -> DataFrame:
    """One row: layer sizes, newest indicator values and their risk classes."""
    newest = F.struct(period, tie)
    values = ("spi_3", "anomalia_termica_z", "inflacion_yoy")
    out = gold.agg(
        F.count(F.lit(1)).alias("filas_indicadores"),
        F.max(period).alias("ultimo_mes"),
        *[F.max_by(c, newest).alias(c) for c in values],
    )
    for name, df in layers.items():
        out = out.join(df.agg(F.count(F.lit(1)).alias(name)), on=F.lit(True), how="left")
    return out.withColumns(
        {
            "riesgo_spi": classify_spi(F.col("spi_3")),
            "riesgo_termico": classify_thermal(F.col("anomalia_termica_z")),
            "riesgo_inflacion": classify_inflation(F.col("inflacion_yoy")),
        }
    )
