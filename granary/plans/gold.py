"""Assembly of the indicator layer: one row per series and month."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.labels import classify_inflation, classify_spi, classify_thermal
from granary.functions.nulls import safe_divide
from granary.operators.climate import spi, thermal_anomaly
from granary.operators.features import add_lags, add_rolling
from granary.operators.market_indices import yoy_inflation

SPI_SCALES = (1, 3, 6)


def climate_block(monthly: DataFrame, series: str, period: str) -> DataFrame:
    """SPI at three scales and thermal anomaly of one monthly table.

    One row per series and month, so a series is never longer than the calendar and plain
    windows are bounded; all of them share one shuffle by series.
    """
    out = spi(monthly, "lluvia", series, period, list(SPI_SCALES), bounded=True)
    return thermal_anomaly(out, "temp", period, series, bounded=True)


def market_block(monthly: DataFrame, series: str, period: str) -> DataFrame:
    """Year-over-year change, terms of trade, lags and rolling statistics of prices."""
    out = yoy_inflation(monthly, "precio_insumo", series, period, name="inflacion_yoy", bounded=True)
    out = out.withColumn("terminos_intercambio_tot", safe_divide(F.col("precio_insumo"), F.col("precio_producto")))
    out = add_lags(out, "precio_producto", [1, 3, 6], series, period, bounded=True)
    return add_rolling(out, "precio_producto", [3, 6], series, period, bounded=True)


def assemble(climate: DataFrame, market: DataFrame, series: str, period: str) -> DataFrame:
    """Indicators of two separate monthly tables, inner-joined by series and month."""
    return label(climate.join(market, [series, period], "inner"), period)


def assemble_one(monthly: DataFrame, series: str, period: str) -> DataFrame:
    """The same when every measure sits in one monthly table: no join, one pass."""
    return label(market_block(climate_block(monthly, series, period), series, period), period)


def label(joined: DataFrame, period: str) -> DataFrame:
    """Calendar columns and risk classes."""
    return joined.withColumns(
        {
            "anio": F.year(period),
            "mes_num": F.month(period),
            "riesgo_spi": classify_spi(F.col("spi_3")),
            "riesgo_termico": classify_thermal(F.col("anomalia_termica_z")),
            "riesgo_inflacion": classify_inflation(F.col("inflacion_yoy")),
        }
    )
