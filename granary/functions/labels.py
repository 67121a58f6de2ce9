"""Risk classes of the indicators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class names and limits that users of these indicators expect.
MISSING = "DATOS_INSUFICIENTES"
SPI_CLASSES = (
    ("<=", -2.0, "SEQUIA_EXTREMA"),
    ("<=", -1.5, "SEQUIA_SEVERA"),
    ("<=", -1.0, "SEQUIA_MODERADA"),
    (">=", 2.0, "HUMEDAD_EXTREMA"),
    (">=", 1.5, "HUMEDAD_SEVERA"),
    (">=", 1.0, "HUMEDAD_MODERADA"),
)
SPI_DEFAULT = "NORMAL_CLIMATICO"
THERMAL_CLASSES = (
    (">=", 2.0, "ALERTA_CALOR_CRITICA"),
    (">=", 1.0, "ANOMALIA_CALIDA_MODERADA"),
    ("<=", -2.0, "ALERTA_FRIO_CRITICA"),
    ("<=", -1.0, "ANOMALIA_FRIA_MODERADA"),
)
THERMAL_DEFAULT = "TEMPERATURA_ESTABLE"
INFLATION_CLASSES = (
    (">=", 25.0, "ESTRES_COSTOS_CRITICO"),
    (">=", 12.0, "ESTRES_COSTOS_MODERADO"),
    ("<", 0.0, "DEFLACION_INSUMOS"),
)
INFLATION_DEFAULT = "ESTRUCTURA_COSTOS_ESTABLE"

_TESTS = {
    "<=": lambda c, x: c <= x,
    ">=": lambda c, x: c >= x,
    "<": lambda c, x: c < x,
}


def _classify(col: Column, classes: tuple, default: str) -> Column:
    start = F.when(col.isNull() | F.isnan(col), MISSING)
    chain = reduce(lambda acc, rule: acc.when(_TESTS[rule[0]](col, rule[1]), rule[2]), classes, start)
    return chain.otherwise(default)


def classify_spi(col: Column) -> Column:
    return _classify(col, SPI_CLASSES, SPI_DEFAULT)


def classify_thermal(col: Column) -> Column:
    return _classify(col, THERMAL_CLASSES, THERMAL_DEFAULT)


def classify_inflation(col: Column) -> Column:
    return _classify(col, INFLATION_CLASSES, INFLATION_DEFAULT)


def sensor_class(description: Column) -> Column:
    """Kind of measurement by description substring, first match wins."""
    text = F.lower(description)
    return (
        F.when(text.contains("precipitaci") | text.contains("lluvia") | text.contains("pluvio"), "precipitacion")
        .when(text.contains("temperatura"), "temperatura")
        .when(text.contains("radiaci"), "radiacion")
        .otherwise("otro")
    )
