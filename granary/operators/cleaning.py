"""Renames, safe casts, fills, deduplication and the per-source cleaners."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.casting import period_id, to_day, to_double, to_instant, to_long_or_zero
from granary.functions.nulls import numeric_columns, text_columns
from granary.functions.text import sanitize_text

# Fill word for a missing variety and the words that count as missing.
MISSING_VARIETY = "SIN_VARIEDAD_ESPECIFICADA"
MISSING_WORDS = ("NAN", "NONE")

# Column layouts of the four known sources.
CROP_RENAMES = {
    "c_d_dep": "cod_departamento",
    "c_d_mun": "cod_municipio",
    "a_o": "anio",
    "desagregaci_n_regional_y": "variedad",
    "rea_sembrada_ha": "area_sembrada_ha",
    "rea_cosechada_ha": "area_cosechada_ha",
    "producci_n_t": "produccion_ton",
    "rendimiento_t_ha": "rendimiento_ton_ha",
}
STATION_RENAMES = {
    "codigoestacion": "codigo_estacion",
    "nombreestacion": "nombre_estacion",
    "fechaobservacion": "fecha_observacion",
    "valorobservado": "valor_observado",
    "descripcionsensor": "sensor_descripcion",
    "unidadmedida": "unidad_medida",
}
PRICE_RENAMES = {"preciopromedio": "precio_promedio"}
TRADE_RENAMES = {
    "a_o": "anio",
    "cod_depto": "cod_departamento",
    "exportaciones_en_valor_usd": "valor_usd",
    "exportaciones_en_volumen": "volumen_kg",
}


@dataclass(frozen=True)
class Cleaner:
    """Declarative description of one source's cleaning steps."""

    renames: dict[str, str]
    text: list[str]
    types: dict[str, str]
    keys: list[str]
    optional_keys: list[str] = field(default_factory=list)
    fill: dict[str, str] = field(default_factory=dict)


# Columns of the published sources, their types and keys.
CLEANERS = {
    "eva": Cleaner(
        CROP_RENAMES,
        ["departamento", "municipio", "cultivo", "variedad", "grupo_de_cultivo"],
        {
            "cod_departamento": "string",
            "cod_municipio": "string",
            "anio": "int64",
            "area_sembrada_ha": "float64",
            "area_cosechada_ha": "float64",
            "produccion_ton": "float64",
            "rendimiento_ton_ha": "float64",
        },
        ["cod_municipio", "anio", "cultivo", "variedad"],
        ["periodo"],
        {"variedad": MISSING_VARIETY},
    ),
    "ideam": Cleaner(
        STATION_RENAMES,
        ["sensor_descripcion"],
        {"codigo_estacion": "string", "fecha_observacion": "datetime64[ns]", "valor_observado": "float64"},
        ["codigo_estacion", "fecha_observacion", "sensor_descripcion"],
    ),
    "sipsa": Cleaner(
        PRICE_RENAMES,
        ["articulo", "municipio", "fuente"],
        {"anio": "int64", "mes": "int64", "precio_promedio": "float64", "cod_municipio": "string"},
        ["cod_municipio", "anio", "mes", "articulo"],
    ),
    "trade": Cleaner(
        TRADE_RENAMES,
        ["departamento", "producto", "descripcion_partida4_dig", "partida", "tradici_n_producto"],
        {
            "anio": "int64",
            "cod_departamento": "string",
            "partida": "string",
            "valor_usd": "float64",
            "volumen_kg": "float64",
        },
        ["anio", "mes", "cod_departamento", "producto", "partida"],
    ),
}
# Other names under which a cleaner is known.
CLEANER_ALIASES = {"bioinsumos": "trade", "exportaciones": "trade"}


def rename_present(df: DataFrame, renames: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in renames.items() if k in df.columns})


def sanitize_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: sanitize_text(F.col(c)) for c in present}) if present else df


def _cast(col: Column, have: str, want: str) -> Column:
    kind = want.lower().strip()
    if kind in ("float", "float64", "float32", "double"):
        return to_double(col, have)
    if kind in ("int", "int64", "int32"):
        return to_long_or_zero(col, have)
    if kind in ("category", "string", "str", "object"):
        return col.cast("string")
    if "datetime" in kind:
        return to_instant(col)
    if kind in ("bool", "boolean"):
        return col.try_cast("boolean")
    raise ValueError(f"unknown target type: {want}")


def cast_datatypes(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Safe casts; integers go through double, missing becomes 0, fractions are cut."""
    have = dict(df.dtypes)
    wanted = {c: _cast(F.col(c), have[c], t) for c, t in types.items() if c in have}
    return df.withColumns(wanted) if wanted else df


def fill_missing(
    df: DataFrame,
    columns: list[str] | None = None,
    default: str = MISSING_VARIETY,
    numeric_fill: float | None = None,
) -> DataFrame:
    """Blank, NULL and the missing words become ``default``; numbers optionally filled."""
    chosen = [c for c in (columns or text_columns(df)) if c in df.columns]
    if chosen:
        df = df.withColumns(
            {
                c: F.when(
                    F.col(c).isNull() | F.col(c).rlike(r"(?U)^\s*$") | F.col(c).isin(*MISSING_WORDS), F.lit(default)
                ).otherwise(F.col(c))
                for c in chosen
            }
        )
    if numeric_fill is not None:
        have = dict(df.dtypes)
        df = df.withColumns({c: F.coalesce(to_double(F.col(c), have[c]), F.lit(numeric_fill)).cast(have[c]) for c in numeric_columns(df)})
    return df


def keep_first(df: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """One row per key: the first by ``order``, ties settled by all other columns.

    ``row_number() = 1`` lets Spark keep one row per key and map partition before the
    shuffle (window group limit), so a hot key never arrives whole in one task.
    """
    present = [k for k in keys if k in df.columns]
    if not present:
        return df.dropDuplicates()
    rest = [
        F.col(f.name).asc_nulls_last()
        for f in df.schema.fields
        if f.name not in present and not isinstance(f.dataType, (T.MapType, T.VariantType))
    ]
    ranking = [*(order or []), *rest] or [F.lit(1)]
    w = Window.partitionBy(*present).orderBy(*ranking)
    return df.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank")


def deduplicate(df: DataFrame, keys: list[str], sort_by: str | None = None, ascending: bool = False) -> DataFrame:
    """Keep-first by key; missing sort values come last in either direction."""
    if sort_by and sort_by in df.columns:
        by = F.col(sort_by)
        return keep_first(df, keys, [by.asc_nulls_last() if ascending else by.desc_nulls_last()])
    return keep_first(df, keys)


def clean(df: DataFrame, kind: str) -> DataFrame:
    """Cleaner by name; unknown names sanitise every text column and drop equal rows."""
    spec = CLEANERS.get(CLEANER_ALIASES.get(kind.lower(), kind.lower()))
    if spec is None:
        return sanitize_columns(df, text_columns(df)).dropDuplicates()
    out = df.transform(rename_present, spec.renames).transform(sanitize_columns, spec.text)
    for column, word in spec.fill.items():
        if column in out.columns:
            out = fill_missing(out, [column], word)
    out = cast_datatypes(out, spec.types)
    return keep_first(out, spec.keys + [k for k in spec.optional_keys if k in out.columns])


def add_calendar(df: DataFrame, date: str, **constants) -> DataFrame:
    """``anio`` and ``mes`` from a date column plus constant columns."""
    day = F.col(date)
    return df.withColumns(
        {"anio": F.year(day), "mes": F.month(day), **{k: F.lit(v) for k, v in constants.items()}}
    )


# Columns of a wide price table that hold no price.
NOT_PRICES = ("fecha", "fecha_observacion", "anio", "mes", "fecha_corte")


def melt_prices(df: DataFrame, cod_municipio: str = "11001") -> DataFrame:
    """Wide price table to one row per (period, product), positive prices only."""
    date = next((c for c in ("fecha", "fecha_observacion") if c in df.columns), None)
    if date is None:
        schema = "id_tiempo bigint, cod_municipio string, insumo string, precio double"
        return df.sparkSession.createDataFrame([], schema)
    skip = {date, *NOT_PRICES[2:]}
    have = dict(df.dtypes)
    prices = [c for c in df.columns if c not in skip]
    narrow = df.select(
        period_id(to_day(F.col(date))).alias("id_tiempo"),
        *[to_double(F.col(c), have[c]).alias(c) for c in prices],
    )
    long = narrow.unpivot("id_tiempo", prices, "insumo", "precio")
    return long.filter(F.col("id_tiempo").isNotNull() & (F.col("precio") > 0)).select(
        "id_tiempo", F.lit(cod_municipio).alias("cod_municipio"), "insumo", "precio"
    )


def split_sensor(description: Column, value: Column) -> tuple[Column, Column]:
    """Precipitation and temperature columns of one observation."""
    text = F.upper(F.coalesce(description, F.lit("")))
    number = F.coalesce(value, F.lit(0.0))
    return F.when(text.rlike("PRECIP|PLUV"), number), F.when(text.contains("TEMP"), number)


# Fragments of a column name that mark a fertiliser.
FERTILISER_WORDS = ("fertilizante", "urea", "dap", "kcl", "sam")


def input_category(name: Column) -> Column:
    return F.when(name.rlike("|".join(FERTILISER_WORDS)), "Fertilizantes").otherwise("Insumos")
