"""Star schema: calendar, master and product dimensions, facts, and the analytic view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.casting import period_id, quarter_of, semester_of, to_day, to_double
from granary.functions.nulls import attach
from granary.functions.text import label_from_name, sanitize_text, zero_fill
from granary.operators.cleaning import (
    MISSING_VARIETY,
    input_category,
    melt_prices,
    split_sensor,
)
from granary.operators.ordered import row_positions

# Table layouts (name and type of every column).
SCHEMAS = {
    "dim_tiempo": "id_tiempo bigint, anio bigint, mes bigint, trimestre bigint, semestre bigint",
    "dim_municipio": "cod_municipio string, cod_departamento string, nombre_municipio string, nombre_departamento string",
    "dim_producto": "id_producto bigint, nombre_producto string, grupo_cultivo string, variedad string",
    "dim_insumo": "id_insumo bigint, nombre_insumo string, categoria_insumo string",
    "fact_produccion_eva": "id_tiempo bigint, cod_municipio string, id_producto bigint, area_sembrada_ha double, "
    "area_cosechada_ha double, produccion_ton double, rendimiento_ton_ha double",
    "fact_precios_sipsa": "id_tiempo bigint, cod_municipio string, id_insumo bigint, precio_promedio double",
    "fact_clima_ideam": "id_tiempo bigint, cod_municipio string, codigo_estacion string, "
    "precipitacion_mensual_mm double, temperatura_media_c double, spi_3 double, anomalia_termica_z double",
    "mart_hypothesis_tests": "variable string, categoria_prueba string, prueba string, estadistico double, "
    "p_valor double, decision string, interpretacion string",
}
VIEW = "view_indicadores_agroclimaticos"
# Defaults used by the loaders.
DEFAULT_TOWN, DEFAULT_STATION, DEFAULT_YEAR, CLOSING_MONTH = "11001", "EST_GENERICA", 2022, 12
FIRST_YEAR, LAST_YEAR = 2015, 2026


def calendar(spark: SparkSession, first_year: int = FIRST_YEAR, last_year: int = LAST_YEAR) -> DataFrame:
    """One row per month of the given years."""
    months = spark.range(first_year * 12, (last_year + 1) * 12)
    year, month = F.floor(F.col("id") / 12), (F.col("id") % 12) + 1
    return months.select(
        (year * 100 + month).alias("id_tiempo"),
        year.alias("anio"),
        month.alias("mes"),
        quarter_of(month).cast("bigint").alias("trimestre"),
        semester_of(month).cast("bigint").alias("semestre"),
    )


def append_new(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Insert-or-ignore: rows whose key is already stored stay out."""
    return existing.unionByName(incoming.join(existing.select(key), key, "left_anti").select(existing.columns))


def upsert_towns(existing: DataFrame, incoming: DataFrame, order: str) -> DataFrame:
    """Insert-or-replace by code; within a batch the last row by ``order`` wins."""
    batch = incoming.select(
        zero_fill(F.col("cod_municipio"), 5).alias("cod_municipio"),
        zero_fill(F.col("cod_departamento"), 2).alias("cod_departamento"),
        sanitize_text(F.col("nombre_municipio")).alias("nombre_municipio"),
        sanitize_text(F.col("nombre_departamento")).alias("nombre_departamento"),
        F.col(order).cast("bigint").alias("__at"),
    ).filter("nombre_municipio != ''")
    stored = existing.withColumn("__at", F.lit(None).cast("bigint"))
    rest = ["cod_departamento", "nombre_municipio", "nombre_departamento"]
    # Stored rows sort first (NULL), so any incoming row beats them; the aggregate
    # combines before the shuffle.
    newest = F.struct(F.col("__at").isNotNull(), F.col("__at"), *rest)
    return (
        stored.unionByName(batch)
        .groupBy("cod_municipio")
        .agg(*[F.max_by(c, newest).alias(c) for c in rest])
        .select(existing.columns)
    )


def assign_keys(
    existing: DataFrame, incoming: DataFrame, natural: list[str], key: str, order: str, bounded: bool | None = False
) -> DataFrame:
    """Stored rows plus one new row per unseen natural key, numbered on from the last id.

    New keys are numbered over ranges unless ``bounded`` promises that they are few.

    Attributes and numbering follow first appearance by ``order``.
    """
    extra = [c for c in existing.columns if c not in natural and c != key]
    fresh = incoming.join(existing.select(*natural), natural, "left_anti")
    first = fresh.groupBy(*natural).agg(
        F.min(order).alias("__at"), *[F.min_by(c, F.struct(order, c)).alias(c) for c in extra]
    )
    numbered = row_positions(first, [], [F.col("__at"), *[F.col(c) for c in natural]], "__n", bounded)
    # A one-row frame; the largest stored id.
    last = existing.agg(F.coalesce(F.max(key), F.lit(0)).alias("__last"))
    new = numbered.join(last, on=F.lit(True), how="left").withColumn(key, F.col("__last") + F.col("__n") + 1)
    return existing.unionByName(new.select(existing.columns))


def product_keys(df: DataFrame) -> DataFrame:
    """Natural product key of each row: sanitised name, variety (blank gets the default), group."""
    have = set(df.columns)
    variety = sanitize_text(F.col("variedad")) if "variedad" in have else F.lit("")
    group = sanitize_text(F.col("grupo_de_cultivo")) if "grupo_de_cultivo" in have else F.lit("")
    return df.withColumns(
        {
            "nombre_producto": sanitize_text(F.col("cultivo")),
            "variedad": F.when(variety == "", MISSING_VARIETY).otherwise(variety),
            "grupo_cultivo": group,
        }
    )


def get_or_create_products(existing: DataFrame, crops: DataFrame, order: str, bounded: bool | None = False) -> DataFrame:
    keyed = product_keys(crops)
    return assign_keys(existing, keyed, ["nombre_producto", "variedad"], "id_producto", order, bounded)


def input_names(prices: DataFrame) -> DataFrame:
    """(column, label, category, place) of the price columns of a wide table."""
    from granary.operators.cleaning import NOT_PRICES

    columns = [c for c in prices.columns if c not in NOT_PRICES]
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("insumo"),
                label_from_name(c).alias("nombre_insumo"),
                sanitize_text(input_category(F.lit(c))).alias("categoria_insumo"),
                F.lit(i).alias("place"),
            )
            for i, c in enumerate(columns)
        ]
    )
    return prices.sparkSession.range(1).select(F.explode(rows).alias("r")).select("r.*")


def get_or_create_inputs(existing: DataFrame, names: DataFrame, bounded: bool | None = True) -> DataFrame:
    """Number of price columns bounds the group, hence the plain window by default."""
    return assign_keys(existing, names, ["nombre_insumo"], "id_insumo", "place", bounded)


def lookup(df: DataFrame, dim: DataFrame, on: list[str], key: str, default: int | None = None) -> DataFrame:
    """Surrogate key by natural key; NULL when unknown unless a default is asked for."""
    found = attach(df, dim.select(*on, key), on, "left")
    return found if default is None else found.withColumn(key, F.coalesce(key, F.lit(default).cast("bigint")))


def _amount(df: DataFrame, name: str) -> Column:
    have = dict(df.dtypes)
    return F.coalesce(to_double(F.col(name), have[name]), F.lit(0.0)) if name in have else F.lit(0.0)


def fact_crops(crops: DataFrame, products: DataFrame, default_product: int | None = None) -> DataFrame:
    """Yearly crop production at the closing month; missing measures become 0."""
    keyed = lookup(product_keys(crops), products, ["nombre_producto", "variedad"], "id_producto", default_product)
    year = F.coalesce(F.col("anio").try_cast("bigint"), F.lit(DEFAULT_YEAR)) if "anio" in crops.columns else F.lit(DEFAULT_YEAR)
    return keyed.select(
        (year * 100 + CLOSING_MONTH).cast("bigint").alias("id_tiempo"),
        zero_fill(F.col("cod_municipio"), 5).alias("cod_municipio"),
        "id_producto",
        *[_amount(crops, c).alias(c) for c in ("area_sembrada_ha", "area_cosechada_ha", "produccion_ton", "rendimiento_ton_ha")],
    )


def fact_prices(prices: DataFrame, inputs: DataFrame, cod_municipio: str = DEFAULT_TOWN) -> DataFrame:
    """Long positive prices with the surrogate key of their input."""
    names = lookup(input_names(prices), inputs, ["nombre_insumo"], "id_insumo").select("insumo", "id_insumo")
    return attach(melt_prices(prices, cod_municipio), names, ["insumo"], "left").select(
        "id_tiempo", "cod_municipio", "id_insumo", F.col("precio").alias("precio_promedio")
    )


def fact_climate(obs: DataFrame, default_town: str = DEFAULT_TOWN) -> DataFrame:
    """One row per observation with a date; the value goes to the column its sensor names."""
    have = dict(obs.dtypes)
    date = "fecha_observacion" if "fecha_observacion" in have else "fecha"
    if date not in have:
        return obs.sparkSession.createDataFrame([], SCHEMAS["fact_clima_ideam"])
    station = next((c for c in ("codigo_estacion", "codigoestacion") if c in have), None)
    value = next((c for c in ("valor_observado", "precipitacion_mm") if c in have), None)
    number = _amount(obs, value) if value else F.lit(0.0)
    rain, heat = split_sensor(F.col("sensor_descripcion") if "sensor_descripcion" in have else F.lit(""), number)
    optional = lambda c: to_double(F.col(c), have[c]) if c in have else F.lit(None).cast("double")
    return obs.select(
        period_id(to_day(F.col(date))).alias("id_tiempo"),
        (zero_fill(F.col("cod_municipio"), 5) if "cod_municipio" in have else F.lit(default_town)).alias("cod_municipio"),
        (F.coalesce(F.col(station).cast("string"), F.lit(DEFAULT_STATION)) if station else F.lit(DEFAULT_STATION)).alias(
            "codigo_estacion"
        ),
        rain.alias("precipitacion_mensual_mm"),
        heat.alias("temperatura_media_c"),
        optional("spi_3").alias("spi_3"),
        optional("anomalia_termica_z").alias("anomalia_termica_z"),
    ).filter("id_tiempo IS NOT NULL")


def mart_rows(results: DataFrame) -> DataFrame:
    """Typed select into the layout of the result mart; missing texts become empty."""
    have = dict(results.dtypes)
    out = []
    for f in T._parse_datatype_string(SCHEMAS["mart_hypothesis_tests"]).fields:
        if f.name not in have:
            out.append(F.lit(None if f.dataType.typeName() == "double" else "").cast(f.dataType).alias(f.name))
        elif f.dataType.typeName() == "double":
            out.append(to_double(F.col(f.name), have[f.name]).alias(f.name))
        else:
            out.append(F.coalesce(F.col(f.name).cast("string"), F.lit("")).alias(f.name))
    return results.select(*out)


def monthly_climate(climate: DataFrame) -> DataFrame:
    """One climate row per month and town, so a join cannot multiply facts."""
    measures = ["precipitacion_mensual_mm", "temperatura_media_c", "spi_3", "anomalia_termica_z"]
    return climate.groupBy("id_tiempo", "cod_municipio").agg(*[F.avg(m).alias(m) for m in measures])


# The analytic view: facts meet their dimensions, climate joins from the left.
VIEW_COLUMNS = """
SELECT t.anio, t.mes, t.trimestre, m.cod_municipio, m.nombre_municipio, m.nombre_departamento,
       p.nombre_producto, p.variedad,
       e.area_sembrada_ha, e.area_cosechada_ha, e.produccion_ton, e.rendimiento_ton_ha,
       {of}.precipitacion_mensual_mm, {of}.temperatura_media_c, {of}.spi_3, {of}.anomalia_termica_z
"""
# Monthly climate keeps the number of facts, so it joins before the names do: rows are still narrow when they move.
VIEW_SQL = VIEW_COLUMNS.format(of="e") + """
FROM (SELECT f.*, c.precipitacion_mensual_mm, c.temperatura_media_c, c.spi_3, c.anomalia_termica_z
      FROM fact_produccion_eva f LEFT JOIN clima_mensual c ON c.id_tiempo = f.id_tiempo AND c.cod_municipio = f.cod_municipio) e
JOIN dim_tiempo t USING (id_tiempo)
JOIN dim_producto p USING (id_producto)
JOIN dim_municipio m USING (cod_municipio)
"""
# Raw observations repeat the facts and join last.
COMPAT_VIEW_SQL = VIEW_COLUMNS.format(of="c") + """
FROM fact_produccion_eva e
JOIN dim_tiempo t USING (id_tiempo)
JOIN dim_municipio m USING (cod_municipio)
JOIN dim_producto p USING (id_producto)
LEFT JOIN fact_clima_ideam c ON c.id_tiempo = e.id_tiempo AND c.cod_municipio = e.cod_municipio
"""

OLAP_SQL = """
SELECT anio, nombre_municipio, nombre_producto, variedad,
       sum(produccion_ton) AS total_produccion_ton,
       avg(rendimiento_ton_ha) AS promedio_rendimiento_t_ha,
       avg(precipitacion_mensual_mm) AS promedio_precipitacion_mm
FROM view_indicadores_agroclimaticos
GROUP BY anio, nombre_municipio, nombre_producto, variedad
ORDER BY total_produccion_ton DESC, anio, nombre_municipio, nombre_producto, variedad
LIMIT :top
"""


def register_tables(tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def register(tables: dict[str, DataFrame], compat: bool = False) -> None:
    """Temp views for every table plus the analytic view.

    By default climate is averaged per month and town first; ``compat`` joins raw
    observations, which repeats a fact once per observation.
    """
    register_tables(tables)
    spark = next(iter(tables.values())).sparkSession
    if not compat:
        monthly_climate(tables["fact_clima_ideam"]).createOrReplaceTempView("clima_mensual")
    spark.sql(COMPAT_VIEW_SQL if compat else VIEW_SQL).createOrReplaceTempView(VIEW)


def execute_query(spark: SparkSession, sql: str, params: dict | None = None) -> DataFrame:
    """Parameterised SQL over the registered tables (``:name`` markers)."""
    return spark.sql(sql, args=params) if params else spark.sql(sql)


def top_production(spark: SparkSession, top: int = 10) -> DataFrame:
    return execute_query(spark, OLAP_SQL, {"top": top})


def update_where(df: DataFrame, condition: Column, values: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Keyed update as a rewrite: the new table and a one-row count of touched rows."""
    hit = F.coalesce(condition, F.lit(False))
    updated = df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})
    return updated, df.agg(F.count_if(hit).alias("affected_rows"))


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])
