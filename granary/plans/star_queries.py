"""Star schema built from orders, parts, suppliers and nations."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import star
from granary.plans.catalog import query
from granary.plans.cleaning_queries import WIDE, wide_prices
from granary.plans.hypothesis_queries import battery_sql, full_battery
from granary.plans.inputs import clean_sql, lineitem, r, rounded, telemetry, TELEMETRY
from granary.session import scratch_path, table, written
from granary.sources.files import state
from granary.sources.partitioned import PartitionedTable
from granary.sources.star_store import StarStore

CODE5 = "CASE WHEN length({0}) < 5 THEN lpad({0}, 5, '0') ELSE {0} END"


@query(
    "l01_calendar",
    """WITH y AS (SELECT min(year(l_shipdate)) AS a, max(year(l_shipdate)) AS b FROM lineitem), m AS (SELECT unnest(generate_series(a * 12, b * 12 + 11)) AS i FROM y)
SELECT CAST((i // 12) * 100 + i % 12 + 1 AS BIGINT) AS id_tiempo, CAST(i // 12 AS BIGINT) AS anio, CAST(i % 12 + 1 AS BIGINT) AS mes, CAST((i % 12) // 3 + 1 AS BIGINT) AS trimestre, CAST((i % 12) // 6 + 1 AS BIGINT) AS semestre FROM m""",
)
def calendar(spark, sf):
    edges = lineitem(spark, sf).agg(F.min(F.year("l_shipdate")), F.max(F.year("l_shipdate"))).first()
    dim = star.calendar(spark, edges[0], edges[1])
    # Loading twice changes nothing.
    return star.append_new(dim, star.calendar(spark, edges[0], edges[1]), "id_tiempo")


def towns(spark, sf):
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(
        F.col("s_suppkey").cast("string").alias("cod_municipio"),
        F.col("s_nationkey").cast("string").alias("cod_departamento"),
        F.concat(F.lit("Pueblo  "), F.col("s_name")).alias("nombre_municipio"),
        F.lower("n_name").alias("nombre_departamento"),
        F.col("s_suppkey").alias("orden"),
    )


TOWNS = f"""towns AS (SELECT {CODE5.format('CAST(s_suppkey AS VARCHAR)')} AS cod_municipio, lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS cod_departamento,
  {clean_sql("'Pueblo  ' || s_name")} AS nombre_municipio, upper(n_name) AS nombre_departamento, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


@query(
    "l02_upsert_towns",
    f"WITH {TOWNS} SELECT cod_municipio, cod_departamento, CASE WHEN s_suppkey % 3 = 0 THEN 'RENOMBRADO ' || s_suppkey ELSE nombre_municipio END AS nombre_municipio, nombre_departamento FROM towns",
)
def upsert_towns(spark, sf):
    first = towns(spark, sf)
    changed = first.filter("orden % 3 = 0").withColumn("nombre_municipio", F.concat(F.lit("Renombrado "), F.col("orden").cast("string")))
    empty = star.empty_table(spark, "dim_municipio")
    return star.upsert_towns(star.upsert_towns(empty, first, "orden"), changed, "orden")


def crop_facts_input(spark, sf):
    li, p = lineitem(spark, sf), table(spark, sf, "part")
    return li.join(p, li.l_partkey == p.p_partkey).select(
        "l_orderkey",
        F.year("l_shipdate").alias("anio"),
        F.col("l_suppkey").cast("string").alias("cod_municipio"),
        F.col("p_name").alias("cultivo"),
        F.when(F.col("l_linenumber") <= 2, F.lit(" ")).otherwise(F.col("p_brand")).alias("variedad"),
        F.col("p_type").alias("grupo_de_cultivo"),
        F.col("l_quantity").alias("area_sembrada_ha"),
        F.when(F.col("l_tax") > 0, F.col("l_quantity")).alias("area_cosechada_ha"),
        F.col("l_extendedprice").alias("produccion_ton"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("rendimiento_ton_ha"),
        "l_partkey",
    )


CROP = """crop AS (SELECT l_orderkey, l_partkey, year(l_shipdate) AS anio, CAST(l_suppkey AS VARCHAR) AS town, upper(p_name) AS nombre_producto,
  CASE WHEN l_linenumber <= 2 THEN 'SIN_VARIEDAD_ESPECIFICADA' ELSE upper(p_brand) END AS variedad, upper(p_type) AS grupo_cultivo, l_quantity, CASE WHEN l_tax > 0 THEN l_quantity ELSE 0.0 END AS cosechada, l_extendedprice
  FROM lineitem JOIN part ON l_partkey = p_partkey),
prod AS (SELECT nombre_producto, variedad, min(l_partkey) AS first_at, arg_min(grupo_cultivo, (l_partkey, grupo_cultivo)) AS grupo_cultivo FROM crop GROUP BY 1, 2),
dim AS (SELECT row_number() OVER (ORDER BY first_at, nombre_producto, variedad) AS id_producto, nombre_producto, grupo_cultivo, variedad FROM prod)"""


def products(spark, sf):
    return star.get_or_create_products(star.empty_table(spark, "dim_producto"), crop_facts_input(spark, sf), "l_partkey")


@query("l03_product_keys", f"WITH {CROP} SELECT * FROM dim")
def product_keys(spark, sf):
    # Asking again for known products adds nothing.
    return star.get_or_create_products(products(spark, sf), crop_facts_input(spark, sf), "l_partkey")


@query(
    "l04_input_keys",
    "SELECT * FROM (VALUES (1, 'UREA 46', 'FERTILIZANTES'), (2, 'DAP 18 46', 'FERTILIZANTES'), (3, 'MAIZ AMARILLO', 'INSUMOS')) t(id_insumo, nombre_insumo, categoria_insumo) WHERE EXISTS (SELECT 1 FROM orders)",
)
def input_keys(spark, sf):
    names = star.input_names(wide_prices(spark, sf))
    used = star.melt_prices(wide_prices(spark, sf)).select("insumo").distinct()
    return star.get_or_create_inputs(star.empty_table(spark, "dim_insumo"), names.join(used, "insumo", "left_semi"))


FACT = f"""fact AS (SELECT CAST(anio * 100 + 12 AS BIGINT) AS id_tiempo, {CODE5.format('town')} AS cod_municipio, id_producto, l_quantity AS area_sembrada_ha,
  cosechada AS area_cosechada_ha, l_extendedprice AS produccion_ton, l_extendedprice / l_quantity AS rendimiento_ton_ha FROM crop JOIN dim USING (nombre_producto, variedad))"""


@query("l05_fact_crops", f"WITH {CROP}, {FACT} SELECT * FROM fact")
def fact_crops(spark, sf):
    return star.fact_crops(crop_facts_input(spark, sf), products(spark, sf))


@query(
    "l06_fact_prices",
    f"WITH {WIDE} SELECT id_tiempo, cod_municipio, CASE insumo WHEN 'urea_46' THEN 1 WHEN 'dap_18_46' THEN 2 ELSE 3 END AS id_insumo, {r('precio', 4)} AS precio_promedio FROM long",
)
def fact_prices(spark, sf):
    wide = wide_prices(spark, sf)
    inputs = star.get_or_create_inputs(star.empty_table(spark, "dim_insumo"), star.input_names(wide))
    return star.fact_prices(wide, inputs).withColumn("precio_promedio", rounded("precio_promedio", 4))


def climate_input(spark, sf):
    return telemetry(spark, sf).select(
        F.col("codigoestacion").alias("codigo_estacion"),
        F.col("fechaobservacion").alias("fecha_observacion"),
        F.col("valorobservado").alias("valor_observado"),
        F.col("descripcionsensor").alias("sensor_descripcion"),
        F.col("codigoestacion").alias("cod_municipio"),
    )


CLIMA = f"""{TELEMETRY}, clima AS (SELECT CAST(year(fechaobservacion) * 100 + month(fechaobservacion) AS BIGINT) AS id_tiempo, {CODE5.format('codigoestacion')} AS cod_municipio, codigoestacion AS codigo_estacion,
  CASE WHEN regexp_matches(upper(descripcionsensor), 'PRECIP|PLUV') THEN valorobservado END AS precipitacion_mensual_mm,
  CASE WHEN contains(upper(descripcionsensor), 'TEMP') THEN valorobservado END AS temperatura_media_c FROM telemetry)"""


@query("l07_fact_climate", f"WITH {CLIMA} SELECT *, CAST(NULL AS DOUBLE) AS spi_3, CAST(NULL AS DOUBLE) AS anomalia_termica_z FROM clima")
def fact_climate(spark, sf):
    return star.fact_climate(climate_input(spark, sf))


@query("l08_hypothesis_mart", battery_sql())
def hypothesis_mart(spark, sf):
    """The battery's results in the layout of the mart."""
    return star.mart_rows(full_battery(spark, sf))


def star_tables(spark, sf, dim_product=None):
    """All tables of the schema, climate on December so that facts meet it."""
    crops = crop_facts_input(spark, sf)
    dim_product = products(spark, sf) if dim_product is None else dim_product
    wide = wide_prices(spark, sf)
    inputs = star.get_or_create_inputs(star.empty_table(spark, "dim_insumo"), star.input_names(wide))
    rain = lineitem(spark, sf).select(
        F.col("l_suppkey").cast("string").alias("cod_municipio"),
        F.make_date(F.year("l_shipdate"), F.lit(12), F.lit(1)).alias("fecha"),
        F.col("l_quantity").alias("valor_observado"),
        F.when(F.col("l_linenumber") <= 3, F.lit("Precipitación")).otherwise(F.lit("Temperatura")).alias("sensor_descripcion"),
    )
    return {
        "dim_tiempo": star.calendar(spark, 1990, 2030),
        "dim_municipio": star.upsert_towns(star.empty_table(spark, "dim_municipio"), towns(spark, sf), "orden"),
        "dim_producto": dim_product,
        "dim_insumo": inputs,
        "fact_produccion_eva": star.fact_crops(crops, dim_product),
        "fact_precios_sipsa": star.fact_prices(wide, inputs),
        "fact_clima_ideam": star.fact_climate(rain),
        "mart_hypothesis_tests": star.empty_table(spark, "mart_hypothesis_tests"),
    }


#: What the analytic view reads.
VIEW_TABLES = ("dim_tiempo", "dim_municipio", "dim_producto", "fact_produccion_eva", "fact_clima_ideam")
_LOADED: dict[tuple, tuple[StarStore, set[str]]] = {}


def stored_star(spark, sf, wanted=VIEW_TABLES):
    """The wanted tables of the stored schema, each loaded when first asked for, and again whenever the files of ``sf`` have changed."""
    key = (spark.sparkContext.applicationId, sf, state(spark, sf))
    store, have = _LOADED.setdefault(key, (StarStore(spark, scratch_path(spark, "star")), set()))
    # Facts refer to the products as they are stored, so those come first.
    for name in ("dim_producto", *[n for n in wanted if n != "dim_producto"]):
        if name not in have:
            store.load(name, products(spark, sf) if name == "dim_producto" else star_tables(spark, sf, store.table("dim_producto"))[name])
            have.add(name)
    return {name: store.table(name) for name in wanted}


STAR = f"""{CROP}, {FACT}, {TOWNS},
rain AS (SELECT CAST(year(l_shipdate) * 100 + 12 AS BIGINT) AS id_tiempo, {CODE5.format('CAST(l_suppkey AS VARCHAR)')} AS cod_municipio,
  CASE WHEN l_linenumber <= 3 THEN l_quantity END AS pp, CASE WHEN l_linenumber > 3 THEN l_quantity END AS tt FROM lineitem),
clim AS (SELECT id_tiempo, cod_municipio, avg(pp) AS precipitacion_mensual_mm, avg(tt) AS temperatura_media_c FROM rain GROUP BY 1, 2),
vista AS (SELECT id_tiempo // 100 AS anio, id_tiempo % 100 AS mes, 4 AS trimestre, cod_municipio, nombre_municipio, nombre_departamento, nombre_producto, variedad,
  area_sembrada_ha, area_cosechada_ha, produccion_ton, rendimiento_ton_ha, precipitacion_mensual_mm, temperatura_media_c
  FROM fact JOIN towns USING (cod_municipio) JOIN dim USING (id_producto) LEFT JOIN clim USING (id_tiempo, cod_municipio))"""


@query(
    "j03_star_view",
    f"WITH {STAR} SELECT anio, mes, trimestre, nombre_departamento, count(*) AS filas, {r('sum(area_sembrada_ha)', 2)} AS sembrada, {r('avg(precipitacion_mensual_mm)', 5)} AS lluvia, {r('avg(temperatura_media_c)', 5)} AS temperatura FROM vista GROUP BY 1, 2, 3, 4",
)
def star_view(spark, sf):
    star.register(stored_star(spark, sf))
    view = star.execute_query(spark, f"SELECT * FROM {star.VIEW}")
    return view.groupBy("anio", "mes", "trimestre", "nombre_departamento").agg(
        F.count(F.lit(1)).alias("filas"),
        rounded(F.sum("area_sembrada_ha"), 2).alias("sembrada"),
        rounded(F.avg("precipitacion_mensual_mm"), 5).alias("lluvia"),
        rounded(F.avg("temperatura_media_c"), 5).alias("temperatura"),
    )


@query(
    "j03_star_view_compat",
    f"WITH {STAR} SELECT f.id_tiempo // 100 AS anio, CAST(sum(copias) AS BIGINT) AS filas FROM fact f JOIN towns USING (cod_municipio) JOIN (SELECT id_tiempo, cod_municipio, count(*) AS copias FROM rain GROUP BY 1, 2) USING (id_tiempo, cod_municipio) GROUP BY 1",
)
def star_view_compat(spark, sf):
    star.register(stored_star(spark, sf), compat=True)
    return spark.table(star.VIEW).groupBy("anio").agg(F.count(F.lit(1)).alias("filas"))


@query(
    "q01_olap_top10",
    f"""WITH {STAR} SELECT anio, nombre_municipio, nombre_producto, variedad, {r('sum(produccion_ton)', 2)} AS total_produccion_ton, {r('avg(rendimiento_ton_ha)', 4)} AS promedio_rendimiento_t_ha, {r('avg(precipitacion_mensual_mm)', 4)} AS promedio_precipitacion_mm
FROM vista GROUP BY 1, 2, 3, 4 ORDER BY sum(produccion_ton) DESC, anio, nombre_municipio, nombre_producto, variedad LIMIT 10""",
)
def olap_top10(spark, sf):
    star.register(stored_star(spark, sf))
    out = star.top_production(spark, 10)
    return out.withColumns(
        {"total_produccion_ton": rounded("total_produccion_ton", 2), "promedio_rendimiento_t_ha": rounded("promedio_rendimiento_t_ha", 4), "promedio_precipitacion_mm": rounded("promedio_precipitacion_mm", 4)}
    )


@query("o02_order_desc_limit", f"WITH {STAR} SELECT nombre_municipio, {r('sum(produccion_ton)', 2)} AS total FROM vista GROUP BY 1 ORDER BY sum(produccion_ton) DESC, nombre_municipio LIMIT 10")
def order_desc_limit(spark, sf):
    star.register(stored_star(spark, sf))
    top = spark.table(star.VIEW).groupBy("nombre_municipio").agg(F.sum("produccion_ton").alias("total"))
    return top.orderBy(F.col("total").desc(), "nombre_municipio").limit(10).withColumn("total", rounded("total", 2))


@query(
    "q02_select_view",
    f"WITH {STAR} SELECT anio, mes, trimestre, cod_municipio, nombre_municipio, nombre_departamento, nombre_producto, variedad, area_sembrada_ha, area_cosechada_ha, produccion_ton, rendimiento_ton_ha, {r('precipitacion_mensual_mm', 5)} AS precipitacion_mensual_mm, {r('temperatura_media_c', 5)} AS temperatura_media_c, CAST(NULL AS DOUBLE) AS spi_3, CAST(NULL AS DOUBLE) AS anomalia_termica_z FROM vista",
)
def select_view(spark, sf):
    star.register(stored_star(spark, sf))
    return spark.table(star.VIEW).withColumns({c: rounded(c, 5) for c in ("precipitacion_mensual_mm", "temperatura_media_c")})


@query("q03_parameterised_sql", f"WITH {CROP}, {FACT} SELECT id_tiempo, count(*) AS filas FROM fact WHERE id_tiempo >= 199712 AND area_sembrada_ha > 10.5 GROUP BY 1")
def parameterised_sql(spark, sf):
    star.register_tables(stored_star(spark, sf, ["fact_produccion_eva"]))
    return star.execute_query(
        spark,
        "SELECT id_tiempo, count(*) AS filas FROM fact_produccion_eva WHERE id_tiempo >= :desde AND area_sembrada_ha > :minimo GROUP BY id_tiempo",
        {"desde": 199712, "minimo": 10.5},
    )


@query(
    "l09_schema_tables",
    f"WITH {CROP}, {FACT}, {TOWNS}, {WIDE} SELECT 'fact_precios_sipsa' AS tabla, count(*) AS filas FROM long UNION ALL SELECT 'fact_produccion_eva' AS tabla, count(*) AS filas FROM fact UNION ALL SELECT 'dim_producto', count(*) FROM dim UNION ALL SELECT 'dim_municipio', count(*) FROM towns UNION ALL SELECT 'dim_tiempo', 41 * 12 UNION ALL SELECT 'fact_clima_ideam', count(*) FROM lineitem UNION ALL SELECT 'dim_insumo', 3 UNION ALL SELECT 'mart_hypothesis_tests', 0",
)
def schema_tables(spark, sf):
    """The schema is stored, its prices loaded twice, initialised again without losing or doubling rows, and read back."""
    store = StarStore(spark, scratch_path(spark, "star"))
    store.initialize()
    tables = star_tables(spark, sf)
    for name in [*tables, "fact_precios_sipsa"]:
        store.load(name, tables[name])
    store.initialize()
    counts = [
        store.table(n).agg(F.count(F.lit(1)).alias("filas")).select(F.lit(n).alias("tabla"), "filas")
        for n in star.SCHEMAS
    ]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query("l10_keyed_update", f"SELECT c_custkey, CASE WHEN c_custkey % 10 = 3 THEN 'ACTUALIZADO' ELSE c_mktsegment END AS c_mktsegment, (SELECT count(*) FROM customer WHERE c_custkey % 10 = 3) AS affected_rows FROM customer")
def keyed_update(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    updated, affected = star.update_where(c, F.col("c_custkey") % 10 == 3, {"c_mktsegment": F.lit("ACTUALIZADO")})
    return updated.join(affected, on=F.lit(True), how="left")


@query(
    "l10_partition_update",
    """SELECT year(o_orderdate) AS anio, count(*) AS filas, count(*) FILTER (o_orderstatus = 'P' AND o_orderdate >= DATE '1995-01-01') AS cambiadas,
  count(*) FILTER (o_orderstatus = 'P' AND o_orderdate >= DATE '1995-01-01') > 0 AS reescrita FROM orders GROUP BY 1""",
)
def partition_update(spark, sf):
    """An update in place: years without a touched order keep their files, though all years are loaded twice."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate", F.year("o_orderdate").alias("anio"))
    stored = PartitionedTable(spark, scratch_path(spark, "orders"), "o_orderkey bigint, o_orderstatus string, o_orderdate date, anio int", "anio")
    stored.load(o)
    stored.load(o)
    files = lambda: stored.read().select("anio", F.col("_metadata.file_path").alias("f"), "o_orderstatus").groupBy("anio").agg(
        F.count(F.lit(1)).alias("filas"), F.count_if(F.col("o_orderstatus") == "X").alias("cambiadas"), F.sort_array(F.collect_set("f")).alias("files")
    )
    before = written(files().select("anio", F.col("files").alias("old")), "files")
    stored.update((F.col("o_orderstatus") == "P") & (F.col("o_orderdate") >= F.lit("1995-01-01").cast("date")), {"o_orderstatus": F.lit("X")})
    return files().join(before, "anio").select("anio", "filas", "cambiadas", (F.col("files") != F.col("old")).alias("reescrita"))
