"""Projection, casting, filling, deduplication and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import casting, labels, stats, text
from granary.functions.nulls import safe_divide
from granary.operators import cleaning
from granary.plans.catalog import query
from granary.plans.inputs import (
    CROPS,
    TELEMETRY,
    clean_sql,
    crops,
    jaro_winkler_cte,
    lineitem,
    monthly_prices,
    month,
    phi,
    PRICES,
    quantile_sql,
    r,
    rounded,
    telemetry,
)
from granary.session import table

VARIETY = f"CASE WHEN {clean_sql('variedad_raw')} IN ('', 'NAN', 'NONE') THEN 'SIN_VARIEDAD_ESPECIFICADA' ELSE {clean_sql('variedad_raw')} END"


@query(
    "p01_rename_columns",
    "SELECT CAST(o_orderkey AS VARCHAR) AS codigo_estacion, CAST(o_custkey AS VARCHAR) AS nombre_estacion, o_totalprice AS valor_observado FROM orders",
)
def rename_columns(spark, sf):
    raw = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("codigoestacion"),
        F.col("o_custkey").cast("string").alias("nombreestacion"),
        F.col("o_totalprice").alias("valorobservado"),
    )
    return cleaning.rename_present(raw, cleaning.STATION_RENAMES)


@query(
    "p02_safe_cast",
    """SELECT l_orderkey, l_linenumber,
       CASE WHEN l_tax = 0.08 THEN 0 ELSE CAST(trunc(l_extendedprice) AS BIGINT) END AS entero,
       CASE WHEN l_tax = 0.07 THEN NULL ELSE l_extendedprice END AS flotante,
       CASE WHEN l_linenumber = 3 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS fecha,
       CAST(l_quantity AS VARCHAR) AS categoria
       FROM lineitem""",
)
def safe_cast(spark, sf):
    raw = lineitem(spark, sf).select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_tax") == 0.08, F.lit("invalid")).otherwise(F.col("l_extendedprice").cast("string")).alias("entero"),
        F.when(F.col("l_tax") == 0.07, F.lit("1.5d")).otherwise(F.col("l_extendedprice").cast("string")).alias("flotante"),
        F.when(F.col("l_linenumber") == 3, F.lit("ayer")).otherwise(F.col("l_shipdate").cast("string")).alias("fecha"),
        F.col("l_quantity").alias("categoria"),
    )
    out = cleaning.cast_datatypes(
        raw, {"entero": "int64", "flotante": "float64", "fecha": "datetime64[ns]", "categoria": "category", "nope": "string"}
    )
    return out.withColumn("fecha", F.col("fecha").cast("date"))


@query(
    "p03_fill_missing",
    """SELECT l_orderkey, l_linenumber,
       CASE WHEN l_linenumber IN (1, 2, 3, 4) THEN 'SIN_VARIEDAD_ESPECIFICADA' ELSE l_returnflag END AS variedad,
       CASE WHEN l_tax = 0.0 THEN -1.0 ELSE l_tax END AS impuesto
       FROM lineitem""",
)
def fill_missing(spark, sf):
    n = F.col("l_linenumber")
    raw = lineitem(spark, sf).select(
        "l_orderkey",
        "l_linenumber",
        F.when(n == 1, F.lit(None)).when(n == 2, "   ").when(n == 3, "NAN").when(n == 4, "NONE").otherwise(F.col("l_returnflag")).alias("variedad"),
        F.when(F.col("l_tax") != 0.0, F.col("l_tax")).alias("impuesto"),
    )
    return cleaning.fill_missing(raw, ["variedad"], numeric_fill=-1.0)


EVA_SQL = f"""WITH {CROPS}, c AS (
  SELECT c_d_dep AS cod_departamento, c_d_mun AS cod_municipio, {clean_sql('departamento')} AS departamento,
         {clean_sql('cultivo')} AS cultivo, {VARIETY} AS variedad, {clean_sql('grupo_de_cultivo')} AS grupo_de_cultivo,
         CAST(anio AS BIGINT) AS anio, sembrada AS area_sembrada_ha, cosechada AS area_cosechada_ha,
         produccion AS produccion_ton, rendimiento AS rendimiento_ton_ha FROM crops),
k AS (SELECT *, row_number() OVER (PARTITION BY cod_municipio, anio, cultivo, variedad ORDER BY
        cod_departamento NULLS LAST, departamento NULLS LAST, grupo_de_cultivo NULLS LAST, area_sembrada_ha NULLS LAST,
        area_cosechada_ha NULLS LAST, produccion_ton NULLS LAST, rendimiento_ton_ha NULLS LAST) AS rn FROM c)"""


@query(
    "p04_clean_crops",
    EVA_SQL
    + " SELECT * EXCLUDE (rn) FROM k WHERE rn = 1",
)
def clean_crops(spark, sf):
    return cleaning.clean(crops(spark, sf), "eva")


@query(
    "p05_clean_stations",
    f"""WITH {TELEMETRY}, c AS (
  SELECT codigoestacion AS codigo_estacion, fechaobservacion AS fecha_observacion, valorobservado AS valor_observado,
         {clean_sql('descripcionsensor')} AS sensor_descripcion FROM telemetry)
SELECT codigo_estacion, strftime(fecha_observacion, '%Y-%m-%d %H') AS hora, sensor_descripcion, min(valor_observado) AS valor_observado
FROM c GROUP BY ALL""",
)
def clean_stations(spark, sf):
    out = cleaning.clean(telemetry(spark, sf), "ideam")
    return out.select(
        "codigo_estacion", F.date_format("fecha_observacion", "yyyy-MM-dd HH").alias("hora"), "sensor_descripcion", "valor_observado"
    )


@query(
    "p06_clean_prices",
    f"""WITH c AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS cod_municipio, {clean_sql("' Artículo ' || l_returnflag")} AS articulo,
         CAST(year(l_shipdate) AS BIGINT) AS anio, CAST(month(l_shipdate) AS BIGINT) AS mes, l_extendedprice AS p FROM lineitem)
SELECT cod_municipio, articulo, anio, mes, {r('min(p)', 2)} AS precio_promedio FROM c GROUP BY ALL""",
)
def clean_prices(spark, sf):
    raw = lineitem(spark, sf).select(
        F.col("l_suppkey").cast("string").alias("cod_municipio"),
        F.concat(F.lit(" Artículo "), F.col("l_returnflag")).alias("articulo"),
        F.col("l_extendedprice").cast("string").alias("preciopromedio"),
        F.year("l_shipdate").cast("string").alias("anio"),
        F.month("l_shipdate").cast("string").alias("mes"),
    )
    return cleaning.clean(raw, "sipsa").withColumn("precio_promedio", rounded("precio_promedio", 2))


@query(
    "p07_clean_trade",
    f"""WITH c AS (
  SELECT CAST(year(l_shipdate) AS BIGINT) AS anio, CAST(month(l_shipdate) AS VARCHAR) AS mes,
         CAST(l_suppkey AS VARCHAR) AS cod_departamento, {clean_sql("'Café ' || l_returnflag")} AS producto,
         {clean_sql("l_linestatus")} AS partida, l_extendedprice AS valor_usd, l_quantity AS volumen_kg FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY anio, mes, cod_departamento, producto, partida ORDER BY valor_usd, volumen_kg) AS rn FROM c)
SELECT * EXCLUDE (rn) FROM k WHERE rn = 1""",
)
def clean_trade(spark, sf):
    raw = lineitem(spark, sf).select(
        F.year("l_shipdate").cast("string").alias("a_o"),
        F.month("l_shipdate").cast("string").alias("mes"),
        F.col("l_suppkey").cast("string").alias("cod_depto"),
        F.concat(F.lit("Café "), F.col("l_returnflag")).alias("producto"),
        F.col("l_linestatus").alias("partida"),
        F.col("l_extendedprice").cast("string").alias("exportaciones_en_valor_usd"),
        F.col("l_quantity").cast("string").alias("exportaciones_en_volumen"),
    )
    return cleaning.clean(raw, "exportaciones")


@query(
    "p08_clean_generic",
    f"SELECT DISTINCT {clean_sql('role')} AS role, {clean_sql('text')} AS text FROM conversations",
)
def clean_generic(spark, sf):
    return cleaning.clean(table(spark, sf, "conversations").select("role", "text"), "generic")


@query(
    "p09_calendar_columns",
    "SELECT o_orderkey, year(o_orderdate) AS anio, month(o_orderdate) AS mes, '11001' AS cod_municipio FROM orders",
)
def calendar_columns(spark, sf):
    return cleaning.add_calendar(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", cod_municipio="11001").drop(
        "o_orderdate"
    )


def wide_prices(spark, sf):
    """Order-level wide price table with zero and missing cells."""
    o = table(spark, sf, "orders")
    return o.select(
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit("sin fecha")).otherwise(F.col("o_orderdate").cast("date").cast("string")).alias("fecha"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("urea_46"),
        F.when(F.col("o_orderstatus") == "O", F.lit(0.0)).otherwise(F.col("o_totalprice") / 2).alias("dap_18_46"),
        F.col("o_custkey").cast("string").alias("maiz_amarillo"),
    )


WIDE = """wide AS (
  SELECT CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE year(o_orderdate) * 100 + month(o_orderdate) END AS id_tiempo,
         CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS urea_46,
         CASE WHEN o_orderstatus = 'O' THEN 0.0 ELSE o_totalprice / 2 END AS dap_18_46,
         CAST(o_custkey AS DOUBLE) AS maiz_amarillo FROM orders),
melted AS (
  SELECT id_tiempo, 'urea_46' AS insumo, urea_46 AS precio FROM wide UNION ALL
  SELECT id_tiempo, 'dap_18_46', dap_18_46 FROM wide UNION ALL
  SELECT id_tiempo, 'maiz_amarillo', maiz_amarillo FROM wide),
long AS (SELECT CAST(id_tiempo AS BIGINT) AS id_tiempo, '11001' AS cod_municipio, insumo, precio FROM melted WHERE id_tiempo IS NOT NULL AND precio > 0)"""


@query("p10_melt_prices", f"WITH {WIDE} SELECT id_tiempo, cod_municipio, insumo, {r('precio', 4)} AS precio FROM long")
def melt(spark, sf):
    return cleaning.melt_prices(wide_prices(spark, sf)).withColumn("precio", rounded("precio", 4))


@query(
    "p11_split_sensor",
    f"""WITH {TELEMETRY}
SELECT codigoestacion, valorobservado, upper(descripcionsensor) AS sensor,
  CASE WHEN regexp_matches(upper(descripcionsensor), 'PRECIP|PLUV') THEN coalesce(valorobservado, 0.0) END AS precipitacion,
  CASE WHEN contains(upper(descripcionsensor), 'TEMP') THEN coalesce(valorobservado, 0.0) END AS temperatura FROM telemetry""",
)
def split_sensor(spark, sf):
    raw = telemetry(spark, sf)
    rain, heat = cleaning.split_sensor(F.col("descripcionsensor"), F.col("valorobservado"))
    return raw.select(
        "codigoestacion", "valorobservado", F.upper("descripcionsensor").alias("sensor"), rain.alias("precipitacion"), heat.alias("temperatura")
    )


@query(
    "p12_zero_fill",
    """SELECT o_orderkey,
  CASE WHEN length(CAST(o_orderkey * 37 AS VARCHAR)) < 5 THEN lpad(CAST(o_orderkey * 37 AS VARCHAR), 5, '0') ELSE CAST(o_orderkey * 37 AS VARCHAR) END AS cod5,
  CASE WHEN length(CAST(o_custkey AS VARCHAR)) < 2 THEN lpad(CAST(o_custkey AS VARCHAR), 2, '0') ELSE CAST(o_custkey AS VARCHAR) END AS cod2
FROM orders""",
)
def zero_fill(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", text.zero_fill(F.col("o_orderkey") * 37, 5).alias("cod5"), text.zero_fill(F.col("o_custkey"), 2).alias("cod2")
    )


@query(
    "p13_input_category",
    "SELECT p_partkey, CASE WHEN regexp_matches(nombre, 'fertilizante|urea|dap|kcl|sam') THEN 'Fertilizantes' ELSE 'Insumos' END AS categoria FROM (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'urea_' ELSE 'Urea_' END || p_name AS nombre FROM part)",
)
def input_category(spark, sf):
    named = table(spark, sf, "part").select(
        "p_partkey", F.concat(F.when(F.col("p_size") % 3 == 0, "urea_").otherwise("Urea_"), F.col("p_name")).alias("nombre")
    )
    return named.select("p_partkey", cleaning.input_category(F.col("nombre")).alias("categoria"))


@query(
    "p14_label_from_name",
    "SELECT DISTINCT upper(trim(regexp_replace(replace(p_name || '_46', '_', ' '), '\\s+', ' ', 'g'))) AS etiqueta FROM part",
)
def label_from_name(spark, sf):
    named = table(spark, sf, "part").select(F.concat("p_name", F.lit("_46")).alias("n"))
    return named.select(text.sanitize_text(F.replace(F.col("n"), F.lit("_"), F.lit(" "))).alias("etiqueta")).distinct()


LINE_ORDER = ", ".join(
    f"{c} NULLS LAST"
    for c in "l_partkey l_suppkey l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()
)


@query(
    "d01_deduplicate",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, CAST(l_shipdate AS DATE) AS fecha FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC NULLS LAST, {LINE_ORDER}) AS rn FROM lineitem) WHERE rn = 1""",
)
def deduplicate(spark, sf):
    out = cleaning.deduplicate(lineitem(spark, sf), ["l_orderkey", "l_linenumber"], "l_shipdate")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.col("l_shipdate").cast("date").alias("fecha"))


@query("d02_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber, l_discount FROM lineitem")
def distinct(spark, sf):
    return cleaning.deduplicate(lineitem(spark, sf).select("l_returnflag", "l_linestatus", "l_linenumber", "l_discount"), ["absent"])


@query("f01_sanitize_text", f"SELECT doc_id, {clean_sql('text')} AS limpio FROM documents")
def sanitize(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.sanitize_text(F.col("text")).alias("limpio"))


NAME_PAIRS = "pairs AS (SELECT DISTINCT a.p_name AS a, b.n_name AS b FROM part a JOIN nation b ON a.p_partkey % 25 = b.n_nationkey)"


def name_pairs(spark, sf):
    part, nation = table(spark, sf, "part"), table(spark, sf, "nation")
    return part.join(nation, part.p_partkey % 25 == nation.n_nationkey).select(
        F.col("p_name").alias("a"), F.col("n_name").alias("b")
    ).distinct()


@query("f02_levenshtein", f"WITH {NAME_PAIRS} SELECT a, b, levenshtein(a, lower(b)) AS distancia FROM pairs")
def levenshtein(spark, sf):
    return name_pairs(spark, sf).select("a", "b", F.levenshtein("a", F.lower("b")).cast("bigint").alias("distancia"))


@query(
    "f03_levenshtein_similarity",
    f"WITH {NAME_PAIRS} SELECT a, b, {r('1.0 - levenshtein(a, lower(b)) / CAST(greatest(length(a), length(b)) AS DOUBLE)', 6)} AS similitud FROM pairs",
)
def levenshtein_similarity(spark, sf):
    return name_pairs(spark, sf).select("a", "b", rounded(text.levenshtein_similarity(F.col("a"), F.lower("b")), 6).alias("similitud"))


@query(
    "f04_jaro_winkler",
    f"""WITH RECURSIVE typos AS (SELECT DISTINCT p_name AS a, substr(p_name, 1, 1 + p_partkey % 6) || substr(p_name, 3 + p_partkey % 6) AS b FROM part),
{jaro_winkler_cte('typos')} SELECT a, b, {r('jw', 6)} AS similitud FROM jw""",
)
def jaro_winkler(spark, sf):
    k = (F.col("p_partkey") % 6).cast("int")
    typos = table(spark, sf, "part").select(
        F.col("p_name").alias("a"),
        F.concat(F.substring("p_name", F.lit(1), 1 + k), F.substring("p_name", 3 + k, F.lit(100))).alias("b"),
    ).distinct()
    return typos.select("a", "b", rounded(text.jaro_winkler(F.col("a"), F.col("b")), 6).alias("similitud"))


@query("f05_normal_cdf", f"SELECT event_id, {r(phi('(value - 50) / 25'), 6)} AS prob FROM events")
def normal_cdf(spark, sf):
    return table(spark, sf, "events").select("event_id", rounded(stats.norm_cdf((F.col("value") - 50) / 25), 6).alias("prob"))


@query("f06_chi2_tail", f"SELECT event_id, {r('CASE WHEN value - 1 <= 0 THEN 1.0 ELSE exp(-0.5 * (value - 1)) END', 6)} AS prob FROM events")
def chi2_tail(spark, sf):
    return table(spark, sf, "events").select("event_id", rounded(stats.chi2_tail_2df(F.col("value") - 1), 6).alias("prob"))


@query(
    "f07_normal_quantile",
    f"SELECT c_custkey, CASE WHEN p <= 0 THEN -3.5 WHEN p >= 1 THEN 3.5 ELSE {r(quantile_sql('p'), 6)} END AS z FROM (SELECT c_custkey, (c_custkey % 1001) / 1000.0 AS p FROM customer) WHERE p > 0 AND p < 1 UNION ALL SELECT c_custkey, CASE WHEN (c_custkey % 1001) = 0 THEN -3.5 ELSE 3.5 END FROM customer WHERE (c_custkey % 1001) IN (0, 1000)",
)
def normal_quantile(spark, sf):
    p = (F.col("c_custkey") % 1001) / 1000.0
    return table(spark, sf, "customer").select("c_custkey", rounded(stats.norm_quantile(p), 6).alias("z"))


GAMMA_Z = "((pow(value / 50.0, 1.0/3.0) - (1 - 1/(9*2.0))) / sqrt(1/(9*2.0)))"


@query("f08_gamma_cdf", f"SELECT event_id, CASE WHEN value <= 0 THEN 0.0 ELSE {r(f'greatest(0.0, least(1.0, {phi(GAMMA_Z)}))', 6)} END AS prob FROM events")
def gamma_cdf(spark, sf):
    return table(spark, sf, "events").select("event_id", rounded(stats.gamma_cdf(F.col("value"), F.lit(2.0), F.lit(25.0)), 6).alias("prob"))


@query("f09_clip", "SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE greatest(-3.5, least(3.5, value / 10 - 4)) END AS z FROM events")
def clip(spark, sf):
    v = F.when(F.col("event_type") != "error", F.col("value") / 10 - 4)
    return table(spark, sf, "events").select("event_id", stats.clip(v, -3.5, 3.5).alias("z"))


SPI_CASE = """CASE WHEN v IS NULL THEN 'DATOS_INSUFICIENTES' WHEN v <= -2 THEN 'SEQUIA_EXTREMA' WHEN v <= -1.5 THEN 'SEQUIA_SEVERA'
 WHEN v <= -1 THEN 'SEQUIA_MODERADA' WHEN v >= 2 THEN 'HUMEDAD_EXTREMA' WHEN v >= 1.5 THEN 'HUMEDAD_SEVERA'
 WHEN v >= 1 THEN 'HUMEDAD_MODERADA' ELSE 'NORMAL_CLIMATICO' END"""
THERMAL_CASE = """CASE WHEN v IS NULL THEN 'DATOS_INSUFICIENTES' WHEN v >= 2 THEN 'ALERTA_CALOR_CRITICA' WHEN v >= 1 THEN 'ANOMALIA_CALIDA_MODERADA'
 WHEN v <= -2 THEN 'ALERTA_FRIO_CRITICA' WHEN v <= -1 THEN 'ANOMALIA_FRIA_MODERADA' ELSE 'TEMPERATURA_ESTABLE' END"""
INFLATION_CASE = """CASE WHEN v IS NULL THEN 'DATOS_INSUFICIENTES' WHEN v >= 25 THEN 'ESTRES_COSTOS_CRITICO' WHEN v >= 12 THEN 'ESTRES_COSTOS_MODERADO'
 WHEN v < 0 THEN 'DEFLACION_INSUMOS' ELSE 'ESTRUCTURA_COSTOS_ESTABLE' END"""


@query("f10_classify_spi", f"SELECT c_custkey, {SPI_CASE} AS clase FROM (SELECT c_custkey, CASE WHEN c_custkey % 13 <> 0 THEN (c_custkey % 61) / 10.0 - 3 END AS v FROM customer)")
def classify_spi(spark, sf):
    v = F.when(F.col("c_custkey") % 13 != 0, (F.col("c_custkey") % 61) / 10.0 - 3)
    return table(spark, sf, "customer").select("c_custkey", labels.classify_spi(v).alias("clase"))


@query("f11_classify_thermal", f"SELECT c_custkey, {THERMAL_CASE} AS clase FROM (SELECT c_custkey, CASE WHEN c_custkey % 13 <> 0 THEN (c_custkey % 61) / 10.0 - 3 END AS v FROM customer)")
def classify_thermal(spark, sf):
    v = F.when(F.col("c_custkey") % 13 != 0, (F.col("c_custkey") % 61) / 10.0 - 3)
    return table(spark, sf, "customer").select("c_custkey", labels.classify_thermal(v).alias("clase"))


@query("f12_classify_inflation", f"SELECT c_custkey, {INFLATION_CASE} AS clase FROM (SELECT c_custkey, CASE WHEN c_custkey % 13 <> 0 THEN (c_custkey % 61) - 20.0 END AS v FROM customer)")
def classify_inflation(spark, sf):
    v = F.when(F.col("c_custkey") % 13 != 0, (F.col("c_custkey") % 61) - 20.0)
    return table(spark, sf, "customer").select("c_custkey", labels.classify_inflation(v).alias("clase"))


@query("f13_to_number", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k, CAST(NULL AS DOUBLE) AS malo FROM events")
def to_number(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select(
        "event_id",
        casting.to_double(F.get_json_object("props", "$.k")).alias("k"),
        casting.to_double(F.concat(F.col("value").cast("string"), F.lit("d"))).alias("malo"),
    )


@query("f14_to_date", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS fecha, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE year(o_orderdate) END AS anio, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE month(o_orderdate) END AS mes FROM orders")
def to_date(spark, sf):
    raw = F.when(F.col("o_orderstatus") == "P", F.lit("2024-13-45")).otherwise(F.col("o_orderdate").cast("string"))
    day = casting.to_day(raw)
    return table(spark, sf, "orders").select("o_orderkey", day.alias("fecha"), F.year(day).alias("anio"), F.month(day).alias("mes"))


@query("f15_quarter_semester", "SELECT o_orderkey, CAST((month(o_orderdate) - 1) // 3 + 1 AS INTEGER) AS trimestre, CAST((month(o_orderdate) - 1) // 6 + 1 AS INTEGER) AS semestre FROM orders")
def quarter_semester(spark, sf):
    m = F.month("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", casting.quarter_of(m).alias("trimestre"), casting.semester_of(m).alias("semestre"))


@query("f16_safe_divide", f"SELECT l_orderkey, l_linenumber, {r('l_extendedprice / nullif(l_discount, 0)', 4)} AS razon FROM lineitem")
def divide(spark, sf):
    return lineitem(spark, sf).select("l_orderkey", "l_linenumber", rounded(safe_divide(F.col("l_extendedprice"), F.col("l_discount")), 4).alias("razon"))


@query("f17_round", "SELECT event_id, round(value / 7, 2) AS r2, round(value / 7, 4) AS r4, round(-value / 7, 0) AS r0 FROM events")
def rounding(spark, sf):
    sevenths = F.col("value") / 7
    return table(spark, sf, "events").select("event_id", casting.round_to(sevenths, 2).alias("r2"), casting.round_to(sevenths, 4).alias("r4"), casting.round_to(-sevenths, 0).alias("r0"))


@query("f18_sign_abs", "SELECT c_custkey, CAST(sign(c_acctbal) AS DOUBLE) AS signo, abs(c_acctbal) AS absoluto FROM customer")
def sign_abs(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.signum("c_acctbal").alias("signo"), F.abs("c_acctbal").alias("absoluto"))


@query("f19_first_present", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <= 3 THEN CAST(l_partkey AS VARCHAR) ELSE l_returnflag END AS codigo FROM lineitem")
def first_present(spark, sf):
    n = F.col("l_linenumber")
    main = F.when(n == 4, F.lit("  ")).when(n == 5, F.lit("NaN")).when(n <= 3, F.col("l_partkey").cast("string"))
    return lineitem(spark, sf).select("l_orderkey", "l_linenumber", casting.first_present(main, F.col("l_returnflag")).alias("codigo"))


@query("f20_sensor_class", f"WITH {TELEMETRY} SELECT codigoestacion, valorobservado, CASE WHEN contains(lower(descripcionsensor), 'precipitaci') OR contains(lower(descripcionsensor), 'lluvia') OR contains(lower(descripcionsensor), 'pluvi') THEN 'precipitacion' WHEN contains(lower(descripcionsensor), 'temperatura') THEN 'temperatura' WHEN contains(lower(descripcionsensor), 'radiaci') THEN 'radiacion' ELSE 'otro' END AS clase FROM telemetry WHERE descripcionsensor <> 'Pluviómetro' UNION ALL SELECT codigoestacion, valorobservado, 'otro' FROM telemetry WHERE descripcionsensor = 'Pluviómetro'")
def sensor_class(spark, sf):
    return telemetry(spark, sf).select("codigoestacion", "valorobservado", labels.sensor_class(F.col("descripcionsensor")).alias("clase"))


@query("t04_money_text", "SELECT o_orderkey, round(o_totalprice, 2) AS valor FROM orders")
def money_text(spark, sf):
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    whole, part = F.floor(cents / 100), cents % 100
    shown = F.concat(
        F.lit("$ "), F.replace(F.format_number(whole, 0), F.lit(","), F.lit(".")), F.lit(","), F.lpad(part.cast("string"), 2, "0")
    )
    return table(spark, sf, "orders").select("o_orderkey", casting.local_number(shown).alias("valor"))


@query("t07_clean_names_and_controls", "SELECT doc_id, regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g') AS mi_texto FROM documents")
def controls(spark, sf):
    from granary.operators.curation import snake_case_columns, strip_controls

    raw = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("﻿"), F.col("text"), F.lit("\u0007")).alias("Mi  Téxto"))
    return snake_case_columns(raw.withColumn("Mi  Téxto", strip_controls(F.col("Mi  Téxto"))))


@query(
    "t05_unwrap_months",
    f"""WITH s AS (SELECT year(o_orderdate) AS anio, month(o_orderdate) AS mes, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS valor FROM orders GROUP BY 1, 2)
SELECT anio, mes, {r('valor', 2)} AS valor FROM s""",
)
def unwrap_months(spark, sf):
    from granary.operators.curation import MONTH_NAMES, unwrap_months as unwrap

    o = table(spark, sf, "orders")
    wide = (
        o.withColumn("m", F.month("o_orderdate"))
        .groupBy(F.year("o_orderdate").alias("anio"))
        .pivot("m", list(range(1, 13)))
        .agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")))
    )
    named = wide.toDF("anio", *MONTH_NAMES)
    return unwrap(named, "anio").withColumn("valor", rounded("valor", 2))


@query(
    "t06_unwrap_markets",
    f"""WITH m AS (SELECT p_brand AS producto, l_returnflag AS plaza, avg(l_extendedprice) AS precio, avg(l_discount) AS v
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT producto, lower(plaza) AS plaza, {r('precio', 4)} AS precio, {r('v', 6)} AS variacion FROM m""",
)
def unwrap_markets(spark, sf):
    from granary.operators.curation import unwrap_markets as unwrap

    li, part = lineitem(spark, sf), table(spark, sf, "part")
    wide = (
        li.join(part, li.l_partkey == part.p_partkey)
        .groupBy(F.col("p_brand").alias("producto"))
        .pivot("l_returnflag", ["A", "N", "R"])
        .agg(F.avg("l_extendedprice").alias("precio"), F.avg("l_discount").alias("var"))
    )
    wide = wide.toDF(*[c.lower() for c in wide.columns])
    return unwrap(wide, "producto").withColumns({"precio": rounded("precio", 4), "variacion": rounded("variacion", 6)})
