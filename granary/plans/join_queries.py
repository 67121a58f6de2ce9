"""Joins, name matching and consolidation."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import consolidate, matching
from granary.plans.catalog import query
from granary.plans.inputs import PRICES, TEMPS, jaro_winkler_cte, lineitem, monthly_discounts, monthly_prices, r, rounded
from granary.session import table


@query(
    "j01_consolidate_features",
    f"WITH {PRICES}, {TEMPS}, n AS (SELECT p_brand AS serie, count(*) AS partes FROM part GROUP BY 1) SELECT p.serie, p.mes, {r('precio', 4)} AS precio, {r('temp', 6)} AS temp, partes FROM prices p LEFT JOIN (SELECT * FROM temps WHERE month(mes) < 7) t USING (serie, mes) LEFT JOIN n USING (serie)",
)
def consolidate_features(spark, sf):
    counts = table(spark, sf, "part").groupBy(F.col("p_brand").alias("serie")).agg(F.count(F.lit(1)).alias("partes"))
    half = monthly_discounts(spark, sf).filter(F.month("mes") < 7)
    unrelated = table(spark, sf, "region")
    out = consolidate.consolidate_features(monthly_prices(spark, sf), [half, unrelated, counts], ["serie", "mes"])
    return out.withColumns({"precio": rounded("precio", 4), "temp": rounded("temp", 6)})


@query(
    "j02_inner_join_on_date",
    f"WITH {PRICES}, {TEMPS} SELECT serie, mes, {r('precio', 4)} AS precio, {r('temp', 6)} AS temp, year(mes) AS anio, month(mes) AS mes_num FROM prices JOIN (SELECT * FROM temps WHERE month(mes) > 3) USING (serie, mes)",
)
def inner_join_on_date(spark, sf):
    temps = monthly_discounts(spark, sf).filter(F.month("mes") > 3)
    out = monthly_prices(spark, sf).join(temps, ["serie", "mes"], "inner")
    return out.select(
        "serie", "mes", rounded("precio", 4).alias("precio"), rounded("temp", 6).alias("temp"), F.year("mes").alias("anio"), F.month("mes").alias("mes_num")
    )


def catalogue(spark, sf):
    """Distinct part names as master entries in three departments."""
    part = table(spark, sf, "part")
    names = part.groupBy("p_name").agg(F.min("p_partkey").alias("id"))
    return names.select(
        F.col("id").cast("string").alias("cod_municipio"),
        F.concat(F.lit(" "), F.initcap("p_name")).alias("nombre_municipio"),
        (F.col("id") % 3).cast("string").alias("cod_departamento"),
        F.concat(F.lit("Región "), (F.col("id") % 3).cast("string")).alias("nombre_departamento"),
        F.col("id").alias("orden"),
    )


GOLDEN = """golden AS (SELECT CASE WHEN length(CAST(id AS VARCHAR)) < 5 THEN lpad(CAST(id AS VARCHAR), 5, '0') ELSE CAST(id AS VARCHAR) END AS cod_municipio, upper(p_name) AS nombre_municipio,
  lpad(CAST(id % 3 AS VARCHAR), 2, '0') AS cod_departamento, 'REGION ' || (id % 3) AS nombre_departamento, id AS seq
  FROM (SELECT p_name, min(p_partkey) AS id FROM part GROUP BY 1))"""


@query("j05_golden_catalogue", f"WITH {GOLDEN} SELECT * FROM golden")
def golden_catalogue(spark, sf):
    return matching.golden_catalogue(catalogue(spark, sf), "orden")


def dirty_names(spark, sf):
    """Every part name with one character dropped, doubled or swapped, by key."""
    part = table(spark, sf, "part")
    k = (F.col("p_partkey") % 7 + 1).cast("int")
    n = F.col("p_name")
    dropped = F.concat(F.substring(n, F.lit(1), k), F.substring(n, k + 2, F.lit(100)))
    doubled = F.concat(F.substring(n, F.lit(1), k), F.substring(n, k, F.lit(100)))
    raw = F.when(F.col("p_partkey") % 4 == 0, n).when(F.col("p_partkey") % 4 == 1, dropped).when(F.col("p_partkey") % 4 == 2, doubled).otherwise(
        F.concat(n, F.lit("  zzzz qq"))
    )
    return part.select(raw.alias("nombre"), F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("región "), (F.col("p_partkey") % 3).cast("string"))).alias("dep"))


def fuzzy_sql(threshold: float) -> str:
    return f"""WITH RECURSIVE {GOLDEN}, dirty AS (
  SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN substr(p_name, 1, p_partkey % 7 + 1) || substr(p_name, p_partkey % 7 + 3)
    WHEN 2 THEN substr(p_name, 1, p_partkey % 7 + 1) || substr(p_name, p_partkey % 7 + 1) ELSE p_name || '  zzzz qq' END AS raw_name,
    CASE WHEN p_partkey % 5 = 0 THEN 'región ' || (p_partkey % 3) END AS raw_hint FROM part),
asked AS (SELECT *, upper(trim(regexp_replace(raw_name, '\\s+', ' ', 'g'))) AS name, upper(strip_accents(raw_hint)) AS hint FROM dirty),
pairs AS (SELECT DISTINCT a.name AS a, g.nombre_municipio AS b FROM asked a CROSS JOIN golden g),
{jaro_winkler_cte('pairs')},
scored AS (SELECT a.raw_name, a.raw_hint, g.*, a.name = g.nombre_municipio AS same,
    (0.6 * jw + 0.4 * (1.0 - levenshtein(a.name, g.nombre_municipio) / CAST(greatest(length(a.name), length(g.nombre_municipio)) AS DOUBLE)))
    * CASE WHEN a.name <> g.nombre_municipio AND a.hint IS NOT NULL AND a.hint <> g.nombre_departamento THEN 0.8 ELSE 1.0 END AS score
  FROM asked a JOIN jw ON jw.a = a.name JOIN golden g ON g.nombre_municipio = jw.b),
best AS (SELECT * FROM scored WHERE score >= {threshold} OR same QUALIFY row_number() OVER (PARTITION BY raw_name, raw_hint ORDER BY same DESC, score DESC, seq) = 1)
SELECT d.raw_name, d.raw_hint, cod_municipio, nombre_municipio, cod_departamento, nombre_departamento,
  CASE WHEN same THEN 1.0 ELSE {r('score', 4)} END AS similarity_score, CASE WHEN same THEN 'EXACT' WHEN cod_municipio IS NOT NULL THEN 'FUZZY' END AS match_type
FROM dirty d LEFT JOIN best b ON b.raw_name = d.raw_name AND b.raw_hint IS NOT DISTINCT FROM d.raw_hint"""


def fuzzy(spark, sf, threshold):
    golden = matching.golden_catalogue(catalogue(spark, sf), "orden")
    out = matching.match_names(dirty_names(spark, sf), golden, "nombre", "dep", threshold)
    return out.withColumn("similarity_score", rounded("similarity_score", 4))


@query("j04_fuzzy_match", fuzzy_sql(0.85))
def fuzzy_match(spark, sf):
    return fuzzy(spark, sf, matching.THRESHOLD)


@query("j04_fuzzy_match_wide", fuzzy_sql(0.4))
def fuzzy_match_wide(spark, sf):
    """A threshold at which names of very different lengths can match."""
    return fuzzy(spark, sf, 0.4)


@query(
    "j06_lookup_default",
    "SELECT l_orderkey, l_linenumber, coalesce(p_size, 1) AS talla, count(*) AS n FROM lineitem LEFT JOIN (SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part WHERE p_size > 20) ON l_partkey = p_partkey GROUP BY ALL",
)
def lookup_default(spark, sf):
    from granary.operators.star import lookup

    sizes = table(spark, sf, "part").filter("p_size > 20").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("bigint").alias("talla"))
    out = lookup(lineitem(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey"), sizes, ["l_partkey"], "talla", 1)
    return out.groupBy("l_orderkey", "l_linenumber", "talla").agg(F.count(F.lit(1)).alias("n"))
