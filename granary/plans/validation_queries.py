"""Contracts, key checks and the quality gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import validation
from granary.plans.catalog import query
from granary.plans.inputs import lineitem, telemetry, TELEMETRY
from granary.session import table


def crop_rows(spark, sf):
    li = lineitem(spark, sf)
    n = F.col("l_linenumber")
    return li.select(
        F.when(n == 1, F.lit(" ")).otherwise(F.col("l_suppkey").cast("string")).alias("c_d_mun"),
        F.col("l_partkey").cast("string").alias("c_d_dep"),
        F.when(n == 2, F.lit("1999")).when(n == 3, F.lit("x")).otherwise(F.year("l_shipdate").cast("string")).alias("a_o"),
        F.when(n == 4, F.lit(None)).otherwise(F.col("l_returnflag")).alias("cultivo"),
        F.col("l_quantity").alias("rea_sembrada_ha"),
        (F.col("l_quantity") * (1 + 2 * F.col("l_discount"))).alias("rea_cosechada_ha"),
        F.when(n == 5, -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice")).alias("producci_n_t"),
        F.when(n == 6, F.lit("n/d")).otherwise(F.col("l_tax").cast("string")).alias("rendimiento_t_ha"),
        "l_orderkey",
        "l_linenumber",
    )


CROP_ROWS = """flagged AS (
  SELECT *, l_linenumber = 1 AS e_mun, l_linenumber = 2 AS e_year, l_linenumber = 3 AS e_year_text, l_linenumber = 4 AS e_crop,
    l_quantity > 0 AND l_quantity * (1 + 2 * l_discount) > l_quantity * 1.15 AS e_area, l_linenumber = 5 AS e_prod,
    l_linenumber = 6 AS e_yield FROM lineitem),
marked AS (SELECT *, e_mun OR e_year OR e_year_text OR e_crop OR e_area OR e_prod OR e_yield AS bad FROM flagged)"""


@query(
    "v01_crop_contract",
    f"""WITH {CROP_ROWS} SELECT CAST(l_partkey AS VARCHAR) AS codigo_departamento, CAST(l_suppkey AS VARCHAR) AS codigo_municipio,
  CAST(year(l_shipdate) AS BIGINT) AS anio, upper(l_returnflag) AS cultivo, l_quantity AS area_sembrada,
  l_quantity * (1 + 2 * l_discount) AS area_cosechada, l_extendedprice AS produccion, l_tax AS rendimiento
FROM marked WHERE NOT bad AND year(l_shipdate) BETWEEN 2000 AND 2030""",
)
def crop_contract(spark, sf):
    return validation.validate(crop_rows(spark, sf), "eva")["accepted"]


@query(
    "v02_climate_contract",
    f"""WITH {TELEMETRY}, t AS (SELECT *, lower(descripcionsensor) AS d, CASE WHEN CAST(codigoestacion AS BIGINT) % 7 = 0 THEN -valorobservado ELSE valorobservado * 6 END AS v FROM telemetry)
SELECT codigoestacion AS codigo_estacion, v AS valor, count(*) AS n FROM t
WHERE NOT (contains(d, 'precipitaci') AND NOT (v BETWEEN 0 AND 600)) AND NOT (contains(d, 'temperatura') AND NOT (v BETWEEN -15 AND 60))
  AND NOT (contains(d, 'radiaci') AND v < 0) GROUP BY ALL""",
)
def climate_contract(spark, sf):
    station = F.col("codigoestacion").cast("bigint")
    raw = telemetry(spark, sf).withColumn(
        "valorobservado", F.when(station % 7 == 0, -F.col("valorobservado")).otherwise(F.col("valorobservado") * 6)
    )
    good = validation.validate(raw, "ideam")["accepted"]
    return good.groupBy("codigo_estacion", "valor").agg(F.count(F.lit(1)).alias("n"))


def price_rows(spark, sf):
    n = F.col("l_linenumber")
    return lineitem(spark, sf).select(
        F.when(n != 1, F.col("l_returnflag")).alias("articulo"),
        F.when(n == 2, F.lit(13)).otherwise(F.month("l_shipdate")).alias("mes"),
        F.year("l_shipdate").alias("anio"),
        F.when(n == 3, F.lit("0")).when(n == 4, F.lit("caro")).otherwise(F.col("l_extendedprice").cast("string")).alias("preciopromedio"),
    )


@query(
    "v03_price_contract",
    """SELECT rule, count(*) AS violations FROM (
  SELECT 'articulo no puede estar vacío' AS rule FROM lineitem WHERE l_linenumber = 1 UNION ALL
  SELECT 'mes' FROM lineitem WHERE l_linenumber = 2 UNION ALL
  SELECT 'anio' FROM lineitem WHERE year(l_shipdate) NOT BETWEEN 2000 AND 2030 UNION ALL
  SELECT 'precio' FROM lineitem WHERE l_linenumber = 3 UNION ALL
  SELECT 'precio no numérico' FROM lineitem WHERE l_linenumber = 4) GROUP BY 1""",
)
def price_contract(spark, sf):
    return validation.validate(price_rows(spark, sf), "sipsa")["rules"]


@query(
    "v04_livestock_contract",
    """SELECT CAST(o_custkey AS VARCHAR) AS codigo_municipio, upper(o_orderpriority) AS especie, CAST(trunc(o_totalprice) AS BIGINT) AS total_animales
FROM orders WHERE o_orderstatus NOT IN ('F') AND o_orderpriority <> '5-LOW'""",
)
def livestock_contract(spark, sf):
    o = table(spark, sf, "orders")
    raw = o.select(
        F.col("o_custkey").alias("col_0"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("col_1"),
        F.when(F.col("o_orderstatus") == "F", -F.col("o_totalprice")).otherwise(F.col("o_totalprice")).alias("col_3"),
    )
    return validation.validate(raw, "ica")["accepted"]


@query(
    "v05_split_rejected",
    f"""WITH {CROP_ROWS} SELECT l_orderkey, l_linenumber, count(*) AS copies FROM marked WHERE bad OR year(l_shipdate) NOT BETWEEN 2000 AND 2030 GROUP BY 1, 2""",
)
def split_rejected(spark, sf):
    bad = validation.validate(crop_rows(spark, sf), "eva")["rejected"]
    named = bad.filter(F.length(validation.ERROR_COLUMN) > 0)
    return named.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("copies"))


@query(
    "v06_gate",
    f"""WITH {CROP_ROWS}, t AS (SELECT count(*) AS total_records, count(*) FILTER (NOT bad AND year(l_shipdate) BETWEEN 2000 AND 2030) AS valid_records FROM marked)
SELECT total_records, valid_records, total_records - valid_records AS invalid_records,
  round(valid_records * 100.0 / total_records, 2) AS compliance_rate_pct,
  CASE WHEN round(valid_records * 100.0 / total_records, 2) >= 80 THEN 'GREEN' ELSE 'RED' END AS verdict FROM t""",
)
def quality_gate(spark, sf):
    return validation.gate(validation.validate(crop_rows(spark, sf), "eva")["metrics"])


@query(
    "a09_rule_counts",
    f"""WITH {CROP_ROWS} SELECT rule, count(*) AS violations FROM (
  SELECT 'codigo_municipio no puede estar vacío' AS rule FROM marked WHERE e_mun UNION ALL
  SELECT 'anio' FROM marked WHERE NOT e_year_text AND (e_year OR year(l_shipdate) NOT BETWEEN 2000 AND 2030) UNION ALL
  SELECT 'anio inválido' FROM marked WHERE e_year_text UNION ALL
  SELECT 'cultivo no puede estar vacío' FROM marked WHERE e_crop UNION ALL
  SELECT 'area_cosechada' FROM marked WHERE e_area UNION ALL
  SELECT 'produccion' FROM marked WHERE e_prod UNION ALL
  SELECT 'rendimiento no numérico' FROM marked WHERE e_yield) GROUP BY 1""",
)
def rule_counts(spark, sf):
    return validation.validate(crop_rows(spark, sf), "eva")["rules"]


@query(
    "u03_partition_of_input",
    f"""WITH {CROP_ROWS}, m AS (SELECT NOT bad AND year(l_shipdate) BETWEEN 2000 AND 2030 AS ok FROM marked)
SELECT CASE WHEN ok THEN 'accepted' ELSE 'rejected' END AS side, count(*) AS n FROM m GROUP BY 1""",
)
def partition_of_input(spark, sf):
    parts = validation.validate(crop_rows(spark, sf), "eva")
    sides = [parts[s].agg(F.count(F.lit(1)).alias("n")).select(F.lit(s).alias("side"), "n") for s in ("accepted", "rejected")]
    return sides[0].unionByName(sides[1])


@query(
    "k01_key_uniqueness",
    """WITH k AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT CAST(sum(n) AS BIGINT) AS total_rows, count(*) AS unique_keys, CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS duplicate_rows,
  sum(CASE WHEN n > 1 THEN n ELSE 0 END) = 0 AS is_unique FROM k""",
)
def key_uniqueness(spark, sf):
    return validation.key_uniqueness(lineitem(spark, sf), ["l_orderkey", "l_linenumber"])


@query(
    "o03_duplicate_samples",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem
WHERE (l_orderkey, l_linenumber) IN (SELECT (l_orderkey, l_linenumber) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice LIMIT 10""",
)
def duplicate_samples(spark, sf):
    narrow = lineitem(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return validation.duplicate_samples(narrow, ["l_orderkey", "l_linenumber"])


@query(
    "k02_constraints",
    """SELECT 'lineitem: unique(l_orderkey, l_linenumber)' AS "constraint", (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS violations
UNION ALL SELECT 'lineitem: not null(l_partkey)', (SELECT count(*) FROM lineitem WHERE l_partkey IS NULL)
UNION ALL SELECT 'lineitem: not null(l_shipdate)', (SELECT count(*) FROM lineitem WHERE l_shipdate IS NULL)
UNION ALL SELECT 'lineitem: foreign(l_partkey)', (SELECT count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25))""",
)
def constraints(spark, sf):
    parts = table(spark, sf, "part").filter("p_size > 25")
    return validation.check_constraints(
        "lineitem",
        lineitem(spark, sf),
        unique=[["l_orderkey", "l_linenumber"]],
        not_null=["l_partkey", "l_shipdate"],
        foreign=[("l_partkey", parts, "p_partkey")],
    )
