"""Stand-in series and raw layouts derived from the provided tables, with matching SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import special
from granary.session import table


# Exact ties such as 0.00005 are common in prices; half-up with a small nudge puts them
# on the same side in every engine, whatever the last bit of a floating sum.
NUDGE = 1e-5


def rounded(col: Column | str, digits: int) -> Column:
    """Rounded half-up for comparison; adding zero turns -0.0 into 0.0."""
    value = F.col(col) if isinstance(col, str) else col
    return F.floor(value.cast("double") * float(10**digits) + 0.5 + NUDGE) / float(10**digits) + F.lit(0.0)


def r(expr: str, digits: int) -> str:
    return f"(floor(CAST({expr} AS DOUBLE) * {10**digits}.0 + 0.5 + {NUDGE:.5f}) / {10**digits}.0 + 0.0)"


def month(col: str) -> Column:
    return F.trunc(F.col(col).cast("date"), "MM")


def lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem")


def monthly_prices(spark: SparkSession, sf: str) -> DataFrame:
    """Mean unit price per brand and ship month: (serie, mes, precio)."""
    li = lineitem(spark, sf).select("l_partkey", "l_shipdate", "l_extendedprice", "l_quantity")
    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    joined = li.join(part, li.l_partkey == part.p_partkey)
    return joined.groupBy(F.col("p_brand").alias("serie"), month("l_shipdate").alias("mes")).agg(
        F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("precio")
    )


PRICES = """prices AS (
  SELECT p_brand AS serie, CAST(date_trunc('month', l_shipdate) AS DATE) AS mes,
         avg(l_extendedprice / l_quantity) AS precio
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""


def monthly_discounts(spark: SparkSession, sf: str) -> DataFrame:
    """Mean discount in per cent per brand and month, the temperature stand-in: (serie, mes, temp)."""
    li = lineitem(spark, sf).select("l_partkey", "l_shipdate", "l_discount")
    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    return li.join(part, li.l_partkey == part.p_partkey).groupBy(
        F.col("p_brand").alias("serie"), month("l_shipdate").alias("mes")
    ).agg((F.avg("l_discount") * 100.0).alias("temp"))


TEMPS = """temps AS (
  SELECT p_brand AS serie, CAST(date_trunc('month', l_shipdate) AS DATE) AS mes, avg(l_discount) * 100.0 AS temp
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""


def monthly_rain(spark: SparkSession, sf: str) -> DataFrame:
    """Quantity per supplier and month on a dense calendar, absent months 0: (serie, mes, lluvia).

    Each supplier's own months are filled by exploding the shared calendar range (a
    bounded list of months), so no pair of tables is crossed.
    """
    li = lineitem(spark, sf)
    sums = li.groupBy(F.col("l_suppkey").alias("serie"), month("l_shipdate").alias("mes")).agg(
        F.sum("l_quantity").alias("lluvia")
    )
    edges = sums.agg(F.min("mes").alias("lo"), F.max("mes").alias("hi"))
    lo, hi = edges.select("lo").scalar(), edges.select("hi").scalar()
    calendar = F.sequence(lo, hi, F.expr("interval 1 month"))
    grid = sums.select("serie").distinct().select("serie", F.explode(calendar).alias("mes"))
    return grid.join(sums, ["serie", "mes"], "left").select("serie", "mes", F.coalesce("lluvia", F.lit(0.0)).alias("lluvia"))


RAIN = """sums AS (
  SELECT l_suppkey AS serie, CAST(date_trunc('month', l_shipdate) AS DATE) AS mes,
         sum(l_quantity) AS lluvia
  FROM lineitem GROUP BY 1, 2),
cal AS (SELECT CAST(unnest(generate_series(min(mes), max(mes), INTERVAL 1 MONTH)) AS DATE) AS mes FROM sums),
rain AS (
  SELECT s.serie, cal.mes, coalesce(sums.lluvia, 0.0) AS lluvia
  FROM (SELECT DISTINCT serie FROM sums) s CROSS JOIN cal
  LEFT JOIN sums ON sums.serie = s.serie AND sums.mes = cal.mes)"""


def telemetry(spark: SparkSession, sf: str) -> DataFrame:
    """Raw station observations as text columns, sensors named after event types."""
    ev = table(spark, sf, "events")
    sensor = (
        F.when(F.col("event_type") == "view", "Precipitación  total")
        .when(F.col("event_type") == "click", " temperatura del aire")
        .when(F.col("event_type") == "purchase", "Radiación solar")
        .when(F.col("event_type") == "signup", "Pluviómetro")
        .otherwise("Nivel")
    )
    return ev.select(
        F.col("user_id").cast("string").alias("codigoestacion"),
        F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("fechaobservacion"),
        F.col("value").alias("valorobservado"),
        sensor.alias("descripcionsensor"),
        F.lit("u").alias("unidadmedida"),
    )


TELEMETRY = """telemetry AS (
  SELECT CAST(user_id AS VARCHAR) AS codigoestacion, date_trunc('hour', ts) AS fechaobservacion,
         value AS valorobservado,
         CASE event_type WHEN 'view' THEN 'Precipitación  total' WHEN 'click' THEN ' temperatura del aire'
              WHEN 'purchase' THEN 'Radiación solar' WHEN 'signup' THEN 'Pluviómetro' ELSE 'Nivel' END AS descripcionsensor
  FROM events)"""


def crops(spark: SparkSession, sf: str) -> DataFrame:
    """Raw crop evaluation rows as text, from line items and parts."""
    li, part, supp = lineitem(spark, sf), table(spark, sf, "part"), table(spark, sf, "supplier")
    joined = li.join(part, li.l_partkey == part.p_partkey).join(supp, li.l_suppkey == supp.s_suppkey)
    return joined.select(
        F.col("s_nationkey").cast("string").alias("c_d_dep"),
        F.col("l_suppkey").cast("string").alias("c_d_mun"),
        F.concat(F.lit(" Nación  "), F.col("s_nationkey").cast("string")).alias("departamento"),
        F.col("p_name").alias("cultivo"),
        F.when(F.col("l_linenumber") == 1, F.lit(None)).when(F.col("l_linenumber") == 2, F.lit("  ")).otherwise(F.col("p_brand")).alias("desagregaci_n_regional_y"),
        F.col("p_type").alias("grupo_de_cultivo"),
        F.year("l_shipdate").cast("string").alias("a_o"),
        F.col("l_quantity").cast("string").alias("rea_sembrada_ha"),
        (F.col("l_quantity") * (1 + 2 * F.col("l_discount"))).cast("string").alias("rea_cosechada_ha"),
        F.when(F.col("l_tax") == 0.08, F.lit("n/d")).otherwise(F.col("l_extendedprice").cast("string")).alias("producci_n_t"),
        (F.col("l_extendedprice") / F.col("l_quantity")).cast("string").alias("rendimiento_t_ha"),
    )


CROPS = """crops AS (
  SELECT CAST(s_nationkey AS VARCHAR) AS c_d_dep, CAST(l_suppkey AS VARCHAR) AS c_d_mun,
         ' Nación  ' || s_nationkey AS departamento, p_name AS cultivo,
         CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber = 2 THEN '  ' ELSE p_brand END AS variedad_raw,
         p_type AS grupo_de_cultivo, year(l_shipdate) AS anio,
         l_quantity AS sembrada, l_quantity * (1 + 2 * l_discount) AS cosechada,
         CASE WHEN l_tax = 0.08 THEN NULL ELSE l_extendedprice END AS produccion,
         l_extendedprice / l_quantity AS rendimiento
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""


def clean_sql(expr: str) -> str:
    """The text normalisation in DuckDB terms (sharp s spelled out first)."""
    flat = f"replace(coalesce({expr}, ''), 'ß', 'ss')"
    return f"upper(trim(regexp_replace(strip_accents({flat}), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')))"


ERF_SQL = (
    "(sign({x}) * (1 - (((((1.061405429 * (1/(1+0.3275911*abs({x}))) - 1.453152027) * (1/(1+0.3275911*abs({x}))) + 1.421413741)"
    " * (1/(1+0.3275911*abs({x}))) - 0.284496736) * (1/(1+0.3275911*abs({x}))) + 0.254829592) * (1/(1+0.3275911*abs({x})))"
    " * exp(-({x})*({x})))))"
)


def phi(z: str) -> str:
    """Standard normal distribution function as SQL text."""
    return f"(0.5 * (1 + {ERF_SQL.format(x=f'(({z})/sqrt(2.0))')}))"


def polynomial_sql(coefficients, x: str) -> str:
    return "(" + " + ".join(f"CAST({c!r} AS DOUBLE) * pow({x}, {k})" for k, c in enumerate(coefficients)) + ")"


def exact_quantile_sql(p: str) -> str:
    """Normal quantile to full precision."""
    ratio = lambda pair, at: f"{polynomial_sql(pair[0], at)} / {polynomial_sql(pair[1], at)}"
    q, tail = f"({p} - 0.5)", f"(sqrt(-ln(least({p}, 1 - {p}))) - {special.QUANTILE_TAIL_SHIFT})"
    centre = f"({special.QUANTILE_CENTRE_SHIFT} - {q} * {q})"
    return f"(CASE WHEN abs({q}) <= {special.QUANTILE_CUT} THEN {q} * {ratio(special.QUANTILE_CENTRE, centre)} ELSE sign({q}) * {ratio(special.QUANTILE_TAIL, tail)} END)"


# SQL macro-like snippets for the normal quantile.
def quantile_sql(p: str) -> str:
    t = f"sqrt(-2.0 * ln(CASE WHEN {p} < 0.5 THEN {p} ELSE 1.0 - ({p}) END))"
    z = (
        f"({t} - (2.515517 + 0.802853*{t} + 0.010328*{t}*{t})"
        f" / (1.0 + 1.432788*{t} + 0.189269*{t}*{t} + 0.001308*{t}*{t}*{t}))"
    )
    return f"(CASE WHEN {p} < 0.5 THEN -{z} ELSE {z} END)"


def jaro_winkler_cte(pairs: str) -> str:
    """Recursive CTE ``jw(a, b, jw)`` over a CTE ``pairs(a, b)`` (fractional transpositions)."""
    return f"""jw_walk AS (
  SELECT a, b, 0 AS i, b AS rest, '' AS seen FROM {pairs}
  UNION ALL
  SELECT a, b, i + 1,
    CASE WHEN hit > 0 THEN substr(rest, 1, lo + hi_at - 2) || chr(1) || substr(rest, lo + hi_at) ELSE rest END,
    CASE WHEN hit > 0 THEN seen || substr(a, i + 1, 1) ELSE seen END
  FROM (SELECT *, CASE WHEN hi >= lo THEN instr(substr(rest, lo, hi - lo + 1), substr(a, i + 1, 1)) ELSE 0 END AS hit, hit AS hi_at
        FROM (SELECT *, greatest(1, i + 1 - (greatest(length(a), length(b)) // 2 - 1)) AS lo,
                     least(i + 1 + (greatest(length(a), length(b)) // 2 - 1), length(b)) AS hi
              FROM jw_walk WHERE i < length(a)))),
jw_pair AS (
  SELECT a, b, seen, array_to_string(list_transform(list_filter(range(1, length(b) + 1), lambda j: substr(rest, j, 1) = chr(1)), lambda j: substr(b, j, 1)), '') AS other
  FROM jw_walk WHERE i = length(a)),
jw_count AS (
  SELECT a, b, length(seen) AS m, len(list_filter(range(1, length(seen) + 1), lambda k: substr(seen, k, 1) <> substr(other, k, 1))) / 2.0 AS t,
    CASE WHEN substr(a,1,1) <> substr(b,1,1) THEN 0 WHEN substr(a,1,2) <> substr(b,1,2) OR least(length(a), length(b)) < 2 THEN 1
         WHEN substr(a,1,3) <> substr(b,1,3) OR least(length(a), length(b)) < 3 THEN 2
         WHEN substr(a,1,4) <> substr(b,1,4) OR least(length(a), length(b)) < 4 THEN 3 ELSE 4 END AS l
  FROM jw_pair),
jw AS (
  SELECT a, b, CASE WHEN a = b THEN 1.0 WHEN m = 0 THEN 0.0 ELSE j + l * 0.1 * (1.0 - j) END AS jw
  FROM (SELECT *, (m / CAST(length(a) AS DOUBLE) + m / CAST(length(b) AS DOUBLE) + (m - t) / CAST(m AS DOUBLE)) / 3.0 AS j FROM jw_count))"""
