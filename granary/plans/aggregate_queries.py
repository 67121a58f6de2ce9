"""Profiles, coverage, cardinality and simple aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import labels
from granary.operators import profiling, sketches
from granary.plans.catalog import query
from granary.plans.cleaning_queries import INFLATION_CASE
from granary.plans.inputs import PRICES, TEMPS, lineitem, month, monthly_discounts, monthly_prices, r, rounded
from granary.session import table

PROFILED = ["o_custkey", "o_orderstatus", "o_orderdate", "precio"]


def profiled(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_custkey", "o_orderstatus", "o_orderdate", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("precio"))


@query(
    "a01_column_profile",
    "WITH o AS (SELECT o_custkey, o_orderstatus, o_orderdate, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS precio FROM orders) "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS total_rows, count(*) - count({c}) AS null_count, round((count(*) - count({c})) * 100.0 / count(*), 2) AS null_percentage,
count(DISTINCT {c}) AS unique_count, round(count(DISTINCT {c}) / count(*), 4) AS cardinality_ratio FROM o"""
        for c in PROFILED
    ),
)
def column_profile(spark, sf):
    return profiling.column_profile(profiled(spark, sf)).drop("dtype")


@query(
    "a01_sketch_profile",
    "WITH o AS (SELECT o_custkey, o_orderstatus, o_orderdate, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS precio FROM orders) "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS total_rows, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS unique_count, true AS unique_close,
{'true' if number else 'NULL'} AS median_close FROM o"""
        for c, number in zip(PROFILED, (True, False, False, True))
    ),
)
def sketch_profile(spark, sf):
    """Each year's orders are a load of their own; the merged profile is held against exact counts and ranks."""
    o = profiled(spark, sf)
    profile = sketches.sketch_profile(sketches.merge_sketches(sketches.column_sketches(o, F.year("o_orderdate"))))
    exact = profiling.column_profile(o).select("column", "unique_count")
    medians = profile.where(F.col("median").isNotNull()).select("column", "median")
    below = profiling.melt_numbers(o, ["o_custkey", "precio"]).join(medians, "column").groupBy("column").agg(
        F.avg((F.col("value") < F.col("median")).cast("int")).alias("under"), F.avg((F.col("value") <= F.col("median")).cast("int")).alias("upto")
    )
    close = F.abs(F.col("unique_estimate") - F.col("unique_count")) <= 0.025 * F.col("unique_count")
    out = profile.join(exact, "column").join(below, "column", "left")
    median_close = (F.col("under") <= 0.51) & (F.col("upto") >= 0.49)
    return out.select("column", "total_rows", "null_count", "unique_count", close.alias("unique_close"), median_close.alias("median_close"))


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount"]


def _stats_sql(c: str) -> str:
    q = lambda p: f"quantile_cont({c}, {p})"
    shown = {
        "mean": f"avg({c})", "std": f"stddev_samp({c})", "median": q(0.5), "min": f"min({c})", "max": f"max({c})",
        "p01": q(0.01), "p05": q(0.05), "p25": q(0.25), "p75": q(0.75), "p95": q(0.95), "p99": q(0.99), "iqr": f"{q(0.75)} - {q(0.25)}",
    }
    cols = ", ".join(f"{r(e, 4)} AS {n}" for n, e in shown.items())
    return f"""SELECT '{c}' AS "column", {cols}, (SELECT count(*) FROM lineitem, (SELECT {q(0.25)} AS a, {q(0.75)} AS b FROM lineitem)
  WHERE {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) AS outliers_iqr_count FROM lineitem"""


@query("a02_numeric_profile", " UNION ALL ".join(_stats_sql(c) for c in NUMBERS))
def numeric_profile(spark, sf):
    return profiling.numeric_profile(lineitem(spark, sf), NUMBERS)


@query(
    "a03_fence_outliers",
    """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events GROUP BY 1)
SELECT event_type, count(*) FILTER (value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) AS outliers_iqr_count FROM events JOIN q USING (event_type) GROUP BY 1""",
)
def fence_outliers(spark, sf):
    from granary.operators.quantiles import exact_quantiles

    ev = table(spark, sf, "events")
    quartiles = exact_quantiles(ev, ["event_type"], "value", {"p25": 0.25, "p75": 0.75})
    return profiling.outside_fences(ev, quartiles, ["event_type"], "value")


def brand_days(spark, sf):
    li, part = lineitem(spark, sf), table(spark, sf, "part")
    return li.join(part, li.l_partkey == part.p_partkey).select(F.col("l_shipdate").cast("date").alias("fecha"), "p_brand")


MONTH_EDGES = """d AS (SELECT CAST(l_shipdate AS DATE) AS fecha, p_brand, p_partkey FROM lineitem JOIN part ON l_partkey = p_partkey),
edge AS (SELECT min(fecha) AS lo, max(fecha) AS hi FROM d),
expected AS (SELECT CAST(unnest(generate_series(CASE WHEN date_trunc('month', lo) = lo THEN lo ELSE date_trunc('month', lo) + INTERVAL 1 MONTH END,
  date_trunc('month', hi), INTERVAL 1 MONTH)) AS DATE) AS period FROM edge)"""


@query(
    "a04_temporal_coverage",
    f"""WITH {MONTH_EDGES} SELECT (SELECT lo FROM edge) AS earliest_date, (SELECT hi FROM edge) AS latest_date,
  (SELECT count(*) FROM expected) AS expected_periods_count, (SELECT count(DISTINCT date_trunc('month', fecha)) FROM d) AS actual_periods_count,
  (SELECT count(*) FROM expected WHERE period NOT IN (SELECT CAST(date_trunc('month', fecha) AS DATE) FROM d)) AS missing_periods_count,
  (SELECT count(*) FROM expected WHERE period NOT IN (SELECT CAST(date_trunc('month', fecha) AS DATE) FROM d)) > 0 AS has_gaps""",
)
def temporal_coverage(spark, sf):
    return profiling.temporal_coverage(brand_days(spark, sf), "fecha")


def customer_days(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("fecha"), "o_custkey")


BRAND_DAYS = "SELECT CAST(l_shipdate AS DATE) AS fecha, p_brand, p_partkey FROM lineitem JOIN part ON l_partkey = p_partkey"
CUSTOMER_EDGES = MONTH_EDGES.replace(BRAND_DAYS, "SELECT CAST(o_orderdate AS DATE) AS fecha, o_custkey FROM orders")


@query(
    "a05_gaps_by_group",
    f"""WITH {CUSTOMER_EDGES}, have AS (SELECT DISTINCT o_custkey, CAST(date_trunc('month', fecha) AS DATE) AS period FROM d)
SELECT CAST(s.o_custkey AS VARCHAR) AS "group", count(*) AS missing_periods FROM (SELECT DISTINCT o_custkey FROM d) s CROSS JOIN expected e
LEFT JOIN have h ON h.o_custkey = s.o_custkey AND h.period = e.period WHERE h.period IS NULL GROUP BY 1""",
)
def gaps_by_group(spark, sf):
    return profiling.gaps_by_group(customer_days(spark, sf), "fecha", "o_custkey")


SPARSE = "(year(l_shipdate) + month(l_shipdate)) % 5 <> 0"
SPARSE_EDGES = MONTH_EDGES.replace(BRAND_DAYS, f"SELECT CAST(l_shipdate AS DATE) AS fecha FROM lineitem WHERE {SPARSE}")


def sparse_days(spark, sf):
    return lineitem(spark, sf).filter(SPARSE).select(F.col("l_shipdate").cast("date").alias("fecha"))


@query("u02_period_difference", f"WITH {SPARSE_EDGES} SELECT period FROM expected EXCEPT SELECT CAST(date_trunc('month', fecha) AS DATE) FROM d")
def period_difference(spark, sf):
    return profiling.missing_periods(sparse_days(spark, sf), "fecha")


@query("j08_missing_anti_join", f"WITH {SPARSE_EDGES} SELECT count(*) AS faltantes FROM expected WHERE period NOT IN (SELECT CAST(date_trunc('month', fecha) AS DATE) FROM d)")
def missing_anti_join(spark, sf):
    return profiling.missing_periods(sparse_days(spark, sf), "fecha").agg(F.count(F.lit(1)).alias("faltantes"))


@query("o05_first_missing", f"WITH {SPARSE_EDGES} SELECT period FROM expected WHERE period NOT IN (SELECT CAST(date_trunc('month', fecha) AS DATE) FROM d) ORDER BY period LIMIT 50")
def first_missing(spark, sf):
    return profiling.first_missing(sparse_days(spark, sf), "fecha")


CATEGORIES = {"p_name": "p_name", "p_type": "p_type", "marca": "CASE WHEN p_size > 40 THEN NULL ELSE p_brand END"}


@query(
    "a06_category_summary",
    "WITH "
    + ", ".join(f"c_{n} AS (SELECT coalesce({e}, 'None') AS v, count(*) AS n FROM part GROUP BY 1)" for n, e in CATEGORIES.items())
    + " "
    + " UNION ALL ".join(
        f"""SELECT '{n}' AS columna, count(*) AS cardinalidad_unica, (SELECT v FROM c_{n} ORDER BY n DESC, v LIMIT 1) AS categoria_dominante,
  max(n) AS frecuencia_dominante, round(max(n) * 100.0 / sum(n), 2) AS porcentaje_dominante FROM c_{n}"""
        for n in CATEGORIES
    ),
)
def category_summary(spark, sf):
    part = table(spark, sf, "part").withColumn("marca", F.when(F.col("p_size") <= 40, F.col("p_brand")))
    return profiling.category_summary(part, ["p_name", "p_type", "marca", "absent"])


@query("a07_group_mean", f"SELECT p_brand, {r('avg(l_extendedprice / l_quantity)', 4)} AS rendimiento FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def group_mean(spark, sf):
    li, part = lineitem(spark, sf), table(spark, sf, "part")
    rows = li.join(part, li.l_partkey == part.p_partkey).withColumn("y", F.col("l_extendedprice") / F.col("l_quantity"))
    return profiling.group_mean(rows, "p_brand", "y", "rendimiento").withColumn("rendimiento", rounded("rendimiento", 4))


@query(
    "a08_month_climatology",
    f"WITH {TEMPS} SELECT serie, month(mes) AS mes, {r('avg(temp)', 6)} AS media, {r('stddev_samp(temp)', 6)} AS desv FROM temps GROUP BY 1, 2",
)
def month_climatology(spark, sf):
    out = profiling.month_climatology(monthly_discounts(spark, sf), ["serie"], "mes", "temp")
    return out.withColumns({"media": rounded("media", 6), "desv": rounded("desv", 6)})


LAYERS = ["customer", "orders", "lineitem", "events"]


@query("a10_layer_counts", " UNION ALL ".join(f"SELECT '{t}' AS layer, count(*) AS \"rows\" FROM {t}" for t in LAYERS))
def layer_counts(spark, sf):
    return profiling.layer_counts({t: table(spark, sf, t) for t in LAYERS})


@query(
    "a11_sum_avg_group",
    f"SELECT c_mktsegment, year(o_orderdate) AS anio, {r('sum(CAST(o_totalprice AS DECIMAL(18,2)))', 2)} AS total, {r('avg(o_totalprice)', 4)} AS promedio FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2",
)
def sum_avg_group(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).groupBy("c_mktsegment", F.year("o_orderdate").alias("anio")).agg(
        rounded(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double"), 2).alias("total"),
        rounded(F.avg("o_totalprice"), 4).alias("promedio"),
    )


@query(
    "a12_label_counts",
    f"""WITH {PRICES}, y AS (SELECT serie, mes, (precio - lag(precio, 12) OVER w) / nullif(lag(precio, 12) OVER w, 0) * 100 AS v FROM prices WINDOW w AS (PARTITION BY serie ORDER BY mes)),
newest AS (SELECT serie, max(mes) AS mes FROM y GROUP BY 1)
SELECT {INFLATION_CASE} AS riesgo, count(*) AS n FROM y JOIN newest USING (serie, mes) GROUP BY 1""",
)
def label_counts(spark, sf):
    from granary.operators.market_indices import latest, yoy_inflation

    yoy = yoy_inflation(monthly_prices(spark, sf), "precio", "serie", "mes", name="v", bounded=True)
    now = latest(yoy, ["serie"], ["mes"], ["v"])
    return profiling.label_counts(now, labels.classify_inflation(F.col("v")), "riesgo")


@query(
    "u01_append_frames",
    "SELECT 'customer' AS fuente, c_custkey AS clave, c_acctbal AS saldo, NULL AS estado FROM customer UNION ALL SELECT 'orders', o_orderkey, NULL, o_orderstatus FROM orders",
)
def append_frames(spark, sf):
    c = table(spark, sf, "customer").select(F.lit("customer").alias("fuente"), F.col("c_custkey").alias("clave"), F.col("c_acctbal").alias("saldo"))
    o = table(spark, sf, "orders").select(F.lit("orders").alias("fuente"), F.col("o_orderkey").alias("clave"), F.col("o_orderstatus").alias("estado"))
    return c.unionByName(o, allowMissingColumns=True)
