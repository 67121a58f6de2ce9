"""Windows, market and climate indicators, and chart data."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import labels
from granary.operators import climate, features, market_indices, profiling
from granary.operators.ordered import average_ranks
from granary.plans import gold
from granary.plans.catalog import query
from granary.plans.cleaning_queries import INFLATION_CASE, SPI_CASE, THERMAL_CASE
from granary.plans.inputs import (
    PRICES,
    RAIN,
    TEMPS,
    exact_quantile_sql,
    lineitem,
    month,
    monthly_discounts,
    monthly_prices,
    monthly_rain,
    phi,
    quantile_sql,
    r,
    rounded,
)
from granary.session import table

EVENT_WINDOW = "(PARTITION BY user_id ORDER BY ts, event_id)"


def events(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", "ts", "value")


@query(
    "w01_lag_features",
    "SELECT event_id, " + ", ".join(f"lag(value, {k}) OVER w AS value_lag_{k}" for k in (1, 3, 6, 12)) + f" FROM events WINDOW w AS {EVENT_WINDOW}",
)
def lag_features(spark, sf):
    return features.add_lags(events(spark, sf), "value", None, "user_id", ["ts", "event_id"]).drop("user_id", "ts", "value")


@query(
    "w02_rolling_mean",
    "SELECT event_id, "
    + ", ".join(f"{r(f'avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)', 6)} AS value_roll_mean_{n}" for n in (3, 6))
    + " FROM events",
)
def rolling_mean(spark, sf):
    out = features.add_rolling(events(spark, sf), "value", [3, 6], "user_id", ["ts", "event_id"])
    return out.select("event_id", *[rounded(f"value_roll_mean_{n}", 6).alias(f"value_roll_mean_{n}") for n in (3, 6)])


@query(
    "w03_rolling_std",
    "SELECT event_id, "
    + ", ".join(f"{r(f'stddev_samp(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)', 4)} AS value_roll_std_{n}" for n in (3, 6))
    + " FROM events",
)
def rolling_std(spark, sf):
    out = features.add_rolling(events(spark, sf), "value", [3, 6], "user_id", ["ts", "event_id"])
    return out.select("event_id", *[rounded(f"value_roll_std_{n}", 4).alias(f"value_roll_std_{n}") for n in (3, 6)])


@query(
    "w04_full_rolling_sum",
    """SELECT event_id, CASE WHEN count(v) OVER f = 3 THEN round(sum(v) OVER f, 4) + 0.0 END AS v_sum_3
FROM (SELECT *, CASE WHEN event_id % 11 <> 0 THEN value END AS v FROM events) WINDOW f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
)
def full_rolling_sum(spark, sf):
    ev = events(spark, sf).withColumn("v", F.when(F.col("event_id") % 11 != 0, F.col("value")))
    out = features.add_rolling_sum(ev, "v", 3, "user_id", ["ts", "event_id"])
    return out.select("event_id", rounded("v_sum_3", 4).alias("v_sum_3"))


@query("w05_shift", f"SELECT event_id, lag(value, 12) OVER {EVENT_WINDOW} AS value_lag_12 FROM events")
def shift(spark, sf):
    return features.add_lags(events(spark, sf), "value", [12], "user_id", ["ts", "event_id"]).select("event_id", "value_lag_12")


@query(
    "w06_kth_value",
    """SELECT user_id, value AS base FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE value > 1) WHERE rn = 3""",
)
def kth_value(spark, sf):
    ev = events(spark, sf).withColumn("v", F.when(F.col("value") > 1, F.col("value")))
    return market_indices.kth_value(ev, "v", "user_id", ["ts", "event_id"], 2)


@query(
    "w07_average_rank",
    """SELECT value, count(*) AS n, min(rk) + (count(*) - 1) / 2.0 AS avg_rank FROM (SELECT value, rank() OVER (ORDER BY value) AS rk FROM events) GROUP BY value""",
)
def average_rank(spark, sf):
    return average_ranks(table(spark, sf, "events"), [], "value")


@query(
    "w08_first_difference",
    f"SELECT event_id, lag(value) OVER {EVENT_WINDOW} AS value_prev, round(value - lag(value) OVER {EVENT_WINDOW}, 6) + 0.0 AS value_diff FROM events",
)
def first_difference(spark, sf):
    out = features.add_difference(events(spark, sf), "value", "user_id", ["ts", "event_id"])
    return out.select("event_id", "value_prev", rounded("value_diff", 6).alias("value_diff"))


@query(
    "w09_top_per_group",
    "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn = 1",
)
def top_per_group(spark, sf):
    from granary.operators.cleaning import keep_first

    return keep_first(events(spark, sf), ["user_id"], [F.col("value").desc_nulls_last(), F.col("event_id")]).select("user_id", "event_id", "value")


@query("o01_sorted_series", f"WITH {PRICES} SELECT serie, mes, row_number() OVER (PARTITION BY serie ORDER BY mes) AS posicion FROM prices")
def sorted_series(spark, sf):
    from granary.operators.ordered import row_positions

    out = row_positions(monthly_prices(spark, sf), ["serie"], [F.col("mes")], "p", bounded=True)
    return out.select("serie", "mes", (F.col("p") + 1).alias("posicion"))


@query("o04_latest_periods", f"WITH {PRICES}, m AS (SELECT mes, count(*) AS series, {r('avg(precio)', 4)} AS precio FROM prices GROUP BY 1) SELECT * FROM m ORDER BY mes DESC LIMIT 6")
def latest_periods(spark, sf):
    months = monthly_prices(spark, sf).groupBy("mes").agg(F.count(F.lit(1)).alias("series"), rounded(F.avg("precio"), 4).alias("precio"))
    return months.orderBy(F.col("mes").desc()).limit(6)


YOY = f"""{PRICES}, yoy AS (SELECT serie, mes, precio, (precio - lag(precio, 12) OVER w) / nullif(lag(precio, 12) OVER w, 0) * 100 AS v FROM prices WINDOW w AS (PARTITION BY serie ORDER BY mes))"""


@query("m01_yoy_inflation", f"WITH {YOY} SELECT serie, mes, {r('v', 6)} AS inflacion_yoy, {INFLATION_CASE} AS riesgo FROM yoy")
def yoy_inflation(spark, sf):
    out = market_indices.yoy_inflation(monthly_prices(spark, sf), "precio", "serie", "mes", bounded=True)
    return out.select("serie", "mes", rounded("inflacion_yoy", 6).alias("inflacion_yoy"), labels.classify_inflation(F.col("inflacion_yoy")).alias("riesgo"))


@query(
    "m01_yoy_inflation_calendar",
    f"WITH {PRICES} SELECT a.serie, a.mes, {r('(a.precio - b.precio) / nullif(b.precio, 0) * 100', 6)} AS inflacion_yoy FROM prices a LEFT JOIN prices b ON b.serie = a.serie AND b.mes = a.mes - INTERVAL 12 MONTH",
)
def yoy_calendar(spark, sf):
    out = market_indices.yoy_inflation_calendar(monthly_prices(spark, sf), "precio", "mes", ["serie"])
    return out.select("serie", "mes", rounded("inflacion_yoy", 6).alias("inflacion_yoy"))


def input_product_prices(spark, sf):
    li = lineitem(spark, sf)
    flag = lambda f, name: li.filter(F.col("l_returnflag") == f).groupBy("l_suppkey", month("l_shipdate").alias("mes")).agg(
        F.avg(F.col("l_extendedprice")).alias(name)
    )
    return flag("A", "insumo"), flag("N", "producto")


TOT = """ins AS (SELECT l_suppkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS mes, avg(l_extendedprice) AS insumo FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2),
prod AS (SELECT l_suppkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS mes, avg(l_extendedprice) AS producto FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1, 2)"""


@query("m02_terms_of_trade", f"WITH {TOT} SELECT l_suppkey, mes, {r('insumo / nullif(producto, 0)', 6)} AS tot FROM ins FULL JOIN prod USING (l_suppkey, mes)")
def terms_of_trade(spark, sf):
    a, b = input_product_prices(spark, sf)
    out = market_indices.terms_of_trade(a, b, ["l_suppkey", "mes"], "insumo", "producto", "tot")
    return out.select("l_suppkey", "mes", rounded("tot", 6).alias("tot"))


@query("j07_aligned_series", f"WITH {TOT} SELECT l_suppkey, mes, {r('insumo', 4)} AS insumo, {r('producto', 4)} AS producto FROM ins FULL JOIN prod USING (l_suppkey, mes)")
def aligned_series(spark, sf):
    a, b = input_product_prices(spark, sf)
    out = market_indices.terms_of_trade(a, b, ["l_suppkey", "mes"], "insumo", "producto", "tot")
    return out.select("l_suppkey", "mes", rounded("insumo", 4).alias("insumo"), rounded("producto", 4).alias("producto"))


@query("m03_price_index", f"WITH {PRICES} SELECT serie, mes, {r('precio / first_value(precio) OVER (PARTITION BY serie ORDER BY mes) * 100', 6)} AS indice FROM prices")
def price_index(spark, sf):
    out = market_indices.price_index(monthly_prices(spark, sf), "precio", "serie", "mes", name="indice", bounded=True)
    return out.select("serie", "mes", rounded("indice", 6).alias("indice"))


def spi_sql(scale: int, source: str = "rain", name: str = "spi") -> str:
    """CTEs ending in {name}(serie, mes, lluvia, v)."""
    h = f"least(greatest(CASE WHEN acc <= 0 THEN q ELSE q + (1 - q) * greatest(0.0, least(1.0, {phi('z')})) END, 1e-6), 1 - 1e-6)"
    return f"""{name}_acc AS (SELECT *, CASE WHEN count(lluvia) OVER f = {scale} THEN sum(lluvia) OVER f END AS acc FROM {source}
  WINDOW f AS (PARTITION BY serie ORDER BY mes ROWS BETWEEN {scale - 1} PRECEDING AND CURRENT ROW)),
{name}_sum AS (SELECT serie, count(*) AS n, count(*) FILTER (acc > 0) AS np, avg(acc) FILTER (acc > 0) AS m, avg(ln(acc)) FILTER (acc > 0) AS ml
  FROM {name}_acc WHERE acc IS NOT NULL GROUP BY 1),
{name}_fit AS (SELECT serie, (n - np) / n AS q, m, CASE WHEN ln(m) - ml <= 0 THEN 1.0 ELSE (1 + sqrt(1 + 4 * (ln(m) - ml) / 3)) / (4 * (ln(m) - ml)) END AS a
  FROM {name}_sum WHERE n >= 12 AND np >= 3),
{name}_z AS (SELECT s.serie, s.mes, s.lluvia, acc, q, (pow(acc / (a * (m / a)), 1.0/3.0) - (1 - 1/(9*a))) / sqrt(1/(9*a)) AS z FROM {name}_acc s LEFT JOIN {name}_fit USING (serie)),
{name}_h AS (SELECT serie, mes, lluvia, CASE WHEN acc IS NULL OR q IS NULL THEN NULL ELSE {h} END AS h FROM {name}_z),
{name} AS (SELECT serie, mes, lluvia, CASE WHEN h IS NULL THEN NULL ELSE least(3.5, greatest(-3.5, {quantile_sql('h')})) END AS v FROM {name}_h)"""


def _spi_query(scale):
    def run(spark, sf):
        out = climate.spi(monthly_rain(spark, sf), "lluvia", "serie", "mes", scale, bounded=True)
        return out.select("serie", "mes", rounded(f"spi_{scale}", 5).alias("spi"), labels.classify_spi(F.col(f"spi_{scale}")).alias("clase"))

    return run


for _scale in (1, 3, 6):
    query(f"m04_spi_{_scale}", f"WITH {RAIN}, {spi_sql(_scale)} SELECT serie, mes, {r('v', 5)} AS spi, {SPI_CASE} AS clase FROM spi")(_spi_query(_scale))


def _psi_sql(a: str, order: int) -> str:
    """Digamma (order 0) or trigamma (order 1): recurrence up by twelve, then the asymptotic series."""
    y = f"({a} + 12)"
    if order == 0:
        series = f"ln({y}) - 1 / (2 * {y}) - 1 / (12 * pow({y}, 2)) + 1 / (120 * pow({y}, 4)) - 1 / (252 * pow({y}, 6)) + 1 / (240 * pow({y}, 8))"
        return f"({series} - list_sum(list_transform(range(12), lambda k: 1 / ({a} + k))))"
    series = f"1 / {y} + 1 / (2 * pow({y}, 2)) + 1 / (6 * pow({y}, 3)) - 1 / (30 * pow({y}, 5)) + 1 / (42 * pow({y}, 7)) - 1 / (30 * pow({y}, 9))"
    return f"({series} + list_sum(list_transform(range(12), lambda k: 1 / pow({a} + k, 2))))"


def likelihood_spi_sql(scale: int) -> str:
    """CTEs ending in s{scale}(serie, mes, v): Newton steps on the shape itself, and the power series of the incomplete gamma function."""
    s = f"s{scale}"
    steps = "".join(
        f", {s}_n{k + 1} AS (SELECT serie, q, m, g, a - (ln(a) - {_psi_sql('a', 0)} - g) / (1 / a - {_psi_sql('a', 1)}) AS a FROM {s}_n{k})" for k in range(8)
    )
    series = "list_sum(list_transform(range(600), lambda k: exp(k * ln(x) - lgamma(a + k + 1) + a * ln(x) - x)))"
    return f"""{s}_acc AS (SELECT *, CASE WHEN count(lluvia) OVER f = {scale} THEN sum(lluvia) OVER f END AS acc FROM rain
  WINDOW f AS (PARTITION BY serie ORDER BY mes ROWS BETWEEN {scale - 1} PRECEDING AND CURRENT ROW)),
{s}_sum AS (SELECT serie, count(*) AS n, count(*) FILTER (acc > 0) AS np, avg(acc) FILTER (acc > 0) AS m, avg(ln(acc)) FILTER (acc > 0) AS ml FROM {s}_acc WHERE acc IS NOT NULL GROUP BY 1),
{s}_n0 AS (SELECT serie, (n - np) / n AS q, m, ln(m) - ml AS g, 1 / (2 * (ln(m) - ml)) AS a FROM {s}_sum WHERE n >= 12 AND np >= 3){steps},
{s}_x AS (SELECT c.serie, c.mes, acc, q, a, acc * a / m AS x FROM {s}_acc c LEFT JOIN {s}_n8 USING (serie)),
{s}_p AS (SELECT serie, mes, CASE WHEN acc IS NULL OR q IS NULL THEN NULL ELSE least(1 - 1e-6, greatest(1e-6, CASE WHEN acc <= 0 THEN q ELSE q + (1 - q) * least(1.0, {series}) END)) END AS p FROM {s}_x),
{s} AS (SELECT serie, mes, CASE WHEN p IS NOT NULL THEN least(3.5, greatest(-3.5, {exact_quantile_sql('p')})) END AS v FROM {s}_p)"""


@query(
    "m04_spi_likelihood",
    f"WITH {RAIN}, {likelihood_spi_sql(1)}, {likelihood_spi_sql(3)}, {likelihood_spi_sql(6)} SELECT serie, mes, "
    + ", ".join(f"CASE WHEN s{k}.v IS NOT NULL THEN {r(f's{k}.v', 5)} END AS spi_{k}" for k in (1, 3, 6))
    + " FROM s1 JOIN s3 USING (serie, mes) JOIN s6 USING (serie, mes)",
)
def spi_by_likelihood(spark, sf):
    """All scales in one pass, fitted by maximum likelihood."""
    out = climate.spi(monthly_rain(spark, sf), "lluvia", "serie", "mes", [1, 3, 6], bounded=True, fit=climate.LIKELIHOOD)
    return out.select("serie", "mes", *[rounded(f"spi_{k}", 5).alias(f"spi_{k}") for k in (1, 3, 6)])


THERMAL = f"""{TEMPS}, clim AS (SELECT serie, month(mes) AS m, avg(temp) AS mu, stddev_samp(temp) AS sd FROM temps GROUP BY 1, 2),
thermal AS (SELECT t.serie, t.mes, t.temp, CASE WHEN sd IS NULL OR sd = 0 THEN 0.0 ELSE (temp - mu) / sd END AS v FROM temps t JOIN clim c ON c.serie = t.serie AND c.m = month(t.mes))"""


@query("m05_thermal_anomaly", f"WITH {THERMAL} SELECT serie, mes, {r('v', 6)} AS z, {THERMAL_CASE} AS clase FROM thermal")
def thermal_anomaly(spark, sf):
    out = climate.thermal_anomaly(monthly_discounts(spark, sf), "temp", "mes", "serie")
    return out.select("serie", "mes", rounded("anomalia_termica_z", 6).alias("z"), labels.classify_thermal(F.col("anomalia_termica_z")).alias("clase"))


@query(
    "j09_month_statistics_lookup",
    f"WITH {TEMPS}, clim AS (SELECT serie, month(mes) AS m, avg(temp) AS mu FROM temps GROUP BY 1, 2) SELECT t.serie, t.mes, {r('temp - mu', 6)} AS desvio FROM temps t JOIN clim c ON c.serie = t.serie AND c.m = month(t.mes)",
)
def month_lookup(spark, sf):
    from granary.functions.nulls import attach

    temps = monthly_discounts(spark, sf).withColumn("m", F.month("mes"))
    clim = profiling.month_climatology(monthly_discounts(spark, sf), ["serie"], "mes", "temp").withColumnRenamed("mes", "m")
    return attach(temps, clim, ["serie", "m"], "inner").select("serie", "mes", rounded(F.col("temp") - F.col("media"), 6).alias("desvio"))


def brand_rain(spark, sf):
    """Quantity per brand and month as the rain of the assembly."""
    li, part = lineitem(spark, sf), table(spark, sf, "part")
    return li.join(part, li.l_partkey == part.p_partkey).groupBy(F.col("p_brand").alias("serie"), month("l_shipdate").alias("mes")).agg(
        F.sum("l_quantity").alias("lluvia")
    )


BRAND_RAIN = "brand_rain AS (SELECT p_brand AS serie, CAST(date_trunc('month', l_shipdate) AS DATE) AS mes, sum(l_quantity) AS lluvia FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"


def gold_table(spark, sf):
    """All monthly measures come from one scan, one join and one aggregate."""
    li = lineitem(spark, sf).select("l_partkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    monthly = li.join(part, li.l_partkey == part.p_partkey).groupBy(
        F.col("p_brand").alias("serie"), month("l_shipdate").alias("mes")
    ).agg(
        F.sum("l_quantity").alias("lluvia"),
        (F.avg("l_discount") * 100.0).alias("temp"),
        F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("precio_insumo"),
        F.avg(F.col("l_extendedprice") * (1 - F.col("l_discount")) / F.col("l_quantity")).alias("precio_producto"),
    )
    return gold.assemble_one(monthly, "serie", "mes")


def _gold_sql() -> str:
    return f"""{BRAND_RAIN}, {spi_sql(1, 'brand_rain', 's1')}, {spi_sql(3, 'brand_rain', 's3')}, {spi_sql(6, 'brand_rain', 's6')}, {THERMAL},
market AS (SELECT p_brand AS serie, CAST(date_trunc('month', l_shipdate) AS DATE) AS mes, avg(l_extendedprice / l_quantity) AS pin,
  avg(l_extendedprice * (1 - l_discount) / l_quantity) AS pout FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
feats AS (SELECT *, (pin - lag(pin, 12) OVER w) / lag(pin, 12) OVER w * 100 AS yoy, pin / pout AS tot, lag(pout, 1) OVER w AS l1, lag(pout, 3) OVER w AS l3, lag(pout, 6) OVER w AS l6,
  avg(pout) OVER (PARTITION BY serie ORDER BY mes ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS m3,
  stddev_samp(pout) OVER (PARTITION BY serie ORDER BY mes ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS d6 FROM market WINDOW w AS (PARTITION BY serie ORDER BY mes)),
gold AS (SELECT f.serie, f.mes, year(f.mes) AS anio, month(f.mes) AS mes_num, s1.v AS spi_1, s3.v AS spi_3, s6.v AS spi_6, t.v AS z, f.yoy, f.tot, f.l1, f.l3, f.l6, f.m3, f.d6
  FROM feats f JOIN s1 USING (serie, mes) JOIN s3 USING (serie, mes) JOIN s6 USING (serie, mes) JOIN thermal t USING (serie, mes))"""


GOLD_SQL = _gold_sql()


@query(
    "m06_gold_assembly",
    f"""WITH {GOLD_SQL} SELECT serie, mes, anio, mes_num, {r('spi_1', 5)} AS spi_1, {r('spi_3', 5)} AS spi_3, {r('spi_6', 5)} AS spi_6, {r('z', 5)} AS anomalia_termica_z,
 {r('yoy', 5)} AS inflacion_yoy, {r('tot', 6)} AS terminos_intercambio_tot, {r('l1', 4)} AS precio_producto_lag_1, {r('l3', 4)} AS precio_producto_lag_3, {r('l6', 4)} AS precio_producto_lag_6,
 {r('m3', 4)} AS precio_producto_roll_mean_3, {r('d6', 4)} AS precio_producto_roll_std_6, {SPI_CASE.replace(' v ', ' spi_3 ')} AS riesgo_spi,
 {THERMAL_CASE.replace(' v ', ' z ')} AS riesgo_termico, {INFLATION_CASE.replace(' v ', ' yoy ')} AS riesgo_inflacion FROM gold""",
)
def gold_assembly(spark, sf):
    digits = {
        "spi_1": 5, "spi_3": 5, "spi_6": 5, "anomalia_termica_z": 5, "inflacion_yoy": 5, "terminos_intercambio_tot": 6,
        "precio_producto_lag_1": 4, "precio_producto_lag_3": 4, "precio_producto_lag_6": 4,
        "precio_producto_roll_mean_3": 4, "precio_producto_roll_std_6": 4,
    }
    out = gold_table(spark, sf)
    return out.select(
        "serie", "mes", "anio", "mes_num", *[rounded(c, d).alias(c) for c, d in digits.items()], "riesgo_spi", "riesgo_termico", "riesgo_inflacion"
    )


@query(
    "g01_spi_timeline",
    f"""WITH {BRAND_RAIN}, {spi_sql(3, 'brand_rain')} SELECT serie, mes, {r('v', 5)} AS spi_3, CASE WHEN v IS NULL THEN 'sin_dato' WHEN v <= -1.5 THEN 'severa' WHEN v <= -1 THEN 'moderada' WHEN v < 0 THEN 'seca' WHEN v < 1 THEN 'humeda' ELSE 'muy_humeda' END AS banda FROM spi""",
)
def spi_timeline(spark, sf):
    from granary.operators.presentation import spi_band

    out = climate.spi(brand_rain(spark, sf), "lluvia", "serie", "mes", 3, bounded=True)
    return out.select("serie", "mes", rounded("spi_3", 5).alias("spi_3"), spi_band(F.col("spi_3")).alias("banda"))


@query("g02_thermal_bars", f"WITH {THERMAL} SELECT serie, mes, {r('v', 6)} AS z, CASE WHEN coalesce({r('v', 6)}, 0) >= 0 THEN 'calido' ELSE 'frio' END AS color FROM thermal")
def thermal_bars(spark, sf):
    from granary.operators.presentation import heat_side

    out = climate.thermal_anomaly(monthly_discounts(spark, sf), "temp", "mes", "serie")
    return out.select("serie", "mes", rounded("anomalia_termica_z", 6).alias("z"), heat_side(rounded("anomalia_termica_z", 6)).alias("color"))


@query("g03_price_and_change", f"WITH {YOY} SELECT serie, mes, 'precio' AS curva, {r('precio', 4)} AS valor FROM yoy UNION ALL SELECT serie, mes, 'inflacion', {r('v', 4)} FROM yoy WHERE v IS NOT NULL")
def price_and_change(spark, sf):
    from granary.operators.presentation import dual_curve

    out = market_indices.yoy_inflation(monthly_prices(spark, sf), "precio", "serie", "mes", name="inflacion", bounded=True)
    return dual_curve(out, ["serie", "mes"], "precio", "inflacion").withColumn("valor", rounded("valor", 4))


@query("g04_yield_ranking", f"WITH y AS (SELECT c_mktsegment AS departamento, avg(o_totalprice) AS m FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) SELECT departamento, {r('m', 4)} AS rendimiento, row_number() OVER (ORDER BY m) AS puesto FROM y")
def yield_ranking(spark, sf):
    from granary.operators.presentation import ranking

    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    rows = o.join(c, o.o_custkey == c.c_custkey).select(F.col("c_mktsegment").alias("departamento"), "o_totalprice")
    return ranking(rows, "departamento", "o_totalprice", "rendimiento").withColumn("rendimiento", rounded("rendimiento", 4))


@query(
    "g05_executive_summary",
    f"""WITH {GOLD_SQL}, newest AS (SELECT * FROM gold QUALIFY row_number() OVER (ORDER BY mes DESC, serie DESC) = 1)
SELECT (SELECT count(*) FROM lineitem) AS filas_crudas, (SELECT count(*) FROM gold) AS filas_indicadores, mes AS ultimo_mes, {r('spi_3', 5)} AS spi_3, {r('z', 5)} AS anomalia_termica_z,
 {r('yoy', 5)} AS inflacion_yoy, {SPI_CASE.replace(' v ', ' spi_3 ')} AS riesgo_spi, {THERMAL_CASE.replace(' v ', ' z ')} AS riesgo_termico, {INFLATION_CASE.replace(' v ', ' yoy ')} AS riesgo_inflacion FROM newest""",
)
def executive_summary(spark, sf):
    from granary.operators.presentation import executive_summary as summarise

    out = summarise({"filas_crudas": lineitem(spark, sf)}, gold_table(spark, sf), "mes", "serie")
    return out.withColumns({c: rounded(c, 5) for c in ("spi_3", "anomalia_termica_z", "inflacion_yoy")})


# Rolling and calendar extras.
@query(
    "t11_cyclic_encodings",
    f"SELECT o_orderkey, {r('sin(2 * pi() * month(o_orderdate) / 12)', 6)} AS mes_sin, {r('cos(2 * pi() * month(o_orderdate) / 12)', 6)} AS mes_cos, {r('sin(2 * pi() * dayofweek(o_orderdate) / 7)', 6)} AS dia_sin, {r('cos(2 * pi() * dayofweek(o_orderdate) / 7)', 6)} AS dia_cos FROM orders",
)
def cyclic_encodings(spark, sf):
    o = table(spark, sf, "orders")
    ms, mc = features.cyclic(F.month("o_orderdate"), 12)
    ds, dc = features.cyclic(F.dayofweek("o_orderdate") - 1, 7)
    return o.select("o_orderkey", rounded(ms, 6).alias("mes_sin"), rounded(mc, 6).alias("mes_cos"), rounded(ds, 6).alias("dia_sin"), rounded(dc, 6).alias("dia_cos"))


def rolling_sql(key: str, size: int) -> str:
    return f"""WITH w AS (SELECT event_id, value, list(value) OVER f AS held, stddev_samp(value) OVER f / nullif(avg(value) OVER f, 0) AS cv FROM events WINDOW f AS (PARTITION BY {key} ORDER BY ts, event_id ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW)),
m AS (SELECT *, list_median(held) AS med FROM w)
SELECT event_id, {r('cv', 6)} AS value_roll_cv_{size}, {r('med', 6)} AS value_roll_median_{size}, {r('list_median(list_transform(held, lambda x: abs(x - med)))', 6)} AS value_roll_mad_{size} FROM m"""


def rolling_rows(spark, sf, key: str, size: int):
    rows = table(spark, sf, "events").select("event_id", key, "ts", "value")
    out = features.add_rolling_robust(rows, "value", size, key, ["ts", "event_id"])
    return out.select("event_id", *[rounded(c, 6).alias(c) for c in (f"value_roll_{what}_{size}" for what in ("cv", "median", "mad"))])


@query("t12_rolling_robust", rolling_sql("user_id", 7))
def rolling_robust(spark, sf):
    return rolling_rows(spark, sf, "user_id", 7)


@query("t12_rolling_robust_year", rolling_sql("event_type", 365))
def rolling_robust_year(spark, sf):
    return rolling_rows(spark, sf, "event_type", 365)


@query(
    "t13_period_change",
    f"WITH d AS (SELECT event_type, CAST(ts AS DATE) AS dia, sum(value) AS v FROM events GROUP BY 1, 2) SELECT event_type, dia, {r('(v - lag(v, 7) OVER w) / nullif(lag(v, 7) OVER w, 0) * 100', 5)} AS v_pct_7, {r('(v - lag(v, 1) OVER w) / nullif(lag(v, 1) OVER w, 0) * 100', 5)} AS v_pct_1 FROM d WINDOW w AS (PARTITION BY event_type ORDER BY dia)",
)
def period_change(spark, sf):
    daily = table(spark, sf, "events").groupBy("event_type", F.col("ts").cast("date").alias("dia")).agg(F.sum("value").alias("v"))
    out = features.add_change(daily, "v", [1, 7], "event_type", "dia", bounded=True)
    return out.select("event_type", "dia", rounded("v_pct_1", 5).alias("v_pct_1"), rounded("v_pct_7", 5).alias("v_pct_7"))
