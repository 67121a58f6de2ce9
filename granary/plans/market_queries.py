"""Market questions over supplier, customer and brand revenue."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from granary.operators import features, hypothesis as ht, market, quantiles
from granary.plans.catalog import query
from granary.plans.inputs import PRICES, lineitem, month, monthly_prices, phi, r, rounded
from granary.session import table, written

REVENUE = "CAST(l_extendedprice * (1 - l_discount) AS DOUBLE)"


def revenue(spark, sf, *dimensions):
    """Line revenue by month and supplier, with ``origen``, ``destino`` (nations of supplier and customer) or ``marca`` on request.

    Only the tables of the wanted columns are joined: inner joins are not removed by the optimiser.
    """
    rows = lineitem(spark, sf)
    if "destino" in dimensions:
        o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
        # Orders meet their customers first, so that lines are moved once.
        placed = o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", F.col("c_nationkey").alias("destino"))
        rows = rows.join(placed, rows.l_orderkey == placed.o_orderkey)
    if "origen" in dimensions:
        s = table(spark, sf, "supplier")
        rows = rows.join(s, F.col("l_suppkey") == s.s_suppkey).withColumn("origen", F.col("s_nationkey"))
    if "marca" in dimensions:
        p = table(spark, sf, "part")
        rows = rows.join(p, F.col("l_partkey") == p.p_partkey).withColumn("marca", F.col("p_brand"))
    return rows.select(
        *dimensions,
        "l_suppkey",
        F.year("l_shipdate").alias("anio"),
        month("l_shipdate").alias("mes"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("valor"),
        F.col("l_quantity").alias("cantidad"),
    )


def chi2_p(x: str, df: str) -> str:
    """Upper tail of chi-square as SQL text."""
    z = f"((pow(greatest({x}, 0.0) / {df}, 1.0 / 3) - (1.0 - 2.0 / (9.0 * {df}))) / sqrt(2.0 / (9.0 * {df})))"
    return f"least(1.0, greatest(0.0, 1.0 - {phi(z)}))"


def f_p(x: str, above: str, below: str) -> str:
    """Upper tail of the F distribution as SQL text."""
    a, b, root = f"(2.0 / (9.0 * {above}))", f"(2.0 / (9.0 * {below}))", f"pow(greatest({x}, 0.0), 1.0 / 3)"
    z = f"(((1.0 - {b}) * {root} - (1.0 - {a})) / sqrt({b} * {root} * {root} + {a}))"
    return f"least(1.0, greatest(0.0, 1.0 - {phi(z)}))"


def decided(p: str) -> str:
    return f"CASE WHEN ({p}) IS NULL THEN 'INSUFICIENTE' WHEN ({p}) < 0.05 THEN 'RECHAZA_H0' ELSE 'NO_RECHAZA_H0' END"


REV = f"""rev AS (SELECT s_nationkey AS origen, c_nationkey AS destino, p_brand AS marca, l_suppkey, year(l_shipdate) AS anio, CAST(date_trunc('month', l_shipdate) AS DATE) AS mes, {REVENUE} AS valor, l_quantity AS cantidad
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)"""


@query(
    "t14_haversine_flow_share",
    f"""WITH {REV}, f AS (SELECT origen, destino, sum(cantidad) AS q FROM rev GROUP BY 1, 2), d AS (SELECT *, q / sum(q) OVER (PARTITION BY destino) AS cuota, radians(origen - 4.0) AS p1, radians(destino - 4.0) AS p2, radians((destino * 1.5 - 80) - (origen * 1.5 - 80)) AS dl FROM f)
SELECT origen, destino, {r('cuota', 6)} AS cuota, {r('2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin((p2 - p1) / 2), 2) + cos(p1) * cos(p2) * pow(sin(dl / 2), 2))))', 4)} AS km FROM d""",
)
def haversine_flow_share(spark, sf):
    flows = market.shares(revenue(spark, sf, "origen", "destino"), ["destino"], "origen", "cantidad")
    lat, lon = (lambda c: F.col(c) - 4.0), (lambda c: F.col(c) * 1.5 - 80)
    km = features.haversine_km(lat("origen"), lon("origen"), lat("destino"), lon("destino"))
    return flows.select("origen", "destino", rounded("share", 6).alias("cuota"), rounded(km, 4).alias("km"))


@query("t16_market_size_and_share", f"WITH {REV}, t AS (SELECT marca, sum(valor) AS total FROM rev GROUP BY 1) SELECT marca, {r('total', 1)} AS total, {r('total / sum(total) OVER ()', 6)} AS share FROM t")
def market_size(spark, sf):
    out = market.shares(revenue(spark, sf, "marca"), [], "marca", "valor")
    return out.select("marca", rounded("total", 1).alias("total"), rounded("share", 6).alias("share"))


@query("t16_growth_rate", f"WITH {REV}, y AS (SELECT marca, anio, sum(valor) AS v FROM rev GROUP BY 1, 2), e AS (SELECT marca, arg_min(v, anio) AS a, arg_max(v, anio) AS b, max(anio) - min(anio) AS n FROM y GROUP BY 1) SELECT marca, CAST(n AS INTEGER) AS span, {r('pow(b / a, 1.0 / n) - 1', 6)} AS cagr FROM e")
def growth_rate(spark, sf):
    yearly = revenue(spark, sf, "marca").groupBy("marca", "anio").agg(F.sum("valor").alias("v"))
    return market.growth_rate(yearly, ["marca"], "anio", "v").withColumn("cagr", rounded("cagr", 6))


@query(
    "t17_centre_and_spread",
    f"WITH {REV}, m AS (SELECT marca, mes, sum(valor) AS v FROM rev GROUP BY 1, 2) SELECT marca, {r('avg(v)', 2)} AS mean, {r('median(v)', 2)} AS median, {r('stddev_samp(v) / avg(v)', 6)} AS cv, {r('(quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / median(v)', 6)} AS iqr_over_median FROM m GROUP BY 1",
)
def centre_and_spread(spark, sf):
    monthly = revenue(spark, sf, "marca").groupBy("marca", "mes").agg(F.sum("valor").alias("v"))
    out = market.centre_and_spread(monthly, ["marca"], "v", bounded=True)
    return out.select("marca", rounded("mean", 2).alias("mean"), rounded("median", 2).alias("median"), rounded("cv", 6).alias("cv"), rounded("iqr_over_median", 6).alias("iqr_over_median"))


CONC = """tot AS (SELECT destino, l_suppkey, sum(valor) AS total FROM rev GROUP BY 1, 2), sh AS (SELECT *, total / sum(total) OVER (PARTITION BY destino) AS s, row_number() OVER (PARTITION BY destino ORDER BY total, l_suppkey) AS i, count(*) OVER (PARTITION BY destino) AS n FROM tot)"""


@query(
    "t18_concentration",
    f"WITH {REV}, {CONC} SELECT destino, max(n) AS items, {r('sum(s * s)', 6)} AS hhi, {r('sum(CASE WHEN i > n - 5 THEN s ELSE 0 END)', 6)} AS cr_k, {r('2 * sum(i * total) / (max(n) * sum(total)) - (max(n) + 1) / max(n)', 6)} AS gini FROM sh GROUP BY 1",
)
def concentration(spark, sf):
    out = market.concentration(revenue(spark, sf, "destino"), ["destino"], "l_suppkey", "valor")
    return out.select("destino", "items", *[rounded(c, 6).alias(c) for c in ("hhi", "cr_k", "gini")])


@query("t18_lorenz_curve", f"WITH {REV}, {CONC} SELECT destino, l_suppkey, {r('i / n', 6)} AS item_share, {r('sum(s) OVER (PARTITION BY destino ORDER BY i)', 6)} AS value_share FROM sh")
def lorenz_curve(spark, sf):
    out = market.lorenz(revenue(spark, sf, "destino"), ["destino"], "l_suppkey", "valor")
    return out.select("destino", "l_suppkey", rounded("item_share", 6).alias("item_share"), rounded("value_share", 6).alias("value_share"))


def offer_and_supply(spark, sf):
    li = lineitem(spark, sf)
    keys = ["l_suppkey", "mes"]
    rows = li.select("l_suppkey", month("l_shipdate").alias("mes"), "l_quantity", "l_returnflag")
    offer = rows.groupBy(*keys).agg(F.sum("l_quantity").alias("oferta"))
    supply = rows.filter("l_returnflag = 'A'").groupBy(*keys).agg(F.sum("l_quantity").alias("abasto"))
    return market.gap_rate(offer, supply, keys, "oferta", "abasto")


GAP = """gap AS (SELECT l_suppkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS mes, (sum(l_quantity) - coalesce(sum(l_quantity) FILTER (l_returnflag = 'A'), 0)) / nullif(sum(l_quantity), 0) AS gap FROM lineitem GROUP BY 1, 2)"""


@query("t19_gap_rate", f"WITH {GAP} SELECT l_suppkey, mes, {r('gap', 6)} AS gap FROM gap")
def gap_rate(spark, sf):
    return offer_and_supply(spark, sf).select("l_suppkey", "mes", rounded("gap", 6).alias("gap"))


@query("t19_gap_persistence", f"WITH {GAP}, b AS (SELECT *, lag(gap) OVER (PARTITION BY l_suppkey ORDER BY mes) AS prev FROM gap) SELECT l_suppkey, {r('corr(gap, prev)', 6)} AS r_1 FROM b WHERE prev IS NOT NULL GROUP BY 1")
def gap_persistence(spark, sf):
    out = market.autocorrelation(offer_and_supply(spark, sf), ["l_suppkey"], ["mes"], "gap", bounded=True)
    return out.select("l_suppkey", rounded("r_1", 6).alias("r_1"))


@query(
    "t20_slopes",
    f"""WITH {PRICES}, pos AS (SELECT serie, precio AS x, row_number() OVER (PARTITION BY serie ORDER BY mes) - 1 AS i FROM prices),
ts AS (SELECT a.serie, median((b.x - a.x) / (b.i - a.i)) AS slope FROM pos a JOIN pos b ON a.serie = b.serie AND a.i < b.i GROUP BY 1), ols AS (SELECT serie, regr_slope(x, i) AS slope FROM pos GROUP BY 1)
SELECT serie, {r('ols.slope', 5)} AS ols, {r('ts.slope', 5)} AS theil_sen FROM ols JOIN ts USING (serie)""",
)
def slopes(spark, sf):
    placed = ht.positions(monthly_prices(spark, sf), ["serie"], "precio", ["mes"], bounded=True)
    sen = ht.median_slopes(placed, ["serie"], "precio", ht.series_sizes(placed, ["serie"]), bounded=True)
    ols = market.line_slope(placed, ["serie"], "pos", "precio", "ols")
    return ols.join(sen, "serie").select("serie", rounded("ols", 5).alias("ols"), rounded("sens_slope", 5).alias("theil_sen"))


@query(
    "t21_pearson_spearman",
    f"""WITH s AS (SELECT l_returnflag AS g, l_quantity AS x, l_extendedprice AS y FROM lineitem), k AS (SELECT g, x, y, rank() OVER (PARTITION BY g ORDER BY x) + (count(*) OVER (PARTITION BY g, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY g ORDER BY y) + (count(*) OVER (PARTITION BY g, y) - 1) / 2.0 AS ry FROM s)
SELECT g AS l_returnflag, {r('corr(x, y)', 6)} AS r, {r('corr(rx, ry)', 6)} AS rho FROM k GROUP BY 1""",
)
def pearson_spearman(spark, sf):
    li = lineitem(spark, sf)
    p = market.pearson(li, ["l_returnflag"], "l_quantity", "l_extendedprice")
    s = ht.spearman(li, ["l_returnflag"], "l_quantity", "l_extendedprice")
    return p.join(s, "l_returnflag").select("l_returnflag", rounded("r", 6).alias("r"), rounded("rho", 6).alias("rho"))


MONTHLY = f"""mon AS (SELECT p_brand AS marca, CAST(date_trunc('month', l_shipdate) AS DATE) AS mes, sum(l_quantity) AS q, avg(l_extendedprice / l_quantity) AS p FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""


def monthly_market(spark, sf):
    li, p = lineitem(spark, sf), table(spark, sf, "part")
    return li.join(p, li.l_partkey == p.p_partkey).groupBy(F.col("p_brand").alias("marca"), month("l_shipdate").alias("mes")).agg(
        F.sum("l_quantity").alias("q"), F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("p")
    )


@query(
    "t21_kendall",
    f"""WITH {MONTHLY}, n AS (SELECT marca, q, p, row_number() OVER (PARTITION BY marca ORDER BY mes) AS i FROM mon), s AS (SELECT a.marca, sum(sign(a.q - b.q) * sign(a.p - b.p)) AS s, sum(CASE WHEN a.q = b.q THEN 1 ELSE 0 END) AS tx, sum(CASE WHEN a.p = b.p THEN 1 ELSE 0 END) AS ty, count(*) AS n0 FROM n a JOIN n b ON a.marca = b.marca AND a.i < b.i GROUP BY 1)
SELECT marca, {r('s / sqrt((n0 - tx) * (n0 - ty))', 6)} AS tau FROM s""",
)
def kendall(spark, sf):
    return ht.kendall_tau(monthly_market(spark, sf), ["marca"], "q", "p", bounded=True).select("marca", rounded("tau", 6).alias("tau"))


@query("t21_lagged_pearson", f"WITH {MONTHLY}, b AS (SELECT *, lag(q, 2) OVER (PARTITION BY marca ORDER BY mes) AS back FROM mon) SELECT marca, {r('corr(p, back)', 6)} AS r_lag_2 FROM b WHERE back IS NOT NULL GROUP BY 1")
def lagged_pearson(spark, sf):
    out = market.lagged_pearson(monthly_market(spark, sf), ["marca"], ["mes"], "p", "q", 2, bounded=True)
    return out.select("marca", rounded("r_lag_2", 6).alias("r_lag_2"))


@query("t22_elasticity", f"WITH {MONTHLY} SELECT marca, {r('regr_slope(ln(p), ln(q))', 6)} AS elasticity, count(*) AS pairs FROM mon WHERE p > 0 AND q > 0 GROUP BY 1")
def elasticity(spark, sf):
    return market.elasticity(monthly_market(spark, sf), ["marca"], "q", "p").withColumn("elasticity", rounded("elasticity", 6))


@query(
    "t23_seasonal_index",
    f"WITH {MONTHLY}, a AS (SELECT marca, avg(q) AS g FROM mon GROUP BY 1) SELECT marca, month(mes) AS mes_num, {r('avg(q)', 4)} AS mean, {r('median(q)', 4)} AS median, {r('avg(q) / any_value(g)', 6)} AS seasonal_index FROM mon JOIN a USING (marca) GROUP BY 1, 2",
)
def seasonal_index(spark, sf):
    out = market.seasonal_profile(monthly_market(spark, sf), ["marca"], "mes", "q", bounded=True)
    return out.select("marca", "mes_num", rounded("mean", 4).alias("mean"), rounded("median", 4).alias("median"), rounded("seasonal_index", 6).alias("seasonal_index"))


@query(
    "t23_peak_months",
    f"WITH {MONTHLY}, s AS (SELECT marca, month(mes) AS m, avg(p) AS a, median(p) AS b FROM mon GROUP BY 1, 2) SELECT marca, arg_max(m, (a, -m)) AS peak_mean, arg_max(m, (b, -m)) AS peak_median FROM s GROUP BY 1",
)
def peak_months(spark, sf):
    profile = market.seasonal_profile(monthly_market(spark, sf), ["marca"], "mes", "p", bounded=True)
    return market.peak_months(profile, ["marca"])


@query("t24_value_ratio", f"WITH {REV} SELECT marca, {r('sum(valor) / sum(cantidad)', 4)} AS ratio_sums, {r('median(valor) / median(cantidad)', 4)} AS ratio_medians FROM rev GROUP BY 1")
def value_ratio(spark, sf):
    out = market.value_ratio(revenue(spark, sf, "marca"), ["marca"], "valor", "cantidad")
    return out.select("marca", rounded("ratio_sums", 4).alias("ratio_sums"), rounded("ratio_medians", 4).alias("ratio_medians"))


ITEMS = f"""item AS (SELECT marca, sum(valor) AS valor, sum(cantidad) AS cantidad FROM rev GROUP BY 1)"""


@query(
    "t25_composite_score",
    f"""WITH {REV}, {ITEMS}, st AS (SELECT avg(valor) AS m1, stddev_samp(valor) AS s1, avg(cantidad) AS m2, stddev_samp(cantidad) AS s2 FROM item)
SELECT marca, {r('0.6 * (valor - m1) / s1 + 0.4 * (cantidad - m2) / s2', 6)} AS z_score, {r('0.6 * pv + 0.4 * pq', 6)} AS percentile_score FROM (SELECT *, percent_rank() OVER (ORDER BY valor) AS pv, percent_rank() OVER (ORDER BY cantidad) AS pq FROM item) CROSS JOIN st""",
)
def composite_score(spark, sf):
    items = revenue(spark, sf, "marca").groupBy("marca").agg(F.sum("valor").alias("valor"), F.sum("cantidad").alias("cantidad"))
    out = market.composite_score(items, "marca", {"valor": 0.6, "cantidad": 0.4})
    return out.select("marca", rounded("z_score", 6).alias("z_score"), rounded("percentile_score", 6).alias("percentile_score"))


@query(
    "t26_question_mart",
    f"""WITH {MONTHLY}, a AS (SELECT 'A1' AS pregunta_id, sum(q) AS p1, median(q) * count(*) AS p2 FROM mon), b AS (SELECT 'B1', avg(q), median(q) FROM mon), e AS (SELECT 'E1', stddev_samp(p) / avg(p), (quantile_cont(p, 0.75) - quantile_cont(p, 0.25)) / median(p) FROM mon),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM e), mo AS (SELECT avg(q) AS m, count(*) AS n FROM mon), c AS (SELECT avg((q - m) ** 2) AS v, avg((q - m) ** 3) AS m3, avg((q - m) ** 4) AS m4, any_value(n) AS n FROM mon, mo),
k AS (SELECT CASE WHEN exp(-0.5 * (n / 6.0 * ((m3 / v ** 1.5) ** 2 + (m4 / v ** 2 - 3) ** 2 / 4))) < 0.05 OR abs(m3 / v ** 1.5) > 1 THEN 'ROBUSTO' ELSE 'PARAMETRICO' END AS motor FROM c)
SELECT pregunta_id, {r('p1', 5)} AS metrica_parametrica, {r('p2', 5)} AS metrica_no_parametrica, motor, CASE WHEN motor = 'ROBUSTO' THEN {r('p2', 5)} ELSE {r('p1', 5)} END AS metrica_elegida FROM u CROSS JOIN k""",
)
def question_mart(spark, sf):
    m = monthly_market(spark, sf)
    mid = lambda c, p: market.exact_quantiles(m, [], c, {"x": p}, bounded=None)
    centre = market.centre_and_spread(m, [], "p")
    size = m.agg(F.sum("q"))
    robust_size = mid("q", 0.5).join(m.agg(F.count(F.lit(1)).alias("n")), on=F.lit(True)).select(F.col("x") * F.col("n"))
    answers = [
        market.dual_answer("A1", "Tamaño del mercado", "unidades", size, robust_size),
        market.dual_answer("B1", "Volumen mensual", "unidades", m.agg(F.avg("q")), mid("q", 0.5)),
        market.dual_answer("E1", "Volatilidad del precio", "razón", centre.select("cv"), centre.select("iqr_over_median")),
    ]
    out = market.question_mart(answers, m, "q")
    nums = ("metrica_parametrica", "metrica_no_parametrica", "metrica_elegida")
    return out.select("pregunta_id", "motor", *[rounded(c, 5).alias(c) for c in nums])


LB = " + ".join(f"pow(sum(e * b{k}) / sum(e * e), 2) / (count(*) - {k})" for k in range(1, 6))


def item_answers(spark, sf):
    """The dual answers by brand of those questions that one monthly table can answer."""
    m = written(monthly_market(spark, sf).withColumn("v", F.col("q") * F.col("p")), "monthly")  # a row per brand and month
    by = ["marca"]
    spread = lambda c: (F.percentile(c, 0.75) - F.percentile(c, 0.25)) / F.median(c)
    base = m.groupBy(*by).agg(
        F.sum("v").alias("sum_v"), F.median("v").alias("med_v"), F.sum("q").alias("sum_q"), F.avg("q").alias("avg_q"), F.median("q").alias("med_q"),
        F.median("p").alias("med_p"), (F.median("q") * F.median("p") * F.count(F.lit(1))).alias("size"), (F.stddev_samp("q") / F.avg("q")).alias("cv_q"),
        spread("q").alias("rsd_q"), (F.stddev_samp("p") / F.avg("p")).alias("cv_p"), F.median(F.col("v") / F.col("q")).alias("med_unit"),
    )
    whole = base.agg(F.sum("sum_v").alias("all_v"), F.sum("med_v").alias("all_med"))
    mad = quantiles.median_and_mad(m, by, "p", bounded=True).select("marca", (F.col("mad") / F.col("median")).alias("mad_p"))
    yearly = m.groupBy("marca", F.year("mes").alias("anio")).agg(F.sum("v").alias("v"))
    logs = ht.positions(yearly.withColumn("lv", F.log("v")), by, "lv", ["anio"], bounded=True)
    growth = market.growth_rate(yearly, by, "anio", "v").select("marca", "cagr").join(_sen(logs, "lv", "sen_v"), "marca")
    placed = ht.positions(m, by, "p", ["mes"], bounded=True)
    slope = market.line_slope(placed, by, "pos", "p", "ols").join(_sen(placed, "p", "sen_p"), "marca")
    year_ago = F.lag("q", 12).over(Window.partitionBy(*by).orderBy("mes"))  # bounded by the calendar
    change = m.withColumn("d", F.col("q") / year_ago - 1).groupBy(*by).agg(F.avg("d").alias("avg_d"), F.median("d").alias("med_d"))
    together = market.pearson(m, by, "q", "p").join(ht.kendall_tau(m, by, "q", "p", bounded=True).select("marca", "tau"), "marca")
    months = m.groupBy("marca", F.month("mes").alias("k")).agg(F.avg("q").alias("a"), F.median("q").alias("b")).groupBy(*by).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    peaks = market.peak_months(market.seasonal_profile(m, by, "mes", "p", bounded=True), by)
    ranked = market.composite_score(base.select("marca", "sum_v", "sum_q"), "marca", {"sum_v": 0.6, "sum_q": 0.4}, bounded=True)
    wide = base.join(whole, on=F.lit(True), how="left")
    for other in (mad, growth, slope, change, together, months, peaks, ranked):
        wide = wide.join(other, "marca", "left")
    answers = {
        "A1": ("sum_v", "size"), "A2": (F.col("sum_v") / F.col("all_v"), F.col("med_v") / F.col("all_med")), "A3": ("cagr", "sen_v"), "B1": ("avg_q", "med_q"),
        "B2": ("avg_d", "med_d"), "B3": ("cv_q", "rsd_q"), "E1": ("cv_p", "mad_p"), "E2": ("ols", "sen_p"), "E3": ("r", "tau"),
        "F1": (F.col("a") / F.col("avg_q"), F.col("b") / F.col("med_q")), "F2": ("peak_mean", "peak_median"), "G1": ("sum_v", "med_v"),
        "G2": (F.col("sum_v") / F.col("sum_q"), F.col("med_v") / F.col("med_q")), "H4": (F.col("sum_v") / F.col("sum_q"), "med_unit"), "J1": ("z_score", "percentile_score"),
    }
    value = lambda c: (F.col(c) if isinstance(c, str) else c).cast("double")
    rows = F.array(*[F.struct(F.lit(k).alias("pregunta_id"), value(a).alias("metrica_parametrica"), value(b).alias("metrica_no_parametrica")) for k, (a, b) in answers.items()])
    return wide.select("marca", F.inline(rows))


def _sen(placed, value, name):
    found = ht.median_slopes(placed, ["marca"], value, ht.series_sizes(placed, ["marca"]), bounded=True)
    return found.select("marca", F.col("sens_slope").alias(name))


ITEM_SQL = {
    "A1": "SELECT marca, sum(v), median(q) * median(p) * count(*) FROM m GROUP BY 1",
    "A2": "SELECT marca, sv / sum(sv) OVER (), mv / sum(mv) OVER () FROM (SELECT marca, sum(v) AS sv, median(v) AS mv FROM m GROUP BY 1)",
    "A3": "SELECT c.marca, c.x, s.x FROM (SELECT marca, pow(arg_max(v, a) / arg_min(v, a), 1.0 / (max(a) - min(a))) - 1 AS x FROM y GROUP BY 1) c JOIN (SELECT s.marca, median((ln(t.v) - ln(s.v)) / (t.a - s.a)) AS x FROM y s JOIN y t ON s.marca = t.marca AND s.a < t.a GROUP BY 1) s USING (marca)",
    "B1": "SELECT marca, avg(q), median(q) FROM m GROUP BY 1",
    "B2": "SELECT marca, avg(d), median(d) FROM (SELECT marca, q / lag(q, 12) OVER (PARTITION BY marca ORDER BY mes) - 1 AS d FROM m) GROUP BY 1",
    "B3": "SELECT marca, stddev_samp(q) / avg(q), (quantile_cont(q, 0.75) - quantile_cont(q, 0.25)) / median(q) FROM m GROUP BY 1",
    "E1": "SELECT marca, stddev_samp(p) / avg(p), mad(p) / median(p) FROM m GROUP BY 1",
    "E2": "SELECT o.marca, o.x, s.x FROM (SELECT marca, regr_slope(p, i) AS x FROM pos GROUP BY 1) o JOIN (SELECT s.marca, median((t.p - s.p) / (t.i - s.i)) AS x FROM pos s JOIN pos t ON s.marca = t.marca AND s.i < t.i GROUP BY 1) s USING (marca)",
    "E3": "SELECT o.marca, o.x, s.s / sqrt((n0 - tx) * (n0 - ty)) FROM (SELECT marca, corr(q, p) AS x FROM m GROUP BY 1) o JOIN (SELECT s.marca, sum(sign(s.q - t.q) * sign(s.p - t.p)) AS s, sum(CASE WHEN s.q = t.q THEN 1 ELSE 0 END) AS tx, sum(CASE WHEN s.p = t.p THEN 1 ELSE 0 END) AS ty, count(*) AS n0 FROM pos s JOIN pos t ON s.marca = t.marca AND s.i < t.i GROUP BY 1) s USING (marca)",
    "F1": "SELECT marca, max(a) / any_value(g), max(b) / any_value(h) FROM (SELECT marca, month(mes), avg(q) AS a, median(q) AS b FROM m GROUP BY 1, 2) JOIN (SELECT marca, avg(q) AS g, median(q) AS h FROM m GROUP BY 1) USING (marca) GROUP BY 1",
    "F2": "SELECT marca, arg_max(k, (a, -k)), arg_max(k, (b, -k)) FROM (SELECT marca, month(mes) AS k, avg(p) AS a, median(p) AS b FROM m GROUP BY 1, 2) GROUP BY 1",
    "G1": "SELECT marca, sum(v), median(v) FROM m GROUP BY 1",
    "G2": "SELECT marca, sum(v) / sum(q), median(v) / median(q) FROM m GROUP BY 1",
    "H4": "SELECT marca, sum(v) / sum(q), median(v / q) FROM m GROUP BY 1",
    "J1": "SELECT marca, 0.6 * (sv - avg(sv) OVER ()) / stddev_samp(sv) OVER () + 0.4 * (sq - avg(sq) OVER ()) / stddev_samp(sq) OVER (), 0.6 * percent_rank() OVER (ORDER BY sv) + 0.4 * percent_rank() OVER (ORDER BY sq) FROM (SELECT marca, sum(v) AS sv, sum(q) AS sq FROM m GROUP BY 1)",
}


@query(
    "t26_item_mart",
    f"""WITH {MONTHLY}, m AS (SELECT *, q * p AS v FROM mon), y AS (SELECT marca, year(mes) AS a, sum(v) AS v FROM m GROUP BY 1, 2), pos AS (SELECT *, row_number() OVER (PARTITION BY marca ORDER BY mes) - 1 AS i FROM m)
SELECT pregunta_id, marca, {r('a', 4)} AS metrica_parametrica, {r('b', 4)} AS metrica_no_parametrica FROM ({' UNION ALL '.join(f"SELECT '{k}' AS pregunta_id, marca, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b FROM ({q}) AS t(marca, a, b)" for k, q in ITEM_SQL.items())})""",
)
def item_mart(spark, sf):
    """The dual mart by item: fifteen of the questions on each brand."""
    rows = item_answers(spark, sf)
    return rows.select("pregunta_id", "marca", *[rounded(c, 4).alias(c) for c in ("metrica_parametrica", "metrica_no_parametrica")])


@query(
    "t27_ljung_box",
    f"WITH {MONTHLY}, c AS (SELECT marca, mes, q - avg(q) OVER (PARTITION BY marca) AS e FROM mon), l AS (SELECT marca, e, {', '.join(f'lag(e, {k}) OVER (PARTITION BY marca ORDER BY mes) AS b{k}' for k in range(1, 6))} FROM c) SELECT marca, {r('q', 5)} AS ljung_box_q, {r(chi2_p('q', '5.0'), 5)} AS p_valor, {decided(chi2_p('q', '5.0'))} AS decision FROM (SELECT marca, count(*) * (count(*) + 2) * ({LB}) AS q FROM l GROUP BY 1)",
)
def ljung_box(spark, sf):
    return market.ljung_box(monthly_market(spark, sf), ["marca"], ["mes"], "q", bounded=True).withColumns({c: rounded(c, 5) for c in ("ljung_box_q", "p_valor")})


@query(
    "t27_levene",
    f"""WITH s AS (SELECT c_mktsegment AS g, o_totalprice AS x FROM orders JOIN customer ON o_custkey = c_custkey), md AS (SELECT g, median(x) AS m FROM s GROUP BY 1), z AS (SELECT g, abs(x - m) AS z FROM s JOIN md USING (g)),
a AS (SELECT g, count(*) AS n, avg(z) AS m, sum(z) AS sz FROM z GROUP BY 1), gr AS (SELECT sum(sz) / sum(n) AS grand, sum(n) AS nn, count(*) AS k FROM a), w AS (SELECT sum((z - m) ** 2) AS within FROM z JOIN a USING (g)), b AS (SELECT sum(n * (m - grand) ** 2) AS between_ FROM a, gr)
SELECT k AS n_groups, {r('f', 5)} AS levene_w, {r(f_p('f', '(k - 1.0)', '(nn - k)'), 5)} AS p_valor, {decided(f_p('f', '(k - 1.0)', '(nn - k)'))} AS decision FROM (SELECT k, nn, (nn - k) * between_ / ((k - 1) * within) AS f FROM gr, w, b)""",
)
def levene(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    out = market.levene(o.join(c, o.o_custkey == c.c_custkey), [], "o_totalprice", "c_mktsegment")
    return out.withColumns({c: rounded(c, 5) for c in ("levene_w", "p_valor")})


@query(
    "t27_granger",
    f"""WITH {MONTHLY}, l AS (SELECT marca, p AS y, lag(p) OVER w AS a, lag(q) OVER w AS b FROM mon WINDOW w AS (PARTITION BY marca ORDER BY mes)),
m AS (SELECT marca, count(*) AS t, covar_pop(y, y) * count(*) AS yy, covar_pop(a, a) * count(*) AS aa, covar_pop(b, b) * count(*) AS bb, covar_pop(a, b) * count(*) AS ab, covar_pop(a, y) * count(*) AS ay, covar_pop(b, y) * count(*) AS by_ FROM l WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1),
f AS (SELECT marca, t, yy - ay * ay / aa AS r0, yy - (ay * ay * bb - 2 * ay * by_ * ab + by_ * by_ * aa) / (aa * bb - ab * ab) AS r1 FROM m) SELECT marca, n, {r('f', 5)} AS granger_f, {r(f_p('f', '1.0', '(n - 3.0)'), 5)} AS p_valor, {decided(f_p('f', '1.0', '(n - 3.0)'))} AS decision FROM (SELECT marca, t AS n, (r0 - r1) / r1 * (t - 3) AS f FROM f)""",
)
def granger(spark, sf):
    out = market.granger(monthly_market(spark, sf), ["marca"], ["mes"], "q", "p", bounded=True)
    return out.withColumns({c: rounded(c, 5) for c in ("granger_f", "p_valor")})


@query(
    "t28_false_discovery_rate",
    f"""WITH p AS (SELECT event_id, (event_id * 7919 % 1009) / 1009.0 * (value % 1) AS p FROM events), n AS (SELECT *, count(*) OVER () AS m, count(*) OVER (ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS j FROM p)
SELECT event_id, {r('least(1.0, min(p * m / j) OVER (ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))', 6)} AS p_ajustado FROM n""",
)
def false_discovery_rate(spark, sf):
    ev = table(spark, sf, "events").select("event_id", ((F.col("event_id") * 7919 % 1009) / 1009.0 * (F.col("value") % 1)).alias("p"))
    return market.benjamini_hochberg(ev, "p", ["event_id"]).select("event_id", rounded("p_ajustado", 6).alias("p_ajustado"))


@query(
    "t29_forecast_errors",
    f"""WITH {MONTHLY}, f AS (SELECT marca, q AS y, lag(q) OVER (PARTITION BY marca ORDER BY mes) AS h FROM mon), s AS (SELECT marca, count(*) AS n, sum(abs(y - h)) / sum(y) AS wape, sqrt(avg((y - h) ** 2)) AS rmse, 1 - sum((y - h) ** 2) / (var_pop(y) * count(*)) AS r2 FROM f WHERE h IS NOT NULL GROUP BY 1)
SELECT marca, {r('wape', 6)} AS wape, {r('rmse', 5)} AS rmse, {r('1 - (1 - r2) * (n - 1) / (n - 2)', 6)} AS r2_adj FROM s""",
)
def forecast_errors(spark, sf):
    m = features.add_lags(monthly_market(spark, sf), "q", [1], "marca", "mes", bounded=True).filter("q_lag_1 IS NOT NULL")
    out = market.forecast_errors(m, ["marca"], "q", "q_lag_1")
    return out.select("marca", rounded("wape", 6).alias("wape"), rounded("rmse", 5).alias("rmse"), rounded("r2_adj", 6).alias("r2_adj"))


@query(
    "t30_control_alerts",
    """WITH s AS (SELECT event_type, avg(value) AS mu, stddev_samp(value) AS sd, median(value) AS m FROM events GROUP BY 1), d AS (SELECT event_type, median(abs(value - m)) AS mad FROM events JOIN s USING (event_type) GROUP BY 1),
a AS (SELECT event_id, abs(value - mu) > 3 * sd AS x, abs(value - m) > 3 * mad AS y FROM events JOIN s USING (event_type) JOIN d USING (event_type)) SELECT event_id, CASE WHEN x AND y THEN 'ROJO' WHEN x OR y THEN 'AMARILLO' ELSE 'VERDE' END AS alerta FROM a""",
)
def control_alerts(spark, sf):
    out = market.control_alerts(table(spark, sf, "events").select("event_id", "event_type", "value"), ["event_type"], "value")
    return out.select("event_id", "alerta")


@query(
    "t31_monthly_harmonised",
    f"SELECT l_suppkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS mes, sum(l_quantity) AS volumen, {r('median(l_extendedprice)', 3)} AS precio_mediano FROM lineitem GROUP BY 1, 2",
)
def monthly_harmonised(spark, sf):
    out = market.monthly_harmonised(lineitem(spark, sf), ["l_suppkey"], "l_shipdate", "l_extendedprice", "l_quantity")
    return out.withColumn("precio_mediano", rounded("precio_mediano", 3))
