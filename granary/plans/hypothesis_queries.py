"""The test battery and its parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import hypothesis as ht
from granary.plans.catalog import query
from granary.plans.inputs import PRICES, exact_quantile_sql, monthly_prices, phi, polynomial_sql, r, rounded
from granary.session import table

JB = """mom AS (SELECT {k}, count(*) AS n, avg(x) AS mu FROM {src} GROUP BY 1),
cen AS (SELECT {k}, n, avg((x - mu)**2) AS v, avg((x - mu)**3) AS m3, avg((x - mu)**4) AS m4 FROM {src} JOIN mom USING ({k}) GROUP BY 1, 2),
jb AS (SELECT {k}, n, m3 / v**1.5 AS sk, m4 / v**2 AS ku, n / 6.0 * ((m3 / v**1.5)**2 + (m4 / v**2 - 3)**2 / 4) AS jb FROM cen)"""


@query(
    "h01_normality",
    f"WITH src AS (SELECT event_type, value AS x FROM events), {JB.format(k='event_type', src='src')} SELECT event_type, n AS n_observations, {r('jb', 2)} AS statistic, {r('exp(-0.5 * jb)', 6)} AS p_value, {r('sk', 5)} AS skewness, {r('ku', 5)} AS kurtosis, exp(-0.5 * jb) < 0.05 AS alpha_05_rejected, exp(-0.5 * jb) < 0.01 AS alpha_01_rejected, CASE WHEN exp(-0.5 * jb) < 0.05 THEN 'RECHAZA_H0' ELSE 'NO_RECHAZA_H0' END AS decision FROM jb",
)
def normality(spark, sf):
    out = ht.normality(table(spark, sf, "events"), ["event_type"], "value")
    return out.withColumns({"statistic": rounded("statistic", 2), "p_value": rounded("p_value", 6), "skewness": rounded("skewness", 5), "kurtosis": rounded("kurtosis", 5)})


MK = f"""pos AS (SELECT serie, precio AS x, row_number() OVER (PARTITION BY serie ORDER BY mes) AS i FROM prices),
pairs AS (SELECT a.serie, sign(b.x - a.x) AS s, (b.x - a.x) / (b.i - a.i) AS slope FROM pos a JOIN pos b ON a.serie = b.serie AND a.i < b.i),
agg AS (SELECT serie, CAST(sum(s) AS BIGINT) AS s, median(slope) AS slope FROM pairs GROUP BY 1),
mk0 AS (SELECT serie, n, s, slope, CASE WHEN s = 0 THEN 0.0 ELSE (s - sign(s)) / sqrt(n * (n - 1) * (2 * n + 5) / 18.0) END AS z FROM agg JOIN (SELECT serie, count(*) AS n FROM pos GROUP BY 1) USING (serie)),
mk AS (SELECT *, least(1.0, greatest(0.0, 2 * (1 - {phi('abs(z)')}))) AS p FROM mk0)"""


@query(
    "h02_mann_kendall",
    f"WITH {PRICES}, {MK} SELECT serie, n AS n_observations, s AS statistic_s, {r('z', 5)} AS z_score, {r('p', 6)} AS p_value, {r('slope', 5)} AS sens_slope, CASE WHEN p >= 0.05 THEN 'ESTACIONARIA_SIN_TENDENCIA' WHEN s > 0 THEN 'ASCENDENTE' ELSE 'DESCENDENTE' END AS trend_direction, CASE WHEN p < 0.05 THEN 'RECHAZA_H0' ELSE 'NO_RECHAZA_H0' END AS decision FROM mk",
)
def mann_kendall(spark, sf):
    out = ht.mann_kendall(monthly_prices(spark, sf), ["serie"], "precio", ["mes"], bounded=True)
    return out.withColumns({"z_score": rounded("z_score", 5), "p_value": rounded("p_value", 6), "sens_slope": rounded("sens_slope", 5)})


ADF = """steps AS (SELECT {k}, x - lag(x) OVER (PARTITION BY {k} ORDER BY {o}) AS dy, lag(x) OVER (PARTITION BY {k} ORDER BY {o}) AS y FROM {src}),
fit AS (SELECT {k}, count(*) AS n, regr_count(dy, y) AS m, regr_slope(dy, y) AS b, regr_sxx(dy, y) AS sxx, regr_sxy(dy, y) AS sxy, regr_syy(dy, y) AS syy FROM steps GROUP BY 1),
adf AS (SELECT {k}, n, b / sqrt((syy - sxy * b) / m / sxx) AS t FROM fit)"""


@query(
    "h03_stationarity",
    f"WITH {PRICES}, src AS (SELECT serie, mes, precio AS x FROM prices), {ADF.format(k='serie', o='mes', src='src')} SELECT serie, n AS n_observations, {r('t', 5)} AS adf_statistic, {r('1 / (1 + exp(-2 * (t + 2.86)))', 6)} AS adf_pvalue, CASE WHEN 1 / (1 + exp(-2 * (t + 2.86))) < 0.05 THEN 'ESTACIONARIA_ESTRICTA' ELSE 'NO_CONCLUYENTE' END AS status, CASE WHEN 1 / (1 + exp(-2 * (t + 2.86))) < 0.05 THEN 'ESTACIONARIA' ELSE 'NO_ESTACIONARIA' END AS decision FROM adf",
)
def stationarity(spark, sf):
    out = ht.stationarity(monthly_prices(spark, sf), ["serie"], "precio", ["mes"], bounded=True)
    return out.drop("kpss_statistic", "kpss_pvalue").withColumns({"adf_statistic": rounded("adf_statistic", 5), "adf_pvalue": rounded("adf_pvalue", 6)})


def _moments(source: str, vector: str, least: str, name: str) -> str:
    """CTE {name}(serie, rows, m): moment matrix, as a list of lists, of a vector over the rows of {source} from position {least} on."""
    return f"""{name}_z AS MATERIALIZED (SELECT serie, {vector} AS z FROM {source} WHERE t >= {least}),
{name}_s AS (SELECT serie, i, j, sum(z[i] * z[j]) AS s, count(*) AS c FROM (SELECT serie, z, i, unnest(range(1, len(z) + 1)) AS j FROM (SELECT serie, z, unnest(range(1, len(z) + 1)) AS i FROM {name}_z)) GROUP BY ALL),
{name} AS (SELECT serie, any_value(c) AS rows, list(r ORDER BY i) AS m FROM (SELECT serie, i, any_value(c) AS c, list(s ORDER BY j) AS r FROM {name}_s GROUP BY serie, i) GROUP BY serie)"""


def _eliminated(name: str) -> str:
    """CTE {name}_e(serie, rows, k, m): what is left of the matrix after its first k variables are eliminated."""
    cell = "m[i][j] - m[i][1] * m[1][j] / m[1][1]"
    return f"""{name}_e AS (SELECT serie, rows, 0 AS k, m FROM {name} UNION ALL
  SELECT serie, rows, k + 1, list_transform(range(2, len(m) + 1), lambda i: list_transform(range(2, len(m) + 1), lambda j: {cell})) FROM {name}_e WHERE len(m) > 1)"""


AUGMENTED = f"""y AS (SELECT serie, row_number() OVER (PARTITION BY serie ORDER BY mes) - 1 AS t, precio - avg(precio) OVER (PARTITION BY serie) AS y, count(*) OVER (PARTITION BY serie) AS n FROM prices),
d AS (SELECT serie, n, t, lag(y) OVER w AS y1, y - lag(y) OVER w AS dy, CAST(greatest(0, least(ceil(12 * pow(n / 100.0, 0.25)), n // 2 - 2)) AS INTEGER) AS most FROM y WINDOW w AS (PARTITION BY serie ORDER BY t)),
h AS MATERIALIZED (SELECT *, list(dy) OVER (PARTITION BY serie ORDER BY t ROWS UNBOUNDED PRECEDING) AS hist FROM d),
{_moments('h', '[1.0, y1] || list_transform(range(1, most + 1), lambda j: hist[t + 1 - j]) || [dy]', 'most + 1', 'common')}, {_eliminated('common')},
best AS (SELECT serie, min({{'aic': rows * ln(m[len(m)][len(m)] / rows) + 2 * k, 'q': k - 2}}).q AS q FROM common_e WHERE k >= 2 GROUP BY serie),
hq AS (SELECT h.*, q FROM h JOIN best USING (serie)),
{_moments('hq', '[1.0] || list_transform(range(1, q + 1), lambda j: hist[t + 1 - j]) || [y1, dy]', 'q + 1', 'own')}, {_eliminated('own')},
aug AS (SELECT o.serie, n, q, m[1][2] / m[1][1] / sqrt((m[2][2] - m[1][2] * m[1][2] / m[1][1]) / (rows - q - 2) / m[1][1]) AS t
  FROM own_e o JOIN best b ON o.serie = b.serie AND o.k = q + 1 JOIN (SELECT serie, any_value(n) AS n FROM d GROUP BY 1) c ON c.serie = o.serie)"""
MACKINNON = f"(CASE WHEN t > 2.74 THEN 1.0 WHEN t < -18.83 THEN 0.0 WHEN t <= -1.61 THEN {phi('(2.1659 + 1.4412 * t + 0.038269 * t * t)')} ELSE {phi('(1.7339 + 0.93202 * t - 0.12745 * t * t - 0.010368 * t * t * t)')} END)"


@query(
    "h03_stationarity_aic",
    f"""WITH RECURSIVE {PRICES}, {AUGMENTED}, p AS (SELECT *, {MACKINNON} AS p FROM aug) SELECT serie, n AS n_observations, CAST(q AS INTEGER) AS adf_lags, {r('t', 4)} AS adf_statistic, {r('p', 5)} AS adf_pvalue,
  CASE WHEN p < 0.05 THEN 'ESTACIONARIA_ESTRICTA' ELSE 'NO_CONCLUYENTE' END AS status, CASE WHEN p < 0.05 THEN 'ESTACIONARIA' ELSE 'NO_ESTACIONARIA' END AS decision FROM p""",
)
def stationarity_aic(spark, sf):
    """Unit-root test with the number of lagged differences chosen by AIC."""
    out = ht.stationarity(monthly_prices(spark, sf), ["serie"], "precio", ["mes"], bounded=True, lags=None)
    return out.drop("kpss_statistic", "kpss_pvalue").withColumns({"adf_statistic": rounded("adf_statistic", 4), "adf_pvalue": rounded("adf_pvalue", 5)})


SHAPIRO = f"""sw_x AS (SELECT serie, precio - avg(precio) OVER (PARTITION BY serie) AS x, count(*) OVER (PARTITION BY serie) AS n, row_number() OVER (PARTITION BY serie ORDER BY precio) AS i FROM prices),
sw_m AS (SELECT *, {exact_quantile_sql('((i - 0.375) / (n + 0.25))')} AS m FROM sw_x),
sw_s AS (SELECT serie, n, sum(m * m) AS mm, sum(m * x) FILTER (i BETWEEN 3 AND n - 2) AS mx, sum(x * x) AS xx, max(m) AS m1, max(m) FILTER (i = n - 1) AS m2,
  max(x) - min(x) AS x1, max(x) FILTER (i = n - 1) - max(x) FILTER (i = 2) AS x2 FROM sw_m GROUP BY 1, 2),
sw_a AS (SELECT *, m1 / sqrt(mm) + {polynomial_sql(ht.SHAPIRO_OUTER, '(1 / sqrt(n))')} AS a1, m2 / sqrt(mm) + {polynomial_sql(ht.SHAPIRO_NEXT, '(1 / sqrt(n))')} AS a2 FROM sw_s),
sw_w AS (SELECT serie, n, pow(mx / sqrt((mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)) + a1 * x1 + a2 * x2, 2) / xx AS w FROM sw_a),
sw AS (SELECT serie, w, 1 - {phi(f"((ln(1 - w) - {polynomial_sql(ht.SHAPIRO_MEAN, 'ln(n)')}) / exp({polynomial_sql(ht.SHAPIRO_SPREAD, 'ln(n)')}))")} AS sp FROM sw_w)"""


@query(
    "h01_normality_shapiro",
    f"""WITH {PRICES}, src AS (SELECT serie, precio AS x FROM prices), {JB.format(k='serie', src='src')}, {SHAPIRO}, both_ AS (SELECT *, least(exp(-0.5 * jb), sp) AS p FROM jb JOIN sw USING (serie))
SELECT serie, n AS n_observations, {r('jb', 4)} AS statistic, {r('p', 6)} AS p_value, {r('w', 6)} AS shapiro_statistic, {r('sp', 6)} AS shapiro_pvalue,
  p < 0.05 AS alpha_05_rejected, p < 0.01 AS alpha_01_rejected, CASE WHEN p < 0.05 THEN 'RECHAZA_H0' ELSE 'NO_RECHAZA_H0' END AS decision FROM both_""",
)
def normality_shapiro(spark, sf):
    """Jarque-Bera and Shapiro-Wilk together; the smaller p-value decides."""
    out = ht.normality(monthly_prices(spark, sf), ["serie"], "precio", shapiro=True).drop("skewness", "kurtosis")
    return out.withColumns({"statistic": rounded("statistic", 4), **{c: rounded(c, 6) for c in ("p_value", "shapiro_statistic", "shapiro_pvalue")}})


KPSS = """e AS (SELECT serie, x - avg(x) OVER (PARTITION BY serie) AS e, count(*) OVER (PARTITION BY serie) AS n, row_number() OVER (PARTITION BY serie ORDER BY mes) AS i FROM src),
pilot AS (SELECT serie, max(n) AS n, greatest(CAST(floor(pow(max(n), 2.0 / 9.0)) AS INTEGER), 1) AS l0, sum(e * e) AS sse FROM e GROUP BY 1),
cov AS (SELECT a.serie, b.i - a.i AS j, sum(a.e * b.e) AS c FROM e a JOIN e b ON a.serie = b.serie AND b.i > a.i AND b.i - a.i <= 60 GROUP BY 1, 2),
auto AS (SELECT p.serie, p.n, p.sse, CAST(floor(1.1447 * pow(pow((2 * sum(j * c) / n) / ((sse + 2 * sum(c)) / n), 2), 1.0 / 3) * pow(n, 1.0 / 3)) AS INTEGER) AS l FROM pilot p JOIN cov ON cov.serie = p.serie AND j <= l0 GROUP BY p.serie, p.n, p.sse),
lr AS (SELECT a.serie, a.n, a.l, (a.sse + 2 * coalesce(sum((1 - j / (l + 1.0)) * c), 0)) / a.n AS s2 FROM auto a LEFT JOIN cov ON cov.serie = a.serie AND j <= l GROUP BY a.serie, a.n, a.l, a.sse),
cum AS (SELECT serie, sum(cs * cs) AS eta FROM (SELECT serie, sum(e) OVER (PARTITION BY serie ORDER BY i) AS cs FROM e) GROUP BY 1),
kpss AS (SELECT serie, n, l, eta / (n * n) / s2 AS k FROM lr JOIN cum USING (serie))"""


KPSS_P = "CASE WHEN k <= 0.347 THEN 0.10 WHEN k < 0.463 THEN 0.10 + (k - 0.347) * (0.05 - 0.10) / (0.463 - 0.347) WHEN k < 0.574 THEN 0.05 + (k - 0.463) * (0.025 - 0.05) / (0.574 - 0.463) WHEN k < 0.739 THEN 0.025 + (k - 0.574) * (0.01 - 0.025) / (0.739 - 0.574) ELSE 0.01 END"


@query(
    "h03_stationarity_kpss",
    f"""WITH {PRICES}, src AS (SELECT serie, mes, precio AS x FROM prices), {ADF.format(k='serie', o='mes', src='src')}, {KPSS},
both_ AS (SELECT adf.serie, adf.n, t, 1 / (1 + exp(-2 * (t + 2.86))) AS pa, k, {KPSS_P} AS pk FROM adf JOIN kpss ON adf.serie = kpss.serie)
SELECT serie, n AS n_observations, {r('t', 5)} AS adf_statistic, {r('pa', 6)} AS adf_pvalue, {r('k', 5)} AS kpss_statistic, {r('pk', 5)} AS kpss_pvalue,
  CASE WHEN pa < 0.05 AND pk >= 0.05 THEN 'ESTACIONARIA_ESTRICTA' WHEN pa >= 0.05 AND pk < 0.05 THEN 'NO_ESTACIONARIA_INTEGRADA' WHEN pa < 0.05 THEN 'ESTACIONARIA_CON_TENDENCIA' ELSE 'NO_CONCLUYENTE' END AS status,
  CASE WHEN pa < 0.05 THEN 'ESTACIONARIA' ELSE 'NO_ESTACIONARIA' END AS decision FROM both_""",
)
def stationarity_kpss(spark, sf):
    """Unit-root test crossed with KPSS."""
    out = ht.stationarity(monthly_prices(spark, sf), ["serie"], "precio", ["mes"], with_kpss=True, bounded=True)
    return out.withColumns({c: rounded(c, 6 if c == "adf_pvalue" else 5) for c in ("adf_statistic", "adf_pvalue", "kpss_statistic", "kpss_pvalue")})


@query(
    "h04_kpss",
    f"""WITH {PRICES}, src AS (SELECT serie, mes, precio AS x FROM prices), {KPSS}
SELECT serie, n AS n_observations, l AS lags, {r('k', 5)} AS kpss_statistic,
 {r('CASE WHEN k <= 0.347 THEN 0.10 WHEN k < 0.463 THEN 0.10 + (k - 0.347) * (0.05 - 0.10) / (0.463 - 0.347) WHEN k < 0.574 THEN 0.05 + (k - 0.463) * (0.025 - 0.05) / (0.574 - 0.463) WHEN k < 0.739 THEN 0.025 + (k - 0.574) * (0.01 - 0.025) / (0.739 - 0.574) ELSE 0.01 END', 5)} AS kpss_pvalue FROM kpss""",
)
def kpss(spark, sf):
    out = ht.kpss(monthly_prices(spark, sf), ["serie"], "precio", ["mes"], bounded=True)
    return out.withColumns({"kpss_statistic": rounded("kpss_statistic", 5), "kpss_pvalue": rounded("kpss_pvalue", 5)})


KW = """kw_n AS (SELECT {g} AS g FROM {src} WHERE x IS NOT NULL AND {g} IS NOT NULL GROUP BY 1 HAVING count(*) >= 3),
kw_in AS (SELECT {g} AS g, x FROM {src} WHERE {g} IN (SELECT g FROM kw_n)),
kw_r AS (SELECT g, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rk FROM kw_in),
kw_s AS (SELECT g, count(*) AS n, sum(rk) AS s FROM kw_r GROUP BY 1),
kw AS (SELECT count(*) AS n_groups, 12.0 / (sum(n) * (sum(n) + 1.0)) * sum(s * s / n) - 3.0 * (sum(n) + 1.0) AS h FROM kw_s)"""


@query(
    "h05_group_differences",
    f"WITH src AS (SELECT c_mktsegment, o_totalprice AS x FROM orders JOIN customer ON o_custkey = c_custkey), {KW.format(g='c_mktsegment', src='src')}, p AS (SELECT *, least(1.0, greatest(0.0, 1 - {phi('((h - (n_groups - 1)) / sqrt(2.0 * (n_groups - 1)))')})) AS p FROM kw) SELECT n_groups, {r('h', 4)} AS statistic, {r('p', 6)} AS p_value, CASE WHEN p < 0.05 THEN 'RECHAZA_H0' ELSE 'NO_RECHAZA_H0' END AS decision FROM p",
)
def group_differences(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    rows = o.join(c, o.o_custkey == c.c_custkey).select("o_totalprice", "c_mktsegment")
    out = ht.group_differences(rows, [], "o_totalprice", "c_mktsegment")
    return out.withColumns({"statistic": rounded("statistic", 4), "p_value": rounded("p_value", 6)})


def _mart_row(test, category, stat, p, decision_yes, decision_no, src):
    meaning = "CASE WHEN p < 0.05 THEN 'Evidencia contra la hipótesis nula al 5 %' ELSE 'Sin evidencia contra la hipótesis nula al 5 %' END"
    return f"SELECT variable, '{category}' AS categoria_prueba, '{test}' AS prueba, {r(f'round({stat}, 4)', 4)} AS estadistico, {r(p, 5)} AS p_valor, CASE WHEN p < 0.05 THEN '{decision_yes}' ELSE '{decision_no}' END AS decision, {meaning} AS interpretacion FROM {src}"


def battery_sql():
    long = "src AS (SELECT 'total' AS variable, dia, semana, total AS x FROM daily UNION ALL SELECT 'pedidos', dia, semana, pedidos FROM daily)"
    daily = "daily AS (SELECT CAST(o_orderdate AS DATE) AS dia, CAST(dayofweek(o_orderdate) AS VARCHAR) AS semana, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, CAST(count(*) AS DOUBLE) AS pedidos FROM orders GROUP BY 1, 2)"
    mk = MK.replace("SELECT serie, precio AS x, row_number() OVER (PARTITION BY serie ORDER BY mes) AS i FROM prices", "SELECT variable AS serie, x, row_number() OVER (PARTITION BY variable ORDER BY dia) AS i FROM src")
    jb = JB.format(k="variable", src="src")
    adf = ADF.format(k="variable", o="dia", src="src")
    kws = "kw_r AS (SELECT variable, semana AS g, rank() OVER (PARTITION BY variable ORDER BY x) + (count(*) OVER (PARTITION BY variable, x) - 1) / 2.0 AS rk FROM src), kw_s AS (SELECT variable, g, count(*) AS n, sum(rk) AS s FROM kw_r GROUP BY 1, 2), kw AS (SELECT variable, count(*) AS ng, 12.0 / (sum(n) * (sum(n) + 1.0)) * sum(s * s / n) - 3.0 * (sum(n) + 1.0) AS h FROM kw_s GROUP BY 1)"
    z = phi("((h - (ng - 1)) / sqrt(2.0 * (ng - 1)))")
    return f"""WITH {daily}, {long}, {jb}, {mk}, {adf}, {kws},
n_jb AS (SELECT variable, jb AS st, exp(-0.5 * jb) AS p FROM jb), n_mk AS (SELECT serie AS variable, z AS st, p FROM mk),
n_adf AS (SELECT variable, t AS st, 1 / (1 + exp(-2 * (t + 2.86))) AS p FROM adf), n_kw AS (SELECT variable, h AS st, least(1.0, greatest(0.0, 1 - {z})) AS p FROM kw)
{_mart_row('NORMALIDAD_JARQUE_BERA', 'Distribución', 'st', 'p', 'RECHAZA_H0', 'NO_RECHAZA_H0', 'n_jb')} UNION ALL
{_mart_row('MANN_KENDALL_TENDENCIA', 'Tendencia', 'st', 'p', 'RECHAZA_H0', 'NO_RECHAZA_H0', 'n_mk')} UNION ALL
{_mart_row('ESTACIONARIEDAD_ADF_KPSS', 'Estacionariedad', 'st', 'p', 'ESTACIONARIA', 'NO_ESTACIONARIA', 'n_adf')} UNION ALL
{_mart_row('KRUSKAL_WALLIS', 'Grupos_Regionales', 'st', 'p', 'RECHAZA_H0', 'NO_RECHAZA_H0', 'n_kw')}"""


def daily_orders(spark, sf):
    o = table(spark, sf, "orders")
    return o.groupBy(F.col("o_orderdate").cast("date").alias("dia"), (F.dayofweek("o_orderdate") - 1).cast("string").alias("semana")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"), F.count(F.lit(1)).cast("double").alias("pedidos")
    )


@query("h06_full_battery", battery_sql())
def full_battery(spark, sf):
    out = ht.full_battery(daily_orders(spark, sf), ["total", "pedidos", "absent"], ["dia"], "semana", bounded=True)
    return out.withColumns({"estadistico": rounded("estadistico", 4), "p_valor": rounded("p_valor", 5)})
