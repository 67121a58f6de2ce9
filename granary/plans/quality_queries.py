"""Scorecards, personal data, outliers, imputation, lineage, catalogue and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import curation, quality, robust
from granary.plans.catalog import query
from granary.plans.inputs import lineitem, r, rounded
from granary.session import table, written


def scored(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("precio"),
        F.year("o_orderdate").alias("anio"),
        F.lpad((F.col("o_custkey") % 70000).cast("string"), 4, "0").alias("codigo"),
        (F.col("o_custkey") % 20 - 5.0).alias("lat"),
        (F.col("o_custkey") % 15 - 82.0).alias("lon"),
    )


CHECKS = quality.Checks(
    key=["precio", "anio"],
    ranges={"precio": (1000.0, 1e9)},
    codes={"codigo": quality.CODE_PATTERN},
    geo=("lat", "lon"),
    times={"anio": (1996, 2030)},
    outliers=["precio"],
)

CARD = """o AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS precio, year(o_orderdate) AS anio, lpad(CAST(o_custkey % 70000 AS VARCHAR), 4, '0') AS codigo, o_custkey % 20 - 5.0 AS lat, o_custkey % 15 - 82.0 AS lon FROM orders),
q AS (SELECT quantile_cont(precio, 0.25) AS a, quantile_cont(precio, 0.75) AS b FROM o),
m AS (
""" + "".join(
    f"SELECT 'null_rate_{c}' AS check_name, 'Completeness' AS dimension, 0.4 AS threshold, (count(*) - count({c})) / count(*) AS v FROM o UNION ALL\n"
    for c in ("o_orderkey", "precio", "anio", "codigo", "lat", "lon")
) + """SELECT 'range_check_precio', 'Validity', 0.01, count(*) FILTER (precio NOT BETWEEN 1000 AND 1e9) / count(precio) FROM o UNION ALL
SELECT 'regex_codigo', 'Validity', 0.05, count(*) FILTER (NOT regexp_matches(codigo, '^\\d{5}$')) / count(codigo) FROM o UNION ALL
SELECT 'geobounds_consistency', 'Consistency', 0.1, count(*) FILTER (NOT (lat BETWEEN -4.3 AND 13.5 AND lon BETWEEN -82.0 AND -66.8)) / count(lat) FROM o UNION ALL
SELECT 'timeliness_bounds_anio', 'Timeliness', 0.01, count(*) FILTER (anio NOT BETWEEN 1996 AND 2030) / count(anio) FROM o UNION ALL
SELECT 'row_deduplication_check', 'Uniqueness', 0.01, ((SELECT count(*) FROM o) - (SELECT count(*) FROM (SELECT DISTINCT * FROM o))) / (SELECT count(*) FROM o) UNION ALL
SELECT 'primary_key_uniqueness', 'Uniqueness', 0.0, ((SELECT count(*) FROM o) - (SELECT count(*) FROM (SELECT DISTINCT precio, anio FROM o))) / (SELECT count(*) FROM o) UNION ALL
SELECT 'extreme_outliers_iqr_precio', 'Accuracy', 0.05, count(*) FILTER (precio < a - 3 * (b - a) OR precio > b + 3 * (b - a)) / count(precio) FROM o, q),
card AS (SELECT check_name, dimension, CAST(threshold AS DOUBLE) AS threshold, CAST(v AS DOUBLE) AS v, CASE WHEN check_name LIKE 'range_check_%' AND v > threshold THEN 'FAILED' WHEN check_name LIKE 'range_check_%' AND v > 0 THEN 'WARNING'
  WHEN v <= threshold THEN 'PASSED' WHEN dimension IN ('Uniqueness', 'Completeness') THEN 'FAILED' ELSE 'WARNING' END AS status FROM m)"""


@query("t01_scorecard", f"WITH {CARD} SELECT check_name, dimension, threshold, {r('v', 6)} AS metric_value, status FROM card")
def scorecard(spark, sf):
    card = quality.scorecard(scored(spark, sf), CHECKS)
    return card.select("check_name", "dimension", "threshold", rounded("metric_value", 6).alias("metric_value"), "status")


SCORES = """s AS (SELECT 1 - avg(v) FILTER (dimension = 'Completeness') AS c, 1 - max(v) FILTER (check_name = 'primary_key_uniqueness') AS u, 1 - avg(v) FILTER (dimension = 'Validity') AS va,
  1 - avg(v) FILTER (dimension = 'Consistency') AS co, 1 - avg(v) FILTER (dimension = 'Timeliness') AS t, 1 - avg(v) FILTER (dimension = 'Accuracy') AS a,
  CASE WHEN count(*) FILTER (status = 'FAILED') > 0 THEN 'FAILED' WHEN count(*) FILTER (status = 'WARNING') > 0 THEN 'WARNING' ELSE 'PASSED' END AS status FROM card)"""


@query(
    "t02_dimension_scores",
    f"""WITH {CARD}, {SCORES} SELECT {r('c', 4)} AS "Completeness", {r('u', 4)} AS "Uniqueness", {r('va', 4)} AS "Validity", {r('co', 4)} AS "Consistency", {r('t', 4)} AS "Timeliness", {r('a', 4)} AS "Accuracy", {r('0.25*c + 0.20*u + 0.20*va + 0.15*co + 0.10*t + 0.10*a', 4)} AS overall_score, status FROM s""",
)
def dimension_scores(spark, sf):
    out = quality.dimension_scores(quality.scorecard(scored(spark, sf), CHECKS))
    return out.withColumns({c: rounded(c, 4) for c in out.columns if c != "status"})


@query(
    "t03_pseudonymise",
    r"""SELECT c_custkey, sha256('sal' || lower(trim(c_name))) AS c_name FROM customer""",
)
def pseudonymise(spark, sf):
    return curation.pseudonymise(table(spark, sf, "customer").select("c_custkey", "c_name"), ["c_name", "absent"], "sal")


@query(
    "t03_mask_personal_text",
    r"""SELECT doc_id, regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}', '[EMAIL]', 'g'), '\+?\d[\d\s().\-]{6,}\d', '[PHONE]', 'g') AS texto FROM documents""",
)
def mask_personal(spark, sf):
    return table(spark, sf, "documents").select("doc_id", curation.mask_personal(F.col("text")).alias("texto"))


MAD = """med AS (SELECT event_type, median(value) AS m FROM events GROUP BY 1), mad AS (SELECT event_type, any_value(m) AS m, median(abs(value - m)) AS d FROM events JOIN med USING (event_type) GROUP BY 1)"""


@query("t08_modified_z", f"WITH {MAD} SELECT event_id, {r('0.6745 * abs(value - m) / nullif(d, 0)', 6)} AS z_mad, 0.6745 * abs(value - m) / nullif(d, 0) > 3.5 AS alerta_mad FROM events JOIN mad USING (event_type)")
def modified_z(spark, sf):
    out = robust.modified_z(table(spark, sf, "events").select("event_id", "event_type", "value"), ["event_type"], "value")
    return out.select("event_id", rounded("z_mad", 6).alias("z_mad"), "alerta_mad")


@query("t09_winsorise", f"WITH q AS (SELECT event_type, quantile_cont(value, 0.01) AS a, quantile_cont(value, 0.99) AS b FROM events GROUP BY 1) SELECT event_id, {r('greatest(a, least(b, value))', 6)} AS value_wins FROM events JOIN q USING (event_type)")
def winsorise(spark, sf):
    out = robust.winsorise(table(spark, sf, "events").select("event_id", "event_type", "value"), ["event_type"], "value")
    return out.select("event_id", rounded("value_wins", 6).alias("value_wins"))


@query("t15_robust_scale", f"WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) AS b FROM events GROUP BY 1) SELECT event_id, {r('(value - m) / nullif(b - a, 0)', 6)} AS value_robust FROM events JOIN q USING (event_type)")
def robust_scale(spark, sf):
    out = robust.robust_scale(table(spark, sf, "events").select("event_id", "event_type", "value"), ["event_type"], "value")
    return out.select("event_id", rounded("value_robust", 6).alias("value_robust"))


def gappy(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select("event_id", "user_id", F.when(F.col("event_id") % 4 != 1, F.col("value")).alias("valor"))


@query("t10_impute_zero", "SELECT event_id, CASE WHEN event_id % 4 = 1 THEN 0.0 ELSE value END AS valor, event_id % 4 = 1 AS valor_is_imputed, CASE WHEN event_id % 4 = 1 THEN 'ZERO_FILL' ELSE 'ORIGINAL' END AS valor_impute_algo FROM events")
def impute_zero(spark, sf):
    return robust.impute_zero(gappy(spark, sf), "valor").drop("user_id")


@query(
    "t10_impute_mode",
    """WITH o AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS prioridad FROM orders),
c AS (SELECT o_custkey, prioridad, count(*) AS n FROM o WHERE prioridad IS NOT NULL GROUP BY 1, 2), m AS (SELECT o_custkey, prioridad AS moda FROM c QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, prioridad) = 1)
SELECT o_orderkey, coalesce(prioridad, moda) AS prioridad, prioridad IS NULL AND moda IS NOT NULL AS prioridad_is_imputed, CASE WHEN prioridad IS NULL AND moda IS NOT NULL THEN 'MODE' ELSE 'ORIGINAL' END AS prioridad_impute_algo FROM o LEFT JOIN m USING (o_custkey)""",
)
def impute_mode(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("prioridad"))
    return robust.impute_mode(o, ["o_custkey"], "prioridad").drop("o_custkey")


@query(
    "t10_interpolate",
    f"""WITH g AS (SELECT event_id, user_id, CASE WHEN event_id % 4 <> 1 THEN value END AS v FROM events),
p AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN event_id END IGNORE NULLS) OVER a AS x0, last_value(v IGNORE NULLS) OVER a AS y0, first_value(CASE WHEN v IS NOT NULL THEN event_id END IGNORE NULLS) OVER b AS x1, first_value(v IGNORE NULLS) OVER b AS y1
  FROM g WINDOW a AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, {r('coalesce(v, y0 + (y1 - y0) * (event_id - x0) / nullif(x1 - x0, 0))', 6)} AS valor, v IS NULL AND y0 IS NOT NULL AND y1 IS NOT NULL AS valor_is_imputed, CASE WHEN v IS NULL AND y0 IS NOT NULL AND y1 IS NOT NULL THEN 'LINEAR' ELSE 'ORIGINAL' END AS valor_impute_algo FROM p""",
)
def interpolate(spark, sf):
    return robust.interpolate(gappy(spark, sf), ["user_id"], "event_id", "valor").drop("user_id").withColumn("valor", rounded("valor", 6))


@query(
    "t10_drift_check",
    f"WITH a AS (SELECT stddev_samp(value) FILTER (event_id % 4 <> 1) AS s0, stddev_samp(CASE WHEN event_id % 4 = 1 THEN 0.0 ELSE value END) AS s1 FROM events) SELECT {r('s0', 6)} AS sd_original, {r('s1', 6)} AS sd_imputado, {r('abs(s1 - s0) / s0', 6)} AS deriva, abs(s1 - s0) / s0 < 0.10 AS aceptable FROM a",
)
def drift_check(spark, sf):
    g = gappy(spark, sf)
    out = robust.drift_check(g, robust.impute_zero(g, "valor"), "valor")
    return out.withColumns({c: rounded(c, 6) for c in ("sd_original", "sd_imputado", "deriva")})


@query("t32_lineage_node", "SELECT 'silver_lineas' AS node, 'SILVER' AS layer, (SELECT count(*) FROM lineitem) AS rows_in, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS rows_out, true AS misma_huella, true AS otra_huella, true AS con_duracion")
def lineage_node(spark, sf):
    """The fingerprint follows the content: the same for another layout, another if values change."""
    from granary.operators.cleaning import keep_first

    li = lineitem(spark, sf)
    kept, seconds = quality.timed(lambda: written(keep_first(li, ["l_orderkey", "l_linenumber"]), "silver"))
    node = lambda df, s=None: quality.lineage_node("silver_lineas", "SILVER", {"bronze_lineas": li}, df, s)
    changed = kept.withColumn("l_quantity", F.when(F.col("l_linenumber") == 7, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    prints = [node(df).select(F.col("fingerprint").alias(n)) for n, df in (("again", kept.repartition("l_orderkey")), ("other", changed))]
    out = node(kept, seconds).join(prints[0], on=F.lit(True), how="left").join(prints[1], on=F.lit(True), how="left")
    same = F.col("fingerprint") == F.col("again")
    return out.select("node", "layer", "rows_in", "rows_out", same.alias("misma_huella"), (F.col("fingerprint") != F.col("other")).alias("otra_huella"), (F.col("duration_s") > 0).alias("con_duracion"))


@query(
    "t33_column_catalogue",
    """SELECT 'c_custkey' AS "column", 'bigint' AS physical_type, 'Numeric' AS logical_type, count(*) > count(c_custkey) AS nullable, 'INTERNAL' AS sensitivity, CAST(min(c_custkey) AS VARCHAR) AS example FROM customer UNION ALL
SELECT 'c_name', 'string', 'Text', count(*) > count(c_name), 'PUBLIC', min(c_name) FROM customer UNION ALL
SELECT 'email', 'string', 'Text', true, 'CONFIDENTIAL_PII', '***'""",
)
def column_catalogue(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_name")).alias("email"))
    return quality.column_catalogue(c)


@query(
    "t34_text_chunks",
    """WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS page FROM documents),
c AS (SELECT doc_id, page, body, unnest(range(0, greatest((length(body) - 1) // 1000, 0) + 1)) AS part FROM p WHERE length(body) > 0)
SELECT doc_id AS source, CAST(page AS INTEGER) AS page_number, CAST(part + 1 AS INTEGER) AS chunk_id, substr(body, part * 1000 + 1, 1000) AS chunk_text, CAST(length(substr(body, part * 1000 + 1, 1000)) AS INTEGER) AS char_length FROM c WHERE length(substr(body, part * 1000 + 1, 1000)) > 0""",
)
def text_chunks(spark, sf):
    return curation.text_chunks(table(spark, sf, "documents"), "doc_id", "text", 1000)
