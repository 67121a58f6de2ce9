"""Sources and sinks, tried on the provided tables in the shared scratch folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.plans.catalog import query
from granary.plans.hypothesis_queries import battery_sql, full_battery
from granary.plans.feature_queries import GOLD_SQL, gold_table
from granary.plans.inputs import lineitem, r, rounded, telemetry
from granary.session import scratch_path, table
from granary.sources import paged_json
from granary.sources.files import content_fingerprint, file_hashes
from granary.sources.landing import CleanStore, IndicatorStore, Landing, sweep
from granary.sources.nested_json import flatten_response


@query("s01_parquet_scan", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity > 25 GROUP BY 1")
def parquet_scan(spark, sf):
    store = IndicatorStore(spark, sf)
    return store.load("lineitem").filter("l_quantity > 25").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


PAGE = 500


@query("s02_paged_records", "SELECT c_custkey AS clave, c_name AS nombre, c_acctbal AS saldo FROM customer")
def paged_records(spark, sf):
    """Customers land as page files, some longer than what is asked for and at offsets of any kind, and all come back."""
    c = table(spark, sf, "customer")
    path = scratch_path(spark, "pages")
    record = F.to_json(F.struct(F.col("c_custkey").alias("clave"), F.col("c_name").alias("nombre"), F.col("c_acctbal").alias("saldo")))
    paged = c.select(F.when(F.col("c_custkey") < 3 * PAGE / 2, 0).otherwise(F.floor(F.col("c_custkey") / PAGE) * PAGE + 7).cast("long").alias("page_offset"), record.alias("j"))
    # A page is a bounded group by construction.
    bodies = paged.groupBy("page_offset").agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ","), F.lit("]")).alias("value"))
    bodies.write.partitionBy("page_offset").text(path)
    paged_json.register(spark)
    return (
        spark.read.format("paged_json").schema("clave long, nombre string, saldo double").option("path", path).option("limit", PAGE).load()
    )


@query("s03_nested_response", "SELECT CAST(o_orderkey AS VARCHAR) AS col_0, o_orderpriority AS col_1, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS col_2 FROM orders")
def nested_response(spark, sf):
    o = table(spark, sf, "orders")
    long = F.array(F.col("o_orderkey").cast("string"), F.col("o_orderpriority"), F.col("o_custkey").cast("string"))
    values = F.when(F.col("o_orderstatus") == "F", F.slice(long, 1, 2)).otherwise(long)
    row = F.struct(values.alias("C"))
    empty = F.struct(F.array().cast("array<string>").alias("C"))
    ds = F.struct(F.array(F.struct(F.array(row, empty).alias("DM0")), F.struct(F.array(row, row).alias("DM0"))).alias("PH"))
    body = F.struct(F.array(F.struct(F.struct(F.struct(F.struct(F.array(ds).alias("DS")).alias("dsr")).alias("data")).alias("result"))).alias("results"))
    return flatten_response(o.select(F.to_json(body).alias("j")), "j")


@query("s04_landing_write_once", "SELECT 'ICA/pedidos.parquet' AS dataset, count(*) AS \"rows\", 'EXISTING_UNCHANGED' AS status FROM orders")
def landing_write_once(spark, sf):
    land = Landing(spark, scratch_path(spark, "bronze"))
    o = table(spark, sf, "orders")
    land.save_raw(o, "ICA", "pedidos")
    return land.save_raw(o.filter("o_orderstatus = 'F'"), "ICA", "pedidos").select("dataset", "rows", "status")


@query("s06_content_hash", "SELECT true AS hex_64, true AS same_content, count(*) AS \"rows\" FROM orders")
def content_hash(spark, sf):
    """File hashes are 64 hex digits; the fingerprint does not depend on the file layout."""
    path = scratch_path(spark, "hash")
    o = table(spark, sf, "orders")
    o.repartition(5).write.parquet(path)
    hashes = file_hashes(spark, path).agg(F.bool_and(F.col("sha256").rlike("^[0-9a-f]{64}$")).alias("hex_64"))
    a, b = content_fingerprint(o).alias("a"), content_fingerprint(spark.read.parquet(path)).alias("b")
    same = (F.col("a.hash_xor") == F.col("b.hash_xor")) & (F.col("a.hash_sum") == F.col("b.hash_sum"))
    both = a.join(b, on=F.lit(True)).select(same.alias("same_content"), F.col("b.rows").alias("rows"))
    return hashes.join(both, on=F.lit(True))


@query("s07_integrity_audit", "SELECT 'ica/pedidos.parquet' AS dataset, count(*) FILTER (o_orderstatus <> 'F') = 0 AS intact FROM orders UNION ALL SELECT 'ica/clientes.parquet', count(*) = (SELECT count(*) FROM customer) FROM customer")
def integrity_audit(spark, sf):
    land = Landing(spark, scratch_path(spark, "bronze"))
    o = table(spark, sf, "orders")
    land.save_raw(o, "ica", "pedidos")
    land.save_raw(table(spark, sf, "customer"), "ica", "clientes")
    # Somebody rewrites a landed dataset behind the manifest's back.
    o.filter("o_orderstatus = 'F'").write.mode("overwrite").parquet(land.path("ica", "pedidos"))
    return land.verify_integrity()


@query(
    "s08_clean_store",
    "WITH t AS (SELECT count(*) AS a FROM events), d AS (SELECT count(*) AS b FROM (SELECT DISTINCT user_id, date_trunc('hour', ts), event_type FROM events)) SELECT 'estaciones' AS dataset_name, a AS initial_rows, b AS final_rows, a - b AS removed_duplicates FROM t, d",
)
def clean_store(spark, sf):
    store = CleanStore(spark, scratch_path(spark, "silver"))
    return store.process_and_save(telemetry(spark, sf), "estaciones", "ideam").select("dataset_name", "initial_rows", "final_rows", "removed_duplicates")


@query("s09_indicator_store", f"WITH {GOLD_SQL} SELECT count(*) AS filas, {r('avg(spi_3)', 5)} AS spi_3 FROM gold")
def indicator_store(spark, sf):
    store = IndicatorStore(spark, scratch_path(spark, "gold"))
    store.save(gold_table(spark, sf), "indicadores")
    return store.load("indicadores").agg(F.count(F.lit(1)).alias("filas"), rounded(F.avg("spi_3"), 5).alias("spi_3"))


@query(
    "s10_hypothesis_sink",
    f"SELECT 'mart_hypothesis_tests' AS dataset_name, count(*) AS tests_evaluated, count(*) FILTER (decision LIKE 'RECHAZA%') AS rejected FROM ({battery_sql()})",
)
def hypothesis_sink(spark, sf):
    """The whole battery is stored and read back."""
    store = IndicatorStore(spark, scratch_path(spark, "gold"))
    saved = store.save(full_battery(spark, sf), "mart_hypothesis_tests")
    rejected = store.load("mart_hypothesis_tests").agg(F.count_if(F.col("decision").startswith("RECHAZA")).alias("rejected"))
    return saved.select("dataset_name", F.col("rows").alias("tests_evaluated")).join(rejected, on=F.lit(True), how="left")


@query(
    "s11_sweep",
    """SELECT 'estaciones_temperatura_silver' AS dataset_name, 'ideam' AS cleaner, (SELECT count(*) FROM events) AS initial_rows, (SELECT count(*) FROM (SELECT DISTINCT user_id, date_trunc('hour', ts), event_type FROM events)) AS final_rows
UNION ALL SELECT 'clientes_silver', 'generic', (SELECT count(*) FROM customer), (SELECT count(*) FROM (SELECT DISTINCT upper(c_mktsegment), c_nationkey FROM customer))
UNION ALL SELECT 'exportaciones_silver', 'trade', (SELECT count(*) FROM lineitem), (SELECT count(*) FROM (SELECT DISTINCT year(l_shipdate), l_returnflag FROM lineitem))""",
)
def sweep_layers(spark, sf):
    land = Landing(spark, scratch_path(spark, "bronze"))
    land.save_raw(telemetry(spark, sf), "IDEAM", "estaciones_temperatura")
    land.save_raw(table(spark, sf, "customer").select("c_mktsegment", "c_nationkey"), "ica", "clientes")
    trade = lineitem(spark, sf).select(F.year("l_shipdate").alias("a_o"), F.col("l_returnflag").alias("producto"), F.col("l_quantity").alias("exportaciones_en_volumen"))
    land.save_raw(trade, "dane", "exportaciones")
    return sweep(land, CleanStore(spark, scratch_path(spark, "silver"))).select("dataset_name", "cleaner", "initial_rows", "final_rows")
