import hashlib
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.sources import paged_json
from granary.sources.files import content_fingerprint, file_hashes
from granary.sources.landing import CleanStore, IndicatorStore, Landing, cleaner_for
from granary.sources.nested_json import flatten_response
from granary.sources.partitioned import PartitionedTable
from granary.sources.star_store import StarStore


def test_landing_is_write_once_and_audited(spark, tmp_path):
    land = Landing(spark, str(tmp_path))
    df = spark.range(10).toDF("id")
    first = land.save_raw(df, "ICA", "censo").first()
    assert (first.dataset, first.rows, first.status) == ("ICA/censo.parquet", 10, "SAVED")
    again = land.save_raw(df.limit(3), "ICA", "censo").first()
    assert (again.rows, again.status, again.sha256) == (10, "EXISTING_UNCHANGED", first.sha256)
    assert land.verify_integrity().first().intact is True
    land.save_raw(df.limit(3), "ICA", "censo", overwrite=True)
    assert land.verify_integrity().first().intact is True
    df.limit(2).write.mode("overwrite").parquet(land.path("ICA", "censo"))
    assert land.verify_integrity().first().intact is False


def test_large_files_hash_piece_by_piece(spark, tmp_path):
    spark.range(5000).repartition(3).write.parquet(str(tmp_path / "t"))
    want = {f.name: (f.stat().st_size, hashlib.sha256(f.read_bytes()).hexdigest()) for f in (tmp_path / "t").glob("*.parquet")}
    for whole in (0, 10**9):
        assert {r.file: (r.bytes, r.sha256) for r in file_hashes(spark, str(tmp_path / "t"), whole).collect()} == want


def test_corrupt_manifest_is_an_empty_one(spark, tmp_path):
    (tmp_path / "_manifest").mkdir()
    (tmp_path / "_manifest" / "part-0.parquet").write_bytes(b"no parquet at all")
    assert Landing(spark, str(tmp_path)).manifest().count() == 0


def test_fingerprint_ignores_layout(spark):
    df = spark.range(100).withColumn("x", F.col("id") * 2)
    assert content_fingerprint(df).first() == content_fingerprint(df.repartition(7)).first()
    assert content_fingerprint(df).first() != content_fingerprint(df.withColumn("x", F.col("x") + 1)).first()


def test_pages(spark, tmp_path):
    for offset, page in ((0, [{"id": 1, "municipio": "A"}, {"id": 2, "municipio": "B"}]), (2, [{"id": 3}]), (4, {"error": "no list"})):
        folder = tmp_path / f"page_offset={offset}"
        folder.mkdir()
        (folder / "p.json").write_text(json.dumps(page))
    paged_json.register(spark)
    read = lambda **o: spark.read.format("paged_json").schema("id long, municipio string").options(path=str(tmp_path), limit=2, **o).load()
    assert sorted((r.id, r.municipio) for r in read().collect()) == [(1, "A"), (2, "B"), (3, None)]
    assert read(max_records=1).count() == 1
    (tmp_path / "page_offset=751").mkdir()
    (tmp_path / "page_offset=751" / "p.json").write_text(json.dumps([{"id": k} for k in (751, 752, 753)]))
    assert sorted(r.id for r in read().collect()) == [1, 2, 3, 751, 752, 753]
    assert read(max_records=753).count() == 5
    assert paged_json.plan_pages(120_000, 50_000, 110_000) == [(0, 50_000), (50_000, 50_000), (100_000, 10_000)]


def stub_reader(records, served=10**9):
    class Stub(paged_json.PagedReader):
        """An endpoint of so many records that answers with ``served`` of them at most."""

        asked = 0

        def fetch(self, offset, size):
            self.asked += 1
            return json.dumps([{"id": k} for k in range(offset, min(offset + min(size, served), records))])

    return Stub


def test_endpoint_without_total():
    schema = T.StructType([T.StructField("id", T.LongType())])
    for records in (0, 1, 2, 3, 4, 5, 16, 17, 1001):
        for cap in (None, 1, 3, 4):
            for served in (1, 2, 10):
                reader = stub_reader(records, served)(schema, {"url": "stub:", "limit": "2"} | ({"max_records": str(cap)} if cap else {}))
                pages = reader.partitions()
                want = list(range(records if cap is None else min(records, cap)))
                assert len(pages) == max(1, -(-len(want) // 2)) and reader.asked <= 24
                assert [r[0] for p in pages for r in reader.read(p)] == want
    reader = stub_reader(5)(schema, {"url": "stub:", "limit": "2", "total": "5"})
    assert [[r[0] for r in reader.read(p)] for p in reader.partitions()] == [[0, 1], [2, 3], [4]]


def test_records_that_arrive_after_planning_are_read():
    schema = T.StructType([T.StructField("id", T.LongType())])
    options = {"url": "stub:", "limit": "2"}
    pages = stub_reader(5)(schema, options).partitions()
    assert [r[0] for p in pages for r in stub_reader(9)(schema, options).read(p)] == list(range(9))


def test_an_endpoint_that_ignores_the_offset_is_refused():
    with pytest.raises(ValueError):
        paged_json.last_page(lambda k: True)
    assert [paged_json.last_page(lambda k, n=n: k < n) for n in range(40)] == list(range(-1, 39))


def test_endpoint_is_read_by_many_tasks(spark):
    reader = stub_reader(95)

    class StubPages(paged_json.PagedJson):
        @classmethod
        def name(cls):
            return "stub_pages"

        def reader(self, schema):
            return reader(schema, dict(self.options))

    spark.dataSource.register(StubPages)
    rows = spark.read.format("stub_pages").schema("id long").options(url="stub:", limit=10).load()
    assert rows.select("id", F.spark_partition_id().alias("p")).agg(F.count("*"), F.sum("id"), F.count_distinct("p")).first()[:] == (95, 95 * 94 // 2, 10)


def test_nested_response(spark):
    body = {"results": [{"result": {"data": {"dsr": {"DS": [{"PH": [{"DM0": [{"C": ["05001", "BOVINO", 7]}, {"C": []}, {"C": ["11001"]}]}]}]}}}}]}
    df = spark.createDataFrame([(json.dumps(body),), ("not json",)], "j string")
    out = flatten_response(df, "j")
    assert out.columns == ["col_0", "col_1", "col_2"]
    assert sorted(tuple(r) for r in out.collect()) == [("05001", "BOVINO", "7"), ("11001", None, None)]


def test_stores(spark, tmp_path):
    store = CleanStore(spark, str(tmp_path / "silver"))
    s = store.process_and_save(spark.createDataFrame([("á",), ("a",), ("b",)], "t string"), "x", "generic").first()
    assert (s.initial_rows, s.final_rows, s.removed_duplicates) == (3, 2, 1)
    gold = IndicatorStore(spark, str(tmp_path / "gold"))
    assert gold.save(spark.range(4), "g").first().rows == 4 and gold.load("g.parquet").count() == 4
    assert [cleaner_for(*a) for a in (("upra", "eva_2022"), ("dane", "exportaciones"), ("x", "temperatura"), ("dane", "y"), ("ica", "z"))] == ["eva", "trade", "ideam", "sipsa", "generic"]


def test_star_store(spark, tmp_path):
    w = StarStore(spark, str(tmp_path))
    w.initialize()
    assert w.table("fact_precios_sipsa").count() == 0
    row = spark.createDataFrame([(1, "U", "X")], "id_insumo int, nombre_insumo string, categoria_insumo string")
    w.load("dim_insumo", row)
    w.load("dim_insumo", w.table("dim_insumo").unionByName(row.withColumn("id_insumo", F.lit(2))))
    w.initialize()
    assert w.table("dim_insumo").count() == 2
    prices = spark.createDataFrame([(202301, "05001", 1, 2.0), (202412, "05001", 1, 3.0), (None, "05001", 1, 4.0)], w.table("fact_precios_sipsa").schema)
    w.load("fact_precios_sipsa", prices)
    w.load("fact_precios_sipsa", prices)
    assert w.table("fact_precios_sipsa").count() == 3
    w.load("fact_precios_sipsa", prices.where("id_tiempo = 202412").withColumn("precio_promedio", F.lit(9.0)))
    assert sorted(r.precio_promedio for r in w.table("fact_precios_sipsa").collect()) == [2.0, 4.0, 9.0]


def test_an_update_rewrites_touched_partitions_alone(spark, tmp_path):
    t = PartitionedTable(spark, str(tmp_path / "t"), "k int, v string, code string", "code")
    assert t.read().count() == 0
    t.load(spark.createDataFrame([(1, "a", "001"), (2, "a", "01"), (3, "b", None), (4, None, "02")], "k int, v string, code string"))
    files = lambda: {f for f in (tmp_path / "t").rglob("*.parquet")}
    before = files()
    got = t.update(F.col("v") == "b", {"v": F.lit("c")})
    assert [(r.code, r.affected_rows) for r in got.collect()] == [(None, 1)] and len(before - files()) == 1
    assert sorted(t.read().collect(), key=lambda r: r.k) == [(1, "a", "001"), (2, "a", "01"), (3, "c", None), (4, None, "02")]
    before = files()
    assert t.update(F.col("v") == "none", {"v": F.lit("x")}).count() == 0 and files() == before
    t.update(F.col("k").isin(1, 3), {"v": F.concat("v", F.lit("!"))})
    assert sorted(r.v for r in t.read().where("v IS NOT NULL").collect()) == ["a", "a!", "c!"]
    with pytest.raises(ValueError):
        t.update(F.lit(True), {"code": F.lit("x")})
