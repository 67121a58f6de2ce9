import math

from pyspark.sql import functions as F

from granary.operators.sketches import ProfileStore, column_sketches, merge_sketches, sketch_profile


def rows(spark, low, high):
    n = F.col("id")
    return spark.range(low, high, 1, 3).select(
        n, (n % 1000).cast("string").alias("word"), F.when(n % 10 == 0, F.lit(float("nan"))).otherwise(1e6 + (n * 7919) % 10007).alias("x"), F.lit(None).cast("date").alias("day")
    )


def test_merged_loads_equal_one_pass_over_all(spark, tmp_path):
    store = ProfileStore(spark, str(tmp_path))
    assert store.profile().count() == 0
    store.save(rows(spark, 0, 20_000), "2023")
    store.save(rows(spark, 20_000, 50_000), "2024")
    merged = {r["column"]: r for r in store.profile().collect()}
    whole = {r["column"]: r for r in sketch_profile(column_sketches(rows(spark, 0, 50_000), "all")).collect()}
    for c in ("id", "word", "x", "day"):
        for exact in ("total_rows", "null_count", "min", "max", "dtype"):
            assert merged[c][exact] == whole[c][exact]
    assert merged["day"]["null_count"] == 50_000 and merged["day"]["unique_estimate"] == 0 and merged["word"]["median"] is None
    assert merged["x"]["null_count"] == 5_000
    truth = rows(spark, 0, 50_000).where(~F.isnan("x")).agg(F.count_distinct("x"), F.avg("x"), F.stddev_samp("x")).first()
    assert abs(merged["x"]["unique_estimate"] / truth[0] - 1) < 0.025 and abs(merged["id"]["unique_estimate"] / 50_000 - 1) < 0.025
    assert math.isclose(merged["x"]["mean"], truth[1], rel_tol=1e-12) and math.isclose(merged["x"]["std"], truth[2], rel_tol=1e-9)
    for name, q in (("p05", 0.05), ("median", 0.5), ("p95", 0.95)):
        assert abs(merged["id"][name] / 50_000 - q) < 0.01


def test_a_load_saved_again_replaces_itself(spark, tmp_path):
    store = ProfileStore(spark, str(tmp_path))
    store.save(rows(spark, 0, 300), F.when(F.col("id") < 100, "a").otherwise("b"))
    store.save(rows(spark, 0, 50), "a")
    totals = {r["load"]: r["total_rows"] for r in store.state().where("column = 'id'").collect()}
    assert totals == {"a": 50, "b": 200}
    assert store.profile("a").where("column = 'id'").first()["total_rows"] == 50
    assert store.profile().where("column = 'id'").first()["total_rows"] == 250


def test_only_sketches_are_shuffled(spark):
    plan = column_sketches(rows(spark, 0, 100), "l")._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and plan.count("Exchange") == 1


def test_empty_table_and_odd_names(spark):
    assert column_sketches(rows(spark, 0, 0), "l").count() == 0
    odd = spark.createDataFrame([(1, [1, 2], 5.0), (2, None, None)], "`load` int, `a.b` array<int>, present_0 double")
    got = {r["column"]: r for r in sketch_profile(merge_sketches(column_sketches(odd, "l"))).collect()}
    assert set(got) == {"load", "a.b", "present_0"} and got["a.b"]["unique_estimate"] == 1 and got["present_0"]["std"] is None
    assert got["load"]["unique_estimate"] == 2
