"""The ranged routes for large groups give what plain windows and brute force give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.operators import hypothesis as ht
from granary.operators import market, market_indices, profiling, robust
from granary.operators.climate import spi
from granary.operators.features import add_lags, add_rolling
from granary.operators.ordered import average_ranks, over_history, row_positions, running_total
from granary.operators.quantiles import exact_quantiles, median_and_mad


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(3)
    rows = []
    # One series holds most of the rows; values repeat, and some are missing.
    for key, n in (("hot", 60), ("b", 9), (None, 5), ("c", 1)):
        for t in range(n):
            v = float(rng.integers(0, 12))
            rows.append((key, t, None if rng.random() < 0.15 else v))
    return spark.createDataFrame(rows, "k string, t int, v double").repartition(3).cache()


def same(a, b):
    cols = a.columns
    rounded = lambda d: d.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in d.dtypes])
    x, y = rounded(a), rounded(b.select(*cols))
    assert x.count() == y.count()
    assert x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()




def order():
    return [F.col("t").asc()]


def test_running_total_and_positions(series, tiny_groups):
    same(running_total(series, ["k"], order(), {"s": F.coalesce("v", F.lit(0.0))}, True), running_total(series, ["k"], order(), {"s": F.coalesce("v", F.lit(0.0))}))
    same(row_positions(series, ["k"], order(), "p", True), row_positions(series, ["k"], order(), "p"))


def test_history_features(series, tiny_groups):
    same(add_lags(series, "v", [1, 3, 6], "k", "t", True), add_lags(series, "v", [1, 3, 6], "k", "t"))
    same(add_rolling(series, "v", [3, 6], "k", "t", True), add_rolling(series, "v", [3, 6], "k", "t"))
    deep = lambda w: {"x": F.sum("v").over(w.rowsBetween(-20, 0))}
    same(over_history(series, ["k"], order(), 20, deep, True), over_history(series, ["k"], order(), 20, deep))


def test_ranks_and_quantiles(series, tiny_groups):
    same(average_ranks(series, ["k"], "v", bounded=True), average_ranks(series, ["k"], "v"))
    probs = {"a": 0.01, "b": 0.25, "c": 0.5, "d": 0.99}
    same(exact_quantiles(series, ["k"], "v", probs, True), exact_quantiles(series, ["k"], "v", probs))
    same(exact_quantiles(series, [], "v", probs, True), exact_quantiles(series, [], "v", probs))
    same(median_and_mad(series, ["k"], "v", True), median_and_mad(series, ["k"], "v"))


def test_spi_and_base_period(series, tiny_groups):
    a = spi(series, "v", "k", "t", [1, 3], bounded=True)
    assert a.filter("spi_1 is not null").count() > 0
    same(a, spi(series, "v", "k", "t", [1, 3]))
    for k in (0, 2, -1, -3):
        same(market_indices.kth_value(series, "v", "k", "t", k, True), market_indices.kth_value(series, "v", "k", "t", k))


def test_fills(series, tiny_groups):
    same(market_indices.forward_fill(series, ["k"], ["t"], "v", "f", True), market_indices.forward_fill(series, ["k"], ["t"], "v", "f"))
    same(robust.interpolate(series, ["k"], "t", "v", True), robust.interpolate(series, ["k"], "t", "v"))


def test_market_measures(series, tiny_groups):
    known = series.filter("v is not null")
    same(market.concentration(known, ["k"], "t", "v", 3, True), market.concentration(known, ["k"], "t", "v", 3))
    same(market.lorenz(known, ["k"], "t", "v", True), market.lorenz(known, ["k"], "t", "v"))
    p = known.withColumn("p", F.col("v") / 12.0)
    same(market.benjamini_hochberg(p, "p", [], bounded=True), market.benjamini_hochberg(p, "p", []))


def brute_trend(x):
    s, slopes = 0, []
    for i in range(len(x)):
        for j in range(i + 1, len(x)):
            s += int(np.sign(x[j] - x[i]))
            slopes.append((x[j] - x[i]) / (j - i))
    return s, float(np.median(slopes)) if slopes else 0.0


def test_trend_against_brute_force(series):
    pdf = series.toPandas()
    want = {}
    for key, g in pdf.groupby("k", dropna=False):
        x = g.sort_values("t").v.dropna().to_numpy()
        want[key if isinstance(key, str) else None] = brute_trend(x)
    placed = ht.positions(series, ["k"], "v", ["t"], True)
    sizes = ht.series_sizes(placed, ["k"])
    s = {r.k: r.statistic_s for r in ht.rank_concordance(placed, ["k"], "v", sizes, True).collect()}
    slopes = {r.k: r.sens_slope for r in ht.median_slopes(placed, ["k"], "v", sizes, True).collect()}
    for key, (score, slope) in want.items():
        assert s[key] == score
        assert slopes[key] == pytest.approx(slope, abs=1e-9)


def test_kruskal_and_spearman_routes(series, tiny_groups):
    grouped = series.withColumn("g", F.col("t") % 3).withColumn("w", F.col("t") * 1.5)
    same(ht.group_differences(grouped, [], "v", "g", bounded=True), ht.group_differences(grouped, [], "v", "g"))
    same(ht.spearman(grouped, ["k"], "v", "w", True), ht.spearman(grouped, ["k"], "v", "w"))


def test_slope_search_for_long_series(spark):
    x = [3.0, 1.0, 4.0, 1.5, 9.0, 2.0, 6.0, 5.0, 3.5, 5.0, 8.0, 7.0]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(x)], "k string, t int, v double")
    placed = ht.positions(df, ["k"], "v", ["t"], True)
    found = ht._slopes_by_search(placed, ["k"], "v", ht.series_sizes(placed, ["k"]), probes=64).first()
    assert found.sens_slope == pytest.approx(brute_trend(x)[1], abs=1e-9)


def test_a_promise_of_short_series_is_checked(spark):
    from granary.operators.hypothesis import median_slopes, series_sizes

    placed = spark.range(50).select(F.lit("a").alias("g"), F.col("id").alias("pos"), (F.col("id") * 2.0).alias("v"))
    sizes = series_sizes(placed, ["g"])
    assert median_slopes(placed, ["g"], "v", sizes, bounded=True, limit=50).first()["sens_slope"] == 2.0
    with pytest.raises(Exception, match="more than the 49 rows"):
        median_slopes(placed, ["g"], "v", sizes, bounded=True, limit=49).collect()


def test_a_slope_search_that_does_not_settle_is_an_error(spark, monkeypatch):
    from granary.operators import hypothesis

    placed = spark.range(30).select(F.lit("a").alias("g"), F.col("id").alias("pos"), F.sin("id").alias("v"))
    monkeypatch.setattr(hypothesis, "SEARCH_ROUNDS", 1)
    with pytest.raises(RuntimeError, match="did not settle"):
        hypothesis.median_slopes(placed, ["g"], "v", hypothesis.series_sizes(placed, ["g"]), bounded=False, limit=5)


def test_composite_ranks_survive_values_that_are_not_repeatable(spark):
    """A floating sum may differ in its last digit each time it is computed."""
    import random

    shaken = F.udf(lambda i: i + random.random() * 1e-9, "double").asNondeterministic()
    items = spark.range(9).select("id", shaken("id").alias("v"))
    got = {r.id: r.percentile_score for r in market.composite_score(items, "id", {"v": 1.0}).collect()}
    assert got == {i: pytest.approx(i / 8) for i in range(9)}


def test_fences_do_not_gather_the_values_of_a_key(spark):
    long = spark.range(4000).select((F.col("id") % 2).cast("string").alias("k"), (F.col("id") % 50).cast("double").alias("v"))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = profiling.outside_fences(long, exact_quantiles(long, ["k"], "v", {"p25": 0.25, "p75": 0.75}), ["k"], "v", 0.1)
        plan = out._jdf.queryExecution().sparkPlan().toString()
        rows = {r.k: r.outliers_iqr_count for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert rows == {"0": 800, "1": 800}
