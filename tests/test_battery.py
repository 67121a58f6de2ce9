"""Special functions against the standard library, and the tests built on them against plain computations."""

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.functions import special
from granary.operators import hypothesis as ht
from granary.operators import lagged
from granary.operators.climate import LIKELIHOOD, gamma_fit, spi


def over(spark, values, fn):
    rows = spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "k int, x double")
    return [r.y for r in rows.select("k", fn(F.col("x")).alias("y")).orderBy("k").collect()]


def test_special_functions(spark):
    x = [1e-3, 0.1, 0.5, 1.0, 1.7, 2.5, 9.0, 40.0, 700.0]
    assert over(spark, x, special.log_gamma) == pytest.approx([math.lgamma(v) for v in x], rel=1e-12, abs=1e-12)
    euler = 0.57721566490153286
    assert over(spark, [1, 2, 0.5], special.digamma) == pytest.approx([-euler, 1 - euler, -euler - 2 * math.log(2)], abs=1e-12)
    assert over(spark, [1, 2, 0.5], special.trigamma) == pytest.approx([math.pi**2 / 6, math.pi**2 / 6 - 1, math.pi**2 / 2], rel=1e-12)
    p = [1e-6, 1e-3, 0.07, 0.0749, 0.3, 0.5, 0.9, 0.925001, 0.99999]
    assert over(spark, p, special.normal_quantile) == pytest.approx([statistics.NormalDist().inv_cdf(v) for v in p], rel=1e-12, abs=1e-14)


def test_incomplete_gamma(spark):
    # Integer shapes have a finite sum, halves an error function.
    whole = lambda a, x: 1 - math.exp(-x) * sum(x**k / math.factorial(k) for k in range(a))
    for a in (1, 3, 20, 90):
        x = [0.0, a * 0.3, a * 0.9, a + 0.99, a + 1.01, a * 1.5, a * 3.0]
        assert over(spark, x, lambda c: special.gamma_p(F.lit(float(a)), c)) == pytest.approx([whole(a, v) for v in x], abs=1e-11)
    x = [0.01, 0.4, 1.6, 8.0]
    assert over(spark, x, lambda c: special.gamma_p(F.lit(0.5), c)) == pytest.approx([math.erf(math.sqrt(v)) for v in x], abs=1e-12)


def test_likelihood_fit(spark):
    rng = np.random.default_rng(7)
    rows = [(k, float(v)) for k, shape in enumerate((0.2, 1.0, 6.0, 300.0)) for v in rng.gamma(shape, 3.0, 400)] + [(9, 5.0)] * 20
    got = {r.k: r for r in gamma_fit(spark.createDataFrame(rows, "k int, v double"), ["k"], "v", fit=LIKELIHOOD).collect()}
    closed = {r.k: r for r in gamma_fit(spark.createDataFrame(rows, "k int, v double"), ["k"], "v").collect()}
    for k in range(4):
        x = np.maximum(np.array([v for g, v in rows if g == k]), 1e-6)

        def score(a):
            slope = (math.lgamma(a * (1 + 1e-6)) - math.lgamma(a * (1 - 1e-6))) / (2e-6 * a)
            return math.log(a) - slope - (math.log(x.mean()) - np.log(x).mean())

        assert abs(score(got[k].shape)) < 1e-7 * max(1.0, 1 / got[k].shape)
        assert got[k].shape * got[k].scale == pytest.approx(x.mean())
        assert got[k].shape == pytest.approx(closed[k].shape, rel=0.15)
    assert got[9].shape == 1.0  # no spread


def test_likelihood_routes_agree(spark, tiny_groups):
    rng = np.random.default_rng(2)
    rows = [(k, t, float(max(0.0, rng.normal(3, 3)))) for k, n in (("a", 50), ("b", 20), (None, 14)) for t in range(n)]
    df = spark.createDataFrame(rows, "k string, t int, v double").repartition(3)
    short, long = (spi(df, "v", "k", "t", [1, 3], bounded=b, fit=LIKELIHOOD).orderBy("k", "t").collect() for b in (True, None))
    for a, b in zip(short, long):
        assert a.spi_1 == pytest.approx(b.spi_1, abs=1e-9) and a.spi_3 == pytest.approx(b.spi_3, abs=1e-9)


def test_shapiro_wilk(spark):
    # Samples with published results, and a large one.
    known = {
        "a": ([0.11, 7.87, 4.61, 10.14, 7.95, 3.14, 0.46, 4.43, 0.21, 4.75, 0.71, 1.52, 3.24, 0.93, 0.42, 4.97, 9.53, 4.55, 0.47, 6.66], 0.90047, 0.04209),
        "b": ([1.36, 1.14, 2.92, 2.55, 1.46, 1.06, 5.27, -1.11, 3.48, 1.10, 0.88, -0.51, 1.46, 0.52, 6.20, 1.69, 0.08, 3.67, 2.81, 3.49], 0.95903, 0.52460),
        "c": ([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], 0.78881, 0.00670),
    }
    rng = np.random.default_rng(1)
    rows = [(k, float(v)) for k, (x, _, _) in known.items() for v in x]
    rows += [("normal", float(v)) for v in rng.normal(size=3000)] + [("skew", float(v)) for v in rng.exponential(size=3000)]
    rows += [("long", float(v)) for v in rng.normal(size=5001)] + [("flat", 2.0)] * 9 + [("short", 1.0)] * 5
    got = {r.k: r for r in ht.shapiro_wilk(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    for k, (_, w, p) in known.items():
        assert (got[k].shapiro_statistic, got[k].shapiro_pvalue) == (pytest.approx(w, abs=2e-5), pytest.approx(p, abs=2e-5))
    assert got["normal"].shapiro_pvalue > 0.01 and got["skew"].shapiro_pvalue < 1e-6
    assert got["flat"].shapiro_statistic is None and set(got) == {"a", "b", "c", "normal", "skew", "flat"}
    both = {r.k: r for r in ht.normality(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", shapiro=True).collect()}
    plain = {r.k: r for r in ht.normality(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    assert both["a"].p_value == min(plain["a"].p_value, both["a"].shapiro_pvalue) and both["long"].p_value == plain["long"].p_value


def plain_unit_root(y, most):
    """(lags, t) by ordinary least squares for each number of lags."""
    y = np.asarray(y) - np.mean(y)
    dy = np.diff(y)

    def fit(lags, first):
        ends = np.arange(first, len(y))
        x = np.column_stack([np.ones(len(ends)), y[ends - 1], *[dy[ends - 1 - j] for j in range(1, lags + 1)]])
        beta, *_ = np.linalg.lstsq(x, dy[ends - 1], rcond=None)
        rest = ((dy[ends - 1] - x @ beta) ** 2).sum()
        error = math.sqrt(rest / (len(ends) - lags - 2) * np.linalg.inv(x.T @ x)[1, 1])
        return len(ends) * math.log(rest / len(ends)) + 2 * (lags + 2), beta[1] / error

    lags = min(range(most + 1), key=lambda k: fit(k, most + 1)[0])
    return lags, fit(lags, lags + 1)[1]


def test_unit_root(spark, tiny_groups):
    rng = np.random.default_rng(4)
    noise = rng.normal(size=120)
    series = {"walk": np.cumsum(noise), "stationary": noise, "seasonal": noise + 5 * np.sin(np.arange(120) * 2.1), "short": np.cumsum(rng.normal(size=16))}
    ar = [0.0, 0.0, 0.0, 0.0]
    for e in rng.normal(size=150):
        ar.append(0.5 * ar[-1] - 0.4 * ar[-4] + e)
    series["lagged"] = np.array(ar)
    rows = [(k, t, float(v)) for k, x in series.items() for t, v in enumerate(x)]
    df = spark.createDataFrame(rows, "k string, t int, v double").repartition(4)
    got = {r.k: r for r in ht.augmented_dickey_fuller(df, ["k"], "v", ["t"]).collect()}
    for k, x in series.items():
        most = min(math.ceil(12 * (len(x) / 100) ** 0.25), len(x) // 2 - 2)
        lags, t = plain_unit_root(x, most)
        assert (got[k].adf_lags, got[k].adf_statistic) == (lags, pytest.approx(t, rel=1e-7))
    assert got["stationary"].adf_pvalue < got["walk"].adf_pvalue
    none = {r.k: r for r in ht.stationarity(df, ["k"], "v", ["t"], lags=0).collect()}
    zero = {r.k: r for r in lagged.unit_root(ht.positions(df, ["k"], "v", ["t"]), ["k"], "v", 0).collect()}
    for k, x in series.items():  # without lags only the degrees of freedom differ
        m = len(x) - 1
        assert zero[k].lags == 0 and zero[k].t == pytest.approx(none[k].adf_statistic * math.sqrt((m - 2) / m))


def test_p_values_of_the_unit_root(spark):
    # Published 1, 5 and 10 % points for long series.
    assert over(spark, [-3.43, -2.86, -2.57, -30.0, 3.0], lagged.unit_root_p) == pytest.approx([0.01, 0.05, 0.10, 0.0, 1.0], abs=1e-3)


def test_lagged_products_without_a_join(spark, tiny_groups):
    rng = np.random.default_rng(8)
    series = {"hot": rng.normal(size=100), "b": rng.normal(size=8), None: rng.normal(size=3)}
    lags = {"hot": 11, "b": 7, None: 1}
    placed = spark.createDataFrame([(k, t, float(v)) for k, x in series.items() for t, v in enumerate(x)], "k string, pos long, e double").repartition(5)
    table = spark.createDataFrame(list(lags.items()), "k string, lags int")
    got = {(r.k, r.j): r.c for r in lagged.lagged_products(placed, ["k"], "e", table).collect()}
    assert got == pytest.approx({(k, j): float(x[j:] @ x[:-j]) for k, x in series.items() for j in range(1, lags[k] + 1)})
    block = lagged.with_halo(placed, ["k"], F.lit(11), F.lit(11))
    assert block.count() <= 2 * placed.count()
