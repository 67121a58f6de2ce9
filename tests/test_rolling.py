import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from granary.operators import features
from granary.operators.rolling import median_distance, sliding_medians, sliding_variation

NUMBERS = st.lists(st.one_of(st.just(float("nan")), st.integers(-4, 4).map(float), st.floats(-1e6, 1e6)), max_size=60)


@settings(deadline=None, max_examples=300)
@given(NUMBERS, st.integers(1, 20), st.integers(0, 20))
def test_sliding_against_whole_windows(values, size, start):
    x = np.array(values, float)
    start = min(start, len(x))
    centres, spreads = sliding_medians(x, size, start)
    varied = sliding_variation(x, size, start)
    for t in range(start, len(x)):
        w = x[max(0, t - size + 1) : t + 1]
        w = w[~np.isnan(w)]
        k = t - start
        if not len(w):
            assert np.isnan([centres[k], spreads[k], varied[k]]).all()
            continue
        assert centres[k] == pytest.approx(np.median(w))
        assert spreads[k] == pytest.approx(np.median(np.abs(w - centres[k])))
        if len(w) < 2:
            assert np.isnan(varied[k])
        elif abs(w.mean()) > 1e-3 * np.abs(w).max():
            assert varied[k] == pytest.approx(w.std(ddof=1) / w.mean(), rel=1e-9, abs=1e-12)


def test_median_distance_with_ties():
    for n in range(1, 9):
        for word in np.ndindex(*(3,) * n) if n < 7 else []:
            ordered = sorted(map(float, word))
            centre = float(np.median(ordered))
            assert median_distance(ordered, centre) == np.median(np.abs(np.array(ordered) - centre))


def test_long_windows_span_blocks(spark):
    rng = np.random.default_rng(4)
    rows = [(g, k, None if rng.random() < 0.1 else float(rng.normal(5)), None if k % 3 else "x") for g in ("a", "b", None) for k in range(400)]
    df = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "g string, k int, v double, more string")
    wanted = features.add_rolling_robust(df, "v", 31, "g", "k", bounded=True)
    before = features.LONG_WINDOW
    spark.conf.set("granary.groupLimit", "50")
    try:
        features.LONG_WINDOW = 31
        got = features.add_rolling_robust(df, "v", 31, "g", "k")
        assert got.columns == wanted.columns
        key = lambda r: (r["g"] or "", r["k"])
        for a, b in zip(sorted(got.collect(), key=key), sorted(wanted.collect(), key=key), strict=True):
            assert tuple(a)[:4] == tuple(b)[:4]
            assert list(a)[4:] == [None if y is None else pytest.approx(y) for y in list(b)[4:]]
        assert features.add_rolling_robust(df.limit(0), "v", 31, "g", "k").count() == 0
    finally:
        features.LONG_WINDOW = before
        spark.conf.unset("granary.groupLimit")
