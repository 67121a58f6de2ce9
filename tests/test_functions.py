import math
import unicodedata

import pytest
from pyspark.sql import functions as F

from granary.functions import casting, labels, stats, text


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


SANITIZED = [
    ("\tlos  Álamos ", "LOS ALAMOS"),
    ("Ñuñoa", "NUNOA"),
    ("PÜERTO DEL SÔL", "PUERTO DEL SOL"),
    (" \u2003 ", ""),
    (None, ""),
    (" a b\x1cc\n", "A B C"),
    ("½ ﬁn straße", "1⁄2 FIN STRASSE"),
    ("각 가", "\u1100\u1161\u11a8 \u1100\u1161"),
    ("𝐀𝓫 🄰 cd", "AB A CD"),
]


def test_sanitize_vectors_and_idempotence(spark):
    once = text.sanitize_text(F.col("a"))
    got = values(spark, [(a,) for a, _ in SANITIZED], "a string", once, text.sanitize_text(once))
    for (_, want), row in zip(SANITIZED, got):
        assert row == (want, want)


def test_folding_agrees_with_unicode_database(spark):
    codes = [c for c in (*range(1, 0xFFFE), *range(0x10000, 0x30000), *range(0xE0000, 0xE0200)) if not 0xD800 <= c < 0xE000]
    got = values(spark, [(f"a{chr(c)}b",) for c in codes], "a string", "a", text.strip_marks(F.col("a")))
    for raw, folded in got:
        assert folded == "".join(ch for ch in unicodedata.normalize("NFKD", raw) if not unicodedata.combining(ch)), ascii(raw)


def test_jaro_winkler_and_levenshtein(spark):
    rows = [("MARTHA", "MARHTA"), ("ABCD", "AXYZ"), ("", ""), ("A", ""), ("A", "B"), ("MEDELLIN", "MEDELIN"), ("BOGOTA", "BOGOTAA")]
    got = values(
        spark, rows, "a string, b string", text.jaro_winkler(F.col("a"), F.col("b")), text.levenshtein_similarity(F.col("a"), F.col("b")),
        text.jaro_winkler(F.col("b"), F.col("a")),
    )
    jw = [g[0] for g in got]
    assert jw[0] == pytest.approx(0.961111, abs=1e-6)
    assert jw[1] == pytest.approx(0.55)  # the prefix bonus also applies to weak matches
    assert jw[2:5] == [1.0, 0.0, 0.0]
    assert jw[5] > 0.9 and got[6][1] >= 0.8 and got[2][1] == 1.0
    assert [g[2] for g in got] == pytest.approx(jw)


def test_zero_fill_never_cuts(spark):
    got = values(spark, [("1",), ("123456",), (None,), (" 5 ",)], "a string", text.zero_fill(F.col("a"), 5))
    assert [g[0] for g in got] == ["00001", "123456", "00000", "00005"]


def test_numbers(spark):
    rows = [("1",), ("2.7",), ("-2.7",), ("invalid",), ("1.5d",), ("nan",), ("Infinity",), ("0x1p3",), (" 1e3 ",), (None,), ("",), (".5",)]
    got = values(spark, rows, "a string", casting.to_double(F.col("a")), casting.to_long_or_zero(F.col("a")))
    assert [g[0] for g in got] == [1.0, 2.7, -2.7, None, None, None, None, None, 1000.0, None, None, 0.5]
    assert [g[1] for g in got] == [1, 2, -2, 0, 0, 0, 0, 0, 1000, 0, 0, 0]


def test_money_text_and_first_present(spark):
    got = values(spark, [("$ 1.250,50",), ("$ -",)], "a string", casting.local_number(F.col("a")))
    assert [g[0] for g in got] == [1250.5, None]
    got = values(spark, [("  ", "x"), ("nan", "y"), ("0", "z"), (None, None)], "a string, b string", casting.first_present(F.col("a"), F.col("b")))
    assert [g[0] for g in got] == ["x", "y", "0", None]


def test_distributions(spark):
    zs = [x / 10 for x in range(-50, 51)]
    got = values(spark, [(z,) for z in zs], "z double", stats.norm_cdf(F.col("z")))
    for z, (p,) in zip(zs, got):
        assert p == pytest.approx(0.5 * (1 + math.erf(z / math.sqrt(2))), abs=2e-7)
    ps = [0.0, 0.025, 0.5, 0.975, 1.0]
    got = [g[0] for g in values(spark, [(p,) for p in ps], "p double", stats.norm_quantile(F.col("p")))]
    assert got[0] == -3.5 and got[4] == 3.5
    assert got[1:4] == pytest.approx([-1.959964, 0.0, 1.959964], abs=5e-4)
    tail = values(spark, [(5.991,), (-1.0,)], "x double", stats.chi2_tail_2df(F.col("x")))
    assert tail[0][0] == pytest.approx(0.05, abs=1e-4) and tail[1][0] == 1.0
    clipped = values(spark, [(None,), (9.0,)], "x double", stats.clip(F.col("x"), -3.5, 3.5))
    assert [c[0] for c in clipped] == [None, 3.5]


def test_risk_classes(spark):
    rows = [(v,) for v in (-2.5, -1.6, -1.2, 0.2, 1.8, None, -2.0, 1.0)]
    got = [g[0] for g in values(spark, rows, "v double", labels.classify_spi(F.col("v")))]
    assert got == [
        "SEQUIA_EXTREMA", "SEQUIA_SEVERA", "SEQUIA_MODERADA", "NORMAL_CLIMATICO",
        "HUMEDAD_SEVERA", "DATOS_INSUFICIENTES", "SEQUIA_EXTREMA", "HUMEDAD_MODERADA",
    ]
    got = [g[0] for g in values(spark, [(25.0,), (12.0,), (-0.1,), (3.0,)], "v double", labels.classify_inflation(F.col("v")))]
    assert got == ["ESTRES_COSTOS_CRITICO", "ESTRES_COSTOS_MODERADO", "DEFLACION_INSUMOS", "ESTRUCTURA_COSTOS_ESTABLE"]
    got = [g[0] for g in values(spark, [(2.0,), (-2.0,), (0.0,)], "v double", labels.classify_thermal(F.col("v")))]
    assert got == ["ALERTA_CALOR_CRITICA", "ALERTA_FRIO_CRITICA", "TEMPERATURA_ESTABLE"]
