import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.functions.casting import to_double
from granary.operators import cleaning, consolidate, features, hypothesis as ht, market, market_indices, matching, profiling, quantiles, robust, star, validation
from granary.operators.climate import spi, thermal_anomaly
from granary.operators.features import add_lags, add_rolling
from granary.operators.validation import ERROR_COLUMN, validate


def test_cast_fill_and_dedup(spark):
    raw = spark.createDataFrame([("1", "1.5", "2023-01-01"), ("2", "x", "bad"), ("invalid", None, None)], "a string, b string, c string")
    out = cleaning.cast_datatypes(raw, {"a": "int64", "b": "float64", "c": "datetime64[ns]"}).collect()
    assert [r.a for r in out] == [1, 2, 0] and [r.b for r in out] == [1.5, None, None]
    assert out[0].c == datetime.datetime(2023, 1, 1) and out[1].c is None
    words = spark.createDataFrame([("CATURRA",), (None,), ("   ",), ("NAN",), ("CASTILLO",)], "v string")
    filled = [r.v for r in cleaning.fill_missing(words, ["v"]).collect()]
    assert filled == ["CATURRA", *[cleaning.MISSING_VARIETY] * 3, "CASTILLO"]
    rows = spark.createDataFrame([("05001", 2021, 100), ("05001", 2021, 200), ("11001", 2021, 300)], "m string, y int, v int")
    kept = cleaning.deduplicate(rows, ["m", "y", "absent"], "v").orderBy("m").collect()
    assert [r.v for r in kept] == [200, 300]


def test_cleaners(spark):
    crops = spark.createDataFrame(
        [("05", "05001", "Antioquia", "Medellín", "Café", None, "2022", "1.5", "x", "3", "2")] * 2,
        "c_d_dep string, c_d_mun string, departamento string, municipio string, cultivo string, desagregaci_n_regional_y string, "
        "a_o string, rea_sembrada_ha string, rea_cosechada_ha string, producci_n_t string, rendimiento_t_ha string",
    )
    row = cleaning.clean(crops, "eva").collect()
    assert len(row) == 1
    assert (row[0].municipio, row[0].variedad, row[0].anio, row[0].area_cosechada_ha) == ("MEDELLIN", cleaning.MISSING_VARIETY, 2022, None)
    price = spark.createDataFrame([("11001", "Bogotá,  D.C.", "Urea", "10.5", "2023", "6")], "cod_municipio string, municipio string, articulo string, preciopromedio string, anio string, mes string")
    assert cleaning.clean(price, "sipsa").first().municipio == "BOGOTA, D.C."


def test_contract_split(spark):
    rows = [
        ("05", "05001", "2022", "Papa", 10.0, 9.0, 100.0, 10.0),
        ("05", "", "2022", "Papa", 10.0, 9.0, 100.0, 10.0),
        ("05", "05002", "1990", "", -1.0, 20.0, -5.0, 1.0),
        ("05", "05003", "2020", "Maíz", 10.0, 11.0, 100.0, 0.0),
    ]
    df = spark.createDataFrame(rows, "c_d_dep string, c_d_mun string, a_o string, cultivo string, rea_sembrada_ha double, rea_cosechada_ha double, producci_n_t double, rendimiento_t_ha double")
    parts = validation.validate(df, "eva")
    assert parts["accepted"].count() == 2 and parts["rejected"].count() == 2
    metrics = validation.gate(parts["metrics"]).first()
    assert (metrics.compliance_rate_pct, metrics.verdict) == (50.0, "RED")
    assert set(parts["rejected"].columns) == {*df.columns, validation.ERROR_COLUMN}
    counts = {r.rule: r.violations for r in parts["rules"].collect()}
    assert counts["anio"] == 1 and counts["area_sembrada"] == 1 and counts["produccion"] == 1
    empty = validation.validate(df.limit(0), "eva")["metrics"].first()
    assert (empty.total_records, empty.compliance_rate_pct) == (0, 100.0)


def test_climate_contract_limits(spark):
    rows = [("1", "2024-01-01", "0.0", "Precipitación"), ("1", "2024-01-01", "601", "lluvia"), ("1", "d", "61", "Temperatura"), ("1", "d", "x", "y"), ("", "", "1", "y")]
    df = spark.createDataFrame(rows, "codigoestacion string, fechaobservacion string, valorobservado string, descripcionsensor string")
    assert validation.validate(df, "ideam")["accepted"].count() == 1
    zero = df.limit(1).withColumn("valorobservado", F.lit(0.0))
    assert validation.validate(zero, "ideam")["accepted"].count() == 1  # numeric zero is a value


def test_keys(spark):
    df = spark.createDataFrame([(2022, 1, "a", 1.0), (2022, 1, "a", 2.0), (2022, 2, None, 3.0)], "anio int, mes int, m string, v double")
    r = validation.key_uniqueness(df, ["anio", "mes", "m"]).first()
    assert (r.total_rows, r.unique_keys, r.duplicate_rows, r.is_unique) == (3, 2, 2, False)
    assert validation.duplicate_samples(df, ["anio", "mes", "m"]).count() == 2
    with pytest.raises(KeyError):
        validation.key_uniqueness(df, ["nope"])
    assert validation.key_uniqueness(df.limit(0), ["anio"]).first().is_unique


def test_profiles(spark):
    df = spark.createDataFrame([("A", 100.0), ("B", 200.0), (None, 300.0), ("A", 400.0)], "d string, p double")
    cols = {r.column: r for r in profiling.column_profile(df).collect()}
    assert cols["d"].null_percentage == 25.0 and cols["d"].unique_count == 2
    num = profiling.numeric_profile(df).first()
    assert (num.mean, num.median) == (250.0, 250.0)
    med = spark.createDataFrame([(float(v),) for v in (10, 11, 12, 10.5, 11.2, 10.8, 11.5, 1000.0)], "m double")
    assert profiling.numeric_profile(med).first().outliers_iqr_count == 1
    dates = spark.createDataFrame([("2024-01-01", "x"), ("2024-02-01", "x"), ("2024-05-01", "y"), ("2024-06-01", "y"), ("bad", "y")], "f string, e string")
    assert [str(r.period) for r in profiling.first_missing(dates, "f").collect()] == ["2024-03-01", "2024-04-01"]
    cover = profiling.temporal_coverage(dates, "f").first()
    assert (cover.expected_periods_count, cover.actual_periods_count, cover.has_gaps) == (6, 4, True)
    assert {r.group: r.missing_periods for r in profiling.gaps_by_group(dates, "f", "e").collect()} == {"x": 4, "y": 4}
    late = spark.createDataFrame([("2024-01-15",), ("2024-03-02",)], "f string")
    assert profiling.temporal_coverage(late, "f").first().expected_periods_count == 2  # January is not whole
    cat = profiling.category_summary(spark.createDataFrame([("PAPA",), ("PAPA",), ("PAPA",), ("MAIZ",), ("ARROZ",)], "c string"), ["c", "z"]).first()
    assert (cat.cardinalidad_unica, cat.categoria_dominante, cat.frecuencia_dominante, cat.porcentaje_dominante) == (3, "PAPA", 3, 60.0)


def test_market_indices(spark):
    prices = spark.createDataFrame([(i, 100.0) for i in range(12)] + [(12, 120.0)], "t int, p double")
    got = market_indices.yoy_inflation(prices, "p", None, "t").orderBy("t").collect()
    assert got[12].inflacion_yoy == pytest.approx(20.0) and got[0].inflacion_yoy is None
    a = spark.createDataFrame([(1, 1000.0), (2, 2000.0), (3, 3000.0)], "t int, a double")
    b = spark.createDataFrame([(1, 500.0), (2, 0.0), (3, 1500.0)], "t int, b double")
    tot = market_indices.terms_of_trade(a, b, ["t"], "a", "b", "tot").orderBy("t")
    assert [r.tot for r in tot.collect()] == [2.0, None, 2.0]
    idx = market_indices.price_index(spark.createDataFrame([(1, 50.0), (2, 100.0), (3, 75.0)], "t int, p double"), "p", None, "t").orderBy("t")
    assert [r.indice_base100 for r in idx.collect()] == [100.0, 200.0, 150.0]


def test_features_never_look_ahead(spark):
    rows = [("a", i, v) for i, v in enumerate([10.0, 20.0, 30.0, 100.0])] + [(None, 0, 5.0)]
    df = spark.createDataFrame(rows, "g string, t int, v double")
    out = add_rolling(add_lags(df, "v", [1], "g", "t"), "v", [2], "g", "t").filter("g = 'a'").orderBy("t").collect()
    assert [r.v_lag_1 for r in out] == [None, 10.0, 20.0, 30.0]
    assert out[2].v_roll_mean_2 == 15.0
    bumped = add_rolling(df.withColumn("v", F.when(F.col("t") == 3, 999.0).otherwise(F.col("v"))), "v", [2], "g", "t").filter("g = 'a' and t = 3")
    assert bumped.first().v_roll_mean_2 == 25.0
    assert add_lags(df, "v", [1], "g", "t").filter("g is null").first().v_lag_1 is None


def test_spi_and_anomaly(spark):
    rng = np.random.default_rng(42)
    rain = rng.gamma(2.0, 40.0, 36)
    rain[[5, 15]] = 0.0
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(rain)], "t int, v double")
    got = [r.spi_3 for r in spi(df, "v", None, "t", 3).orderBy("t").collect()]
    assert got[:2] == [None, None] and all(-3.5 <= x <= 3.5 for x in got[2:])
    assert all(r.spi_3 is None for r in spi(df.filter("t < 10"), "v", None, "t", 3).collect())
    temps = spark.createDataFrame([(datetime.date(2020 + y, m, 1), 20.0 + y + m) for y in range(2) for m in range(1, 13)] + [(None, 5.0)], "d date, v double")
    z = thermal_anomaly(temps, "v", "d")
    assert sorted({round(r.anomalia_termica_z, 6) for r in z.filter("d is not null").collect()}) == [-0.707107, 0.707107]
    assert z.filter("d is null").first().anomalia_termica_z is None
    one = thermal_anomaly(temps.filter("d < '2021-01-01'"), "v", "d").collect()
    assert {r.anomalia_termica_z for r in one} == {0.0}


CATALOGUE = [
    ("5001", "Medellín", "5", "Antioquia", 1),
    ("11001", "Bogotá, D.C.", "11", "Bogotá D.C.", 2),
    ("76001", "Cali", "76", "Valle", 3),
    ("5001", "Medellín", "5", "Antioquia", 4),
]


def test_matching(spark):
    golden = matching.golden_catalogue(spark.createDataFrame(CATALOGUE, "cod_municipio string, nombre_municipio string, cod_departamento string, nombre_departamento string, o int"), "o")
    assert golden.count() == 3
    raw = spark.createDataFrame([("Medellín", None), ("Medellin D.C.", None), ("PARIS", None), ("", None), ("Medelin", "Valle")], "n string, h string")
    got = {r.raw_name: r for r in matching.match_names(raw, golden, "n", "h", 0.80).collect()}
    assert (got["Medellín"].match_type, got["Medellín"].cod_municipio) == ("EXACT", "05001")
    assert (got["Medellin D.C."].match_type, got["Medellin D.C."].similarity_score) == ("FUZZY", 0.8)
    assert got["PARIS"].cod_municipio is None and got[""].cod_municipio is None
    assert got["Medelin"].cod_municipio is None  # penalised by the other department


@pytest.mark.parametrize("threshold", [0.2, 0.4, 0.5, 0.6, 0.8, 0.85])
def test_candidates_lose_nothing(spark, threshold):
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("ABCDE"), rng.integers(1, 9)))
    raw = spark.createDataFrame(sorted({(word(),) for _ in range(120)}), "name string")
    golden = spark.createDataFrame(sorted({(word(),) for _ in range(60)}), "nombre string")
    every = raw.crossJoin(golden).filter(matching.match_score(F.col("name"), F.col("nombre")) >= threshold)  # brute force on a fixture
    found = matching.candidate_pairs(raw, golden, threshold)
    assert every.join(found, ["name", "nombre"], "left_anti").isEmpty()


def test_consolidation_suffixes_and_null_keys(spark):
    base = spark.createDataFrame([(1, "a", 1.0), (2, None, 2.0)], "k int, s string, v double")
    other = spark.createDataFrame([("a", 10.0), (None, 20.0)], "s string, v double")
    out = consolidate.consolidate_features(base, [other, spark.range(1)], ["s"]).orderBy("k").collect()
    assert [(r.v_x, r.v_y) for r in out] == [(1.0, 10.0), (2.0, 20.0)]


def test_star_schema(spark):
    assert star.calendar(spark, 2022, 2023).count() == 24
    wide = spark.createDataFrame([("2023-01-15", 100.0, 50.0), ("2023-02-15", 110.0, None), ("nope", 1.0, 1.0)], "fecha string, urea_46 double, dap_18_46 double")
    inputs = star.get_or_create_inputs(star.empty_table(spark, "dim_insumo"), star.input_names(wide))
    facts = star.fact_prices(wide, inputs).collect()
    assert sorted((r.id_tiempo, r.id_insumo, r.precio_promedio) for r in facts) == [(202301, 1, 100.0), (202301, 2, 50.0), (202302, 1, 110.0)]
    crops = spark.createDataFrame([("05001", 2022, "Papa", " ", "Tubérculos", 10.0, None)], "cod_municipio string, anio int, cultivo string, variedad string, grupo_de_cultivo string, area_sembrada_ha double, produccion_ton double")
    dim = star.get_or_create_products(star.empty_table(spark, "dim_producto"), crops, "anio")
    again = star.get_or_create_products(dim, crops, "anio")
    assert [tuple(r) for r in again.collect()] == [(1, "PAPA", "TUBERCULOS", cleaning.MISSING_VARIETY)]
    fact = star.fact_crops(crops, dim).first()
    assert (fact.id_tiempo, fact.id_producto, fact.produccion_ton) == (202212, 1, 0.0)


def test_monthly_climate_joins_facts_before_names(spark):
    assert star.VIEW_SQL.index("clima_mensual") < star.VIEW_SQL.index("dim_municipio")


def test_battery(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(rng.normal(10, 2)), float(i + rng.normal()), "abc"[i % 3]) for i in range(60)]
    df = spark.createDataFrame(rows, "t int, ruido double, tendencia double, g string")
    out = {(r.variable, r.prueba): r for r in ht.full_battery(df, ["ruido", "tendencia", "absent"], ["t"], "g").collect()}
    assert len(out) == 8
    assert out[("tendencia", ht.TREND)].decision == ht.REJECT
    assert out[("ruido", ht.STATIONARITY)].decision == ht.STATIONARY
    short = ht.mann_kendall(df.limit(5), [], "ruido", ["t"]).first()
    assert (short.decision, short.p_value, short.trend_direction) == (ht.INSUFFICIENT, 1.0, ht.INSUFFICIENT)
    flat = ht.dickey_fuller(df.withColumn("ruido", F.lit(1.0)), [], "ruido", ["t"]).first()
    assert flat.adf_statistic is None  # nothing is invented for a constant series
    regional = spark.createDataFrame([(v, g) for g, vs in {"a": [1, 2, 1.5, 1.2], "b": [10, 11, 12, 10.5], "c": [20, 21, 22, 23]}.items() for v in map(float, vs)], "v double, g string")
    kw = ht.group_differences(regional, [], "v", "g").first()
    assert (kw.n_groups, kw.decision) == (3, ht.REJECT) and kw.p_value < 0.05


def test_numbers_that_only_java_or_floats_know(spark):
    texts = ["1.5", " 2e3\t", "1e400", "-1e400", "1.5d\t", "2f \n", "NaN\n", "Infinity", "0x1p3", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(to_double(F.col("t"))).collect()] == [1.5, 2000.0] + [None] * 9


def test_bad_numbers_are_rejected_and_do_not_end_the_job(spark):
    crop = "c_d_mun string, cultivo string, a_o string, rea_sembrada_ha string"
    rows = [("05001", "PAPA", y, a) for y, a in (("2020", "1"), ("1e30", "1"), ("1e400", "1"), ("2020d\t", "1"), ("2020", "NaN\n"))]
    parts = validate(spark.createDataFrame(rows, crop), "eva")
    assert [r.anio for r in parts["accepted"].collect()] == [2020]
    assert sorted(r[0] for r in parts["rejected"].select(ERROR_COLUMN).collect())[0].startswith("anio (1.0E30) fuera de rango válido")
    beasts = spark.createDataFrame([("05001", "BOVINO", n) for n in ("7", "1e30", "-3")], "cod_municipio string, especie string, total_animales string")
    parts = validate(beasts, "ica")
    assert [r.total_animales for r in parts["accepted"].collect()] == [7]
    assert sorted(r[0] for r in parts["rejected"].select(ERROR_COLUMN).collect()) == ["total_animales (-3) no puede ser negativo", "total_animales (1.0E30) fuera de rango"]
    prices = spark.createDataFrame([("A", "1", "2020", p) for p in ("5", "1e400", "Infinity")], "articulo string, mes string, anio string, precio string")
    assert validate(prices, "sipsa")["accepted"].count() == 1


def test_nan_is_missing(spark):
    nan = float("nan")
    rows = [("a", k, v, float(k)) for k, v in enumerate([1.0, nan, 3.0, 4.0, nan, 6.0, 7.5])]
    holes = [(g, k, None if v != v else v, w) for g, k, v, w in rows]
    schema = "g string, k long, v double, w double"
    with_nan, with_null = spark.createDataFrame(rows, schema), spark.createDataFrame(holes, schema)
    for run in (
        lambda d: add_rolling(d, ["v"], [3], group="g", order_by="k"),
        lambda d: features.add_rolling_robust(d, "v", 3, "g", "k"),
        lambda d: features.add_difference(d, "v", "g", "k"),
        lambda d: quantiles.medians(d, ["g"], "v", "m"),
        lambda d: quantiles.median_and_mad(d, ["g"], "v"),
        lambda d: robust.modified_z(d, ["g"], "v"),
        lambda d: robust.winsorise(d, ["g"], "v"),
        lambda d: robust.robust_scale(d, ["g"], "v"),
        lambda d: market.pearson(d, ["g"], "v", "w"),
        lambda d: market.centre_and_spread(d, ["g"], "v"),
        lambda d: market.line_slope(d, ["g"], "w", "v"),
    ):
        assert sorted(map(repr, run(with_nan).collect())) == sorted(map(repr, run(with_null).collect()))


def test_pairs_by_rarest_letter_are_each_met_once(spark):
    names = ["aab", "abc", "zz", "é x", "bbbb", "abcdefgh", "q", "aaaaaaab"]
    golden = spark.createDataFrame([(n,) for n in ["ab", "zza", "x", "abcdefgi", "mm", "bbba", "aaaa"]], "nombre string")
    raw = spark.createDataFrame([(n,) for n in names], "name string")
    score = matching.match_score(F.col("name"), F.col("nombre"))
    every = {(r.name, r.nombre): r.score for r in raw.crossJoin(golden).withColumn("score", score).collect()}
    for threshold in (0.05, 0.3, 0.5):
        for salts in (1, 5):
            found = [(r.name, r.nombre) for r in matching.pairs_by_rarest_letter(raw, golden, threshold, salts).collect()]
            assert len(found) == len(set(found))
            assert {p for p, x in every.items() if x >= threshold} <= set(found)
    few = {(r.name, r.nombre) for r in matching.pairs_by_rarest_letter(raw, golden, 0.5).collect()}
    assert few < {p for p, x in every.items() if x > 0}
    assert matching.pairs_by_rarest_letter(raw.limit(0), golden, 0.3).count() == 0
