"""Row contracts as named rules, the accepted/rejected split, and key checks."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.casting import first_present, to_double
from granary.functions.labels import sensor_class
from granary.functions.nulls import attach, stage

ERROR_COLUMN = "_validation_error"
# Limits of the contracts and of the gate.
YEARS = (2000, 2030)
HARVEST_TOLERANCE = 1.15
RAIN_LIMIT = 600.0
TEMPERATURE_LIMITS = (-15.0, 60.0)
GATE_PCT = 80.0


@dataclass(frozen=True)
class Rule:
    """``key`` is what violations are counted under."""

    key: str
    broken: Column
    message: Column


@dataclass(frozen=True)
class Contract:
    """``texts`` and ``numbers`` are computed once per row, as columns of their own, before
    the rules read them: rules repeat their arguments, and parsing is the costly part."""

    texts: dict[str, Column]
    numbers: dict[str, Column]
    rules: list[Rule]
    output: dict[str, Column]

    @property
    def staged(self) -> list[str]:
        return [*self.texts, *self.numbers]


class _Builder:
    """Collects staged columns and rules of a contract for one table."""

    def __init__(self, df: DataFrame):
        self.df, self.texts, self.numbers, self.rules = df, {}, {}, []

    def text(self, label: str, *names: str) -> Column:
        """Trimmed first present alias, or the empty string."""
        have = [F.col(n) for n in names if n in self.df.columns]
        staged = f"__t_{label}"
        self.texts[staged] = F.coalesce(first_present(*have), F.lit("")) if have else F.lit("")
        return F.col(staged)

    def required(self, key: str, value: Column, word: str = "vacío") -> None:
        message = f"{key} no puede estar {word}"
        self.rules.append(Rule(message, value == "", F.lit(message)))

    def number(self, label: str, *names: str) -> tuple[Column, Column]:
        """(number with absent as 0, flag for text that is present but no number).

        Numeric columns are taken as they are; only text columns are trimmed and parsed.
        """
        have = dict(self.df.dtypes)
        value = F.lit(0.0)
        for n in reversed([n for n in names if n in have]):
            given = first_present(F.col(n)) if have[n] == "string" else to_double(F.col(n), have[n])
            value = F.when(given.isNotNull(), to_double(given) if have[n] == "string" else given).otherwise(value)
        staged = f"__n_{label}"
        self.numbers[staged] = value
        return F.coalesce(F.col(staged), F.lit(0.0)), F.col(staged).isNull()

    def shown_text(self, *names: str) -> Column:
        """The text a message quotes; evaluated only for rows that break the rule."""
        have = [F.col(n) for n in names if n in self.df.columns]
        return F.coalesce(first_present(*have), F.lit("")) if have else F.lit("")

    def non_negative(self, key: str, names: tuple, ending: str = "a") -> Column:
        number, bad = self.number(key, *names)
        wrong = f"{key} no numéric{ending}"
        self.rules += [
            Rule(wrong, bad, F.lit(wrong)),
            Rule(key, ~bad & (number < 0), _shown(number, key, f"no puede ser negativ{ending}")),
        ]
        return number

    def whole(self, key: str, names: tuple, limits: tuple, wrong: str, text: str) -> Column:
        number, bad = self.number(key, *names)
        value = number.try_cast("bigint")  # NULL beyond 64 bits, which is out of range too
        self.rules += [
            Rule(wrong, bad, F.concat(F.lit(wrong + ": "), self.shown_text(*names))),
            Rule(key, ~bad & ~F.coalesce(value.between(*limits), F.lit(False)), _shown(F.coalesce(value.cast("string"), number.cast("string")), key, text)),
        ]
        return value

    def rule(self, key: str, broken: Column, message: Column) -> None:
        self.rules.append(Rule(key, broken, message))

    def build(self, **output: Column) -> Contract:
        return Contract(self.texts, self.numbers, self.rules, output)


def _shown(value: Column, before: str, after: str) -> Column:
    return F.concat(F.lit(before + " ("), F.coalesce(value.cast("string"), F.lit("")), F.lit(") " + after))


OUT_OF_YEARS = f"fuera de rango válido [{YEARS[0]}, {YEARS[1]}]"


def crop_contract(df: DataFrame) -> Contract:
    c = _Builder(df)
    region, town = c.text("dep", "c_d_dep", "codigo_departamento"), c.text("mun", "c_d_mun", "codigo_municipio")
    c.required("codigo_municipio", town)
    year = c.whole("anio", ("a_o", "anio"), YEARS, "anio inválido", OUT_OF_YEARS)
    crop = c.text("cultivo", "cultivo")
    c.required("cultivo", crop)
    planted = c.non_negative("area_sembrada", ("rea_sembrada_ha", "area_sembrada"))
    harvested = c.non_negative("area_cosechada", ("rea_cosechada_ha", "area_cosechada"))
    c.rule(
        "area_cosechada",
        (harvested >= 0) & (planted > 0) & (harvested > planted * HARVEST_TOLERANCE),
        F.concat(_shown(harvested, "area_cosechada", "excede tolerancia sobre area_sembrada ("), planted.cast("string"), F.lit(")")),
    )
    tonnes = c.non_negative("produccion", ("producci_n_t", "produccion"))
    per_ha = c.non_negative("rendimiento", ("rendimiento_t_ha", "rendimiento"), "o")
    return c.build(
        codigo_departamento=region,
        codigo_municipio=town,
        anio=year,
        cultivo=F.upper(crop),
        area_sembrada=planted,
        area_cosechada=harvested,
        produccion=tonnes,
        rendimiento=per_ha,
    )


def climate_contract(df: DataFrame) -> Contract:
    c = _Builder(df)
    station = c.text("estacion", "codigoestacion", "codigo_estacion", "estacion")
    c.required("codigo_estacion", station)
    date = c.text("fecha", "fechaobservacion", "fecha")
    c.required("fecha", date, "vacía")
    raw = c.text("valor", "valorobservado", "valor")
    c.numbers["__n_valor"] = to_double(raw)
    kind = sensor_class(c.text("sensor", "descripcionsensor", "variable"))
    c.numbers["__kind"] = kind
    value, kind = F.col("__n_valor"), F.col("__kind")
    c.rule(
        "valor meteorológico no numérico", value.isNull(), F.concat(F.lit("valor meteorológico no numérico: "), raw)
    )
    negative = _shown(value, "precipitacion", "no puede ser negativa")
    too_much = _shown(value, "precipitacion", "supera el límite físico diario")
    c.rule(
        "precipitacion",
        (kind == "precipitacion") & ~value.between(0.0, RAIN_LIMIT),
        F.when(value < 0, negative).otherwise(too_much),
    )
    c.rule(
        "temperatura",
        (kind == "temperatura") & ~value.between(*TEMPERATURE_LIMITS),
        _shown(value, "temperatura", "fuera de límites físicos"),
    )
    c.rule(
        "radiacion solar", (kind == "radiacion") & (value < 0), _shown(value, "radiacion solar", "no puede ser negativa")
    )
    return c.build(codigo_estacion=station, fecha=date, valor=value)


def price_contract(df: DataFrame) -> Contract:
    c = _Builder(df)
    article = c.text("articulo", "articulo", "producto")
    c.required("articulo", article)
    month = c.whole("mes", ("mes",), (1, 12), "mes no numérico", "debe estar en rango [1, 12]")
    year = c.whole("anio", ("anio", "a_o"), YEARS, "anio no numérico", OUT_OF_YEARS)
    price, bad = c.number("precio", "preciopromedio", "precio_promedio", "precio")
    c.rule("precio no numérico", bad, F.lit("precio no numérico"))
    c.rule("precio", ~bad & (price <= 0), _shown(price, "precio", "debe ser estrictamente mayor a 0"))
    return c.build(articulo=F.upper(article), anio=year, mes=month, precio=price)


def livestock_contract(df: DataFrame) -> Contract:
    c = _Builder(df)
    town, species = c.text("mun", "cod_municipio", "col_0"), c.text("especie", "especie", "col_1")
    c.required("codigo_municipio", town)
    c.required("especie", species, "vacía")
    number, bad = c.number("total_animales", "total_animales", "col_3")
    heads = number.try_cast("bigint")
    c.rule("total_animales no numérico", bad, F.lit("total_animales no numérico"))
    negative, beyond = _shown(heads, "total_animales", "no puede ser negativo"), _shown(number, "total_animales", "fuera de rango")
    c.rule("total_animales", ~bad & (heads.isNull() | (heads < 0)), F.when(heads < 0, negative).otherwise(beyond))
    return c.build(codigo_municipio=town, especie=F.upper(species), total_animales=heads)


CONTRACTS = {
    "eva": crop_contract,
    "ideam": climate_contract,
    "sipsa": price_contract,
    "ica": livestock_contract,
}


BROKEN = "__broken"


def broken_rules(contract: Contract) -> list[Column]:
    return [F.coalesce(r.broken, F.lit(False)) for r in contract.rules]


def flag(df: DataFrame, contract: Contract) -> DataFrame:
    """Adds the staged columns and whether any rule is broken.

    Which rules, and what to say about them, is worked out only for rows that break one.
    """
    staged = stage(df, contract.texts)
    if contract.numbers:
        staged = stage(staged, contract.numbers)
    return staged.withColumn(BROKEN, reduce(Column.__or__, broken_rules(contract)))


def accepted(flagged: DataFrame, contract: Contract) -> DataFrame:
    return flagged.filter(~F.col(BROKEN)).select(*[c.alias(n) for n, c in contract.output.items()])


def rejected(flagged: DataFrame, contract: Contract) -> DataFrame:
    messages = F.array_compact(F.array(*[F.when(b, r.message) for b, r in zip(broken_rules(contract), contract.rules)]))
    bad = flagged.filter(BROKEN).withColumn(ERROR_COLUMN, F.array_join(messages, "; "))
    return bad.drop(BROKEN, *contract.staged)


def rule_counts(flagged: DataFrame, contract: Contract) -> DataFrame:
    """Violations of each broken rule: one count per rule in a single row, then turned upright."""
    by_key: dict[str, list[Column]] = {}
    for rule, broken in zip(contract.rules, broken_rules(contract)):
        by_key.setdefault(rule.key, []).append(F.count_if(broken))
    wide = flagged.agg(*[reduce(Column.__add__, c).alias(f"c{i}") for i, c in enumerate(by_key.values())])
    rows = F.array(*[F.struct(F.lit(k).alias("rule"), F.col(f"c{i}").alias("violations")) for i, k in enumerate(by_key)])
    return wide.select(F.inline(rows)).filter("violations > 0")


def compliance(flagged: DataFrame) -> DataFrame:
    """One row: totals and the percentage accepted (100 for an empty table)."""
    counts = flagged.agg(F.count(F.lit(1)).alias("total_records"), F.count_if(~F.col(BROKEN)).alias("valid_records"))
    pct = F.when(F.col("total_records") == 0, F.lit(100.0)).otherwise(
        F.round(F.col("valid_records") / F.col("total_records") * 100.0, 2)
    )
    return counts.select(
        "total_records",
        "valid_records",
        (F.col("total_records") - F.col("valid_records")).alias("invalid_records"),
        pct.alias("compliance_rate_pct"),
    )


def validate(df: DataFrame, kind: str) -> dict[str, DataFrame]:
    """Accepted rows, rejected rows, per-rule counts and totals of one contract."""
    contract = CONTRACTS[kind](df)
    flagged = flag(df, contract)
    return {
        "accepted": accepted(flagged, contract),
        "rejected": rejected(flagged, contract),
        "rules": rule_counts(flagged, contract),
        "metrics": compliance(flagged),
    }


def gate(metrics: DataFrame, threshold: float = GATE_PCT) -> DataFrame:
    """Verdict row: GREEN from the threshold upwards."""
    verdict = F.when(F.col("compliance_rate_pct") >= threshold, "GREEN").otherwise("RED")
    return metrics.withColumn("verdict", verdict)


def _require(df: DataFrame, keys: list[str]) -> None:
    absent = [k for k in keys if k not in df.columns]
    if absent:
        raise KeyError(f"key columns not in table: {absent}")


def key_uniqueness(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: total_rows, unique_keys, duplicate_rows (every copy counts), is_unique."""
    _require(df, keys)
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    summary = per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.count(F.lit(1)).alias("unique_keys"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_rows"),
    )
    return summary.withColumn("is_unique", F.col("duplicate_rows") == 0)


def duplicate_samples(df: DataFrame, keys: list[str], limit: int = 10) -> DataFrame:
    """First rows, in full column order, whose key occurs more than once."""
    _require(df, keys)
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").withColumn("__hit", F.lit(True))
    hits = attach(df, repeated.drop("__n"), keys, "inner").drop("__hit")
    return hits.orderBy(*[F.col(c).asc_nulls_last() for c in [*keys, *[c for c in df.columns if c not in keys]]]).limit(limit)


def null_violations(df: DataFrame, columns: list[str]) -> DataFrame:
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], columns, "column", "violations")


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child key values, with row counts, that no parent row has. Rows are never dropped."""
    used = child.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("rows"))
    known = parent.select(F.col(parent_key).alias("key"))
    return used.join(known, "key", "left_anti")


def check_constraints(
    name: str,
    df: DataFrame,
    unique: list[list[str]] = (),
    not_null: list[str] = (),
    foreign: list[tuple[str, DataFrame, str]] = (),
) -> DataFrame:
    """Violation counts of declared constraints, one row each."""
    rows = [
        key_uniqueness(df, keys).select(
            F.lit(f"{name}: unique({', '.join(keys)})").alias("constraint"),
            (F.col("total_rows") - F.col("unique_keys")).alias("violations"),
        )
        for keys in unique
    ]
    if not_null:
        rows.append(
            null_violations(df, list(not_null)).select(
                F.concat(F.lit(f"{name}: not null("), F.col("column"), F.lit(")")).alias("constraint"), "violations"
            )
        )
    for key, parent, parent_key in foreign:
        found = orphans(df, key, parent, parent_key).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("violations"))
        rows.append(found.select(F.lit(f"{name}: foreign({key})").alias("constraint"), "violations"))
    return reduce(DataFrame.unionByName, rows)
