"""Quality scorecard, dimension scores, lineage nodes and the column catalogue."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.nulls import attach, numeric_columns, safe_divide
from granary.operators.profiling import melt_numbers, outside_fences
from granary.operators.quantiles import exact_quantiles
from granary.sources.files import content_fingerprint

# Thresholds of the check families, weights and defaults of the scores.
NULL_LIMIT, DUPLICATE_LIMIT, KEY_LIMIT = 0.4, 0.01, 0.0
RANGE_LIMIT, CODE_LIMIT, GEO_LIMIT, TIME_LIMIT, OUTLIER_LIMIT = 0.01, 0.05, 0.1, 0.01, 0.05
EXTREME_FENCE = 3.0
WEIGHTS = {"Completeness": 0.25, "Uniqueness": 0.20, "Validity": 0.20, "Consistency": 0.15, "Timeliness": 0.10, "Accuracy": 0.10}
DEFAULT_SCORES = {"Validity": 0.98, "Accuracy": 0.95, "Consistency": 1.0, "Timeliness": 1.0}
PASSED, WARNING, FAILED = "PASSED", "WARNING", "FAILED"
CODE_PATTERN = r"^\d{5}$"
GEO_BOX = (-4.3, 13.5, -82.0, -66.8)


@dataclass(frozen=True)
class Checks:
    """What to check on a table; absent parts are skipped."""

    key: list[str] = field(default_factory=list)
    ranges: dict[str, tuple[float, float]] = field(default_factory=dict)
    codes: dict[str, str] = field(default_factory=dict)
    geo: tuple[str, str] | None = None
    times: dict[str, tuple[str, str]] = field(default_factory=dict)
    outliers: list[str] | None = None


def _share(bad: Column, of: Column) -> Column:
    """Share of rows with a value that are bad (0 without values)."""
    hits = F.count_if(of.isNotNull() & F.coalesce(bad, F.lit(False)))
    return F.coalesce(safe_divide(hits.cast("double"), F.count(of).cast("double")), F.lit(0.0))


def _duplicate_rate(df: DataFrame, keys: list[str]) -> DataFrame:
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__c"))
    extra = F.sum("__c") - F.count(F.lit(1))
    return per_key.agg(F.coalesce(safe_divide(extra.cast("double"), F.sum("__c").cast("double")), F.lit(0.0)).alias("metric_value"))


def scorecard(df: DataFrame, checks: Checks, bounded: bool | None = None) -> DataFrame:
    """One row per check: name, dimension, column, severity, metric, threshold, status."""
    wide: list[tuple[str, str, str, str, Column, float]] = []
    for c in df.columns:
        rate = F.coalesce(safe_divide(F.count_if(F.col(c).isNull()).cast("double"), F.count(F.lit(1)).cast("double")), F.lit(0.0))
        wide.append((f"null_rate_{c}", "Completeness", c, "MEDIUM", rate, NULL_LIMIT))
    for c, (low, high) in checks.ranges.items():
        wide.append((f"range_check_{c}", "Validity", c, "HIGH", _share(~F.col(c).between(low, high), F.col(c)), RANGE_LIMIT))
    for c, pattern in checks.codes.items():
        wide.append((f"regex_{c}", "Validity", c, "HIGH", _share(~F.col(c).rlike(pattern), F.col(c)), CODE_LIMIT))
    if checks.geo:
        lat, lon = (F.col(c) for c in checks.geo)
        outside = ~(lat.between(GEO_BOX[0], GEO_BOX[1]) & lon.between(GEO_BOX[2], GEO_BOX[3]))
        wide.append(("geobounds_consistency", "Consistency", ",".join(checks.geo), "MEDIUM", _share(outside, lat), GEO_LIMIT))
    for c, (first, last) in checks.times.items():
        wide.append((f"timeliness_bounds_{c}", "Timeliness", c, "MEDIUM", _share(~F.col(c).between(first, last), F.col(c)), TIME_LIMIT))

    columns = ["check_name", "dimension", "column", "severity", "threshold"]
    one_pass = df.agg(*[w[4].alias(f"__{i}") for i, w in enumerate(wide)])
    entries = F.array(
        *[
            F.struct(*[F.lit(v).alias(n) for n, v in zip(columns, (w[0], w[1], w[2], w[3], w[5]))], F.col(f"__{i}").alias("metric_value"))
            for i, w in enumerate(wide)
        ]
    )
    rows = [one_pass.select(F.inline(entries))]

    def add(frame: DataFrame, name: str, dimension: str, column: str, severity: str, limit: float) -> None:
        fixed = [F.lit(v).alias(n) for n, v in zip(columns, (name, dimension, column, severity, limit))]
        rows.append(frame.select(*fixed, "metric_value"))

    add(_duplicate_rate(df, df.columns), "row_deduplication_check", "Uniqueness", "Global", "MEDIUM", DUPLICATE_LIMIT)
    if checks.key:
        add(_duplicate_rate(df, checks.key), "primary_key_uniqueness", "Uniqueness", "+".join(checks.key), "CRITICAL", KEY_LIMIT)
    watched = numeric_columns(df) if checks.outliers is None else checks.outliers
    if watched:
        long = melt_numbers(df, watched)
        quartiles = exact_quantiles(long, ["column"], "value", {"p25": 0.25, "p75": 0.75}, bounded)
        counts = outside_fences(long, quartiles, ["column"], "value", EXTREME_FENCE)
        sizes = long.groupBy("column").agg(F.count(F.lit(1)).alias("__n"))
        rates = attach(counts, sizes, ["column"], "inner")
        rows.append(
            rates.select(
                F.concat(F.lit("extreme_outliers_iqr_"), "column").alias("check_name"),
                F.lit("Accuracy").alias("dimension"),
                "column",
                F.lit("LOW").alias("severity"),
                F.lit(OUTLIER_LIMIT).alias("threshold"),
                (F.col("outliers_iqr_count") / F.col("__n")).alias("metric_value"),
            )
        )
    m, limit = F.col("metric_value"), F.col("threshold")
    hard = (F.col("dimension") == "Uniqueness") | (F.col("dimension") == "Completeness")
    ranged = F.col("check_name").startswith("range_check_")
    status = (
        F.when(ranged & (m > limit), FAILED)
        .when(ranged & (m > 0), WARNING)
        .when(m <= limit, PASSED)
        .when(hard, FAILED)
        .otherwise(WARNING)
    )
    return reduce(DataFrame.unionByName, rows).withColumn("status", status)


def dimension_scores(card: DataFrame) -> DataFrame:
    """One row: six dimension scores, the weighted total and the overall status.

    Completeness weighs null cells, uniqueness looks at the key only (rows if no key).
    """
    mean = lambda d: F.avg(F.when(F.col("dimension") == d, F.col("metric_value")))
    key_rate = F.max(F.when(F.col("check_name") == "primary_key_uniqueness", F.col("metric_value")))
    row_rate = F.max(F.when(F.col("check_name") == "row_deduplication_check", F.col("metric_value")))
    scores = {
        "Completeness": 1.0 - F.coalesce(mean("Completeness"), F.lit(0.0)),
        "Uniqueness": 1.0 - F.coalesce(key_rate, row_rate, F.lit(0.0)),
        **{d: F.coalesce(1.0 - mean(d), F.lit(default)) for d, default in DEFAULT_SCORES.items()},
    }
    out = card.agg(
        *[c.alias(d) for d, c in scores.items()],
        F.count_if(F.col("status") == FAILED).alias("__failed"),
        F.count_if(F.col("status") == WARNING).alias("__warned"),
    )
    total = sum(w * F.col(d) for d, w in WEIGHTS.items())
    status = F.when(F.col("__failed") > 0, FAILED).when(F.col("__warned") > 0, WARNING).otherwise(PASSED)
    return out.select(*WEIGHTS, total.alias("overall_score"), status.alias("status"))


def timed(write: Callable[[], DataFrame]) -> tuple[DataFrame, float]:
    """What ``write`` stores and returns, and the seconds that took: the duration of a node."""
    start = time.perf_counter()
    return write(), time.perf_counter() - start


def lineage_node(node: str, layer: str, upstream: dict[str, DataFrame], result: DataFrame, seconds: float | None = None) -> DataFrame:
    """One row: rows in, rows out, content fingerprint, duration and the upstream node names."""
    rows_in = [df.agg(F.count(F.lit(1)).alias("n")) for df in upstream.values()]
    total_in = reduce(DataFrame.unionByName, rows_in).agg(F.sum("n").alias("rows_in"))
    return total_in.join(content_fingerprint(result), on=F.lit(True), how="left").select(
        F.lit(node).alias("node"),
        F.lit(layer).alias("layer"),
        F.array(*[F.lit(u) for u in upstream]).alias("upstream"),
        "rows_in",
        F.col("rows").alias("rows_out"),
        F.concat_ws(":", F.col("rows").cast("string"), F.hex("hash_xor"), F.col("hash_sum").cast("string")).alias("fingerprint"),
        F.lit(seconds).cast("double").alias("duration_s"),
    )


# Name fragments that mark a column as personal or internal.
PERSONAL_WORDS = ("email", "phone", "telefono", "contact", "correo")
INTERNAL_WORDS = ("id", "key", "ticket")
LOGICAL_TYPES = {"string": "Text", "date": "DateTime", "timestamp": "DateTime", "timestamp_ntz": "DateTime", "boolean": "Boolean"}


PERSONAL, MASK = "CONFIDENTIAL_PII", "***"


def sensitivity(name: str) -> str:
    words = name.lower()
    if any(w in words for w in PERSONAL_WORDS):
        return PERSONAL
    return "INTERNAL" if any(words.endswith(w) for w in INTERNAL_WORDS) else "PUBLIC"


def column_catalogue(df: DataFrame) -> DataFrame:
    """Physical and logical type, observed nullability, sensitivity and the smallest value as example.

    Columns with personal data show a mask instead.
    """
    facts = df.agg(
        *[F.count_if(F.col(c).isNull()).alias(f"__n{i}") for i, c in enumerate(df.columns)],
        *[(F.max(F.when(F.col(c).isNotNull(), MASK)) if sensitivity(c) == PERSONAL else F.min(c).cast("string")).alias(f"__e{i}") for i, c in enumerate(df.columns)],
    )
    entries = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(t).alias("physical_type"),
            F.lit(LOGICAL_TYPES.get(t, "Numeric")).alias("logical_type"),
            (F.col(f"__n{i}") > 0).alias("nullable"),
            F.lit(sensitivity(c)).alias("sensitivity"),
            F.col(f"__e{i}").alias("example"),
        )
        for i, (c, t) in enumerate(df.dtypes)
    ]
    return facts.select(F.inline(F.array(*entries)))
