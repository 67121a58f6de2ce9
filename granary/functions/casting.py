"""Coercions that never raise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Endings of the number forms only Java knows (1.5d, 2f) and of its non-numbers (NaN, Infinity).
JAVA_ENDINGS = ("d", "f", "n", "y")
# The cast to a number ignores blanks and control characters at the ends.
CAST_TRIMS = "".join(map(chr, range(33)))


def to_double(col: Column, dtype: str = "string") -> Column:
    """Number or NULL. Text must be decimal or scientific; NaN and infinities become NULL."""
    if dtype in ("double", "float"):
        value = col.cast("double")
        return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
    if dtype == "string":
        last = F.lower(F.right(F.rtrim(col, F.lit(CAST_TRIMS)), F.lit(1)))
        odd = last.isin(*JAVA_ENDINGS) | col.contains("x") | col.contains("X")
        value = col.try_cast("double")
        return F.when(~odd & (F.abs(value) < float("inf")), value)
    return col.try_cast("double")


def to_long_or_zero(col: Column, dtype: str = "string") -> Column:
    """Numeric coercion, missing becomes 0, then truncation toward zero."""
    return F.coalesce(to_double(col, dtype).try_cast("bigint"), F.lit(0).cast("bigint"))


def round_to(col: Column, digits: int) -> Column:
    """Half away from zero, judged on the shortest decimal form of the number; never -0.0."""
    return F.round(col.cast("double"), digits) + F.lit(0.0)


def to_instant(col: Column) -> Column:
    return col.try_cast("timestamp")


def to_day(col: Column) -> Column:
    return col.try_cast("date")


def period_id(date: Column) -> Column:
    """yyyymm as an integer key."""
    return (F.year(date) * 100 + F.month(date)).cast("bigint")


def quarter_of(month: Column) -> Column:
    return F.floor((month - 1) / 3).cast("int") + 1


def semester_of(month: Column) -> Column:
    return F.floor((month - 1) / 6).cast("int") + 1


def month_of(date: Column) -> Column:
    return F.trunc(date.cast("date"), "MM")


def first_present(*cols: Column) -> Column:
    """First alias that is neither NULL, NaN text nor blank; a numeric zero is a value."""
    cleaned = [F.nullif(F.trim(c.cast("string")), F.lit("")) for c in cols]
    return F.coalesce(*[F.when(F.lower(c) != "nan", c) for c in cleaned])


def local_number(col: Column) -> Column:
    """Money text with dot thousands and comma decimals, e.g. ``$ 1.250,50``."""
    bare = F.regexp_replace(col, r"[^0-9,.\-]", "")
    return to_double(F.regexp_replace(F.regexp_replace(bare, r"\.", ""), ",", "."))
