"""Reshaping and hygiene of raw sheets: months and markets in columns, names, control characters."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.casting import to_double

# Month column names of published sheets, in calendar order.
MONTH_NAMES = (
    "enero", "febrero", "marzo", "abril", "mayo", "junio",
    "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre",
)
CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{feff}]"


def strip_controls(col: Column) -> Column:
    """Without control characters (tab and line breaks stay) and byte-order marks."""
    return F.regexp_replace(col, CONTROLS, "")


def snake_case(name: str) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c))
    return re.sub(r"[^0-9a-z]+", "_", plain.strip().lower()).strip("_")


def snake_case_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[snake_case(c) for c in df.columns])


def unwrap_months(df: DataFrame, year: str) -> DataFrame:
    """Year rows with month columns to (anio, mes, valor); empty cells are dropped."""
    have = dict(df.dtypes)
    months = [m for m in MONTH_NAMES if m in have]
    numbers = df.select(F.col(year).alias("anio"), *[to_double(F.col(m), have[m]).alias(m) for m in months])
    long = numbers.unpivot("anio", months, "nombre", "valor").filter(F.col("valor").isNotNull())
    position = F.array_position(F.array(*[F.lit(m) for m in MONTH_NAMES]), F.col("nombre")).cast("int")
    return long.select("anio", position.alias("mes"), "valor")


def unwrap_markets(df: DataFrame, product: str) -> DataFrame:
    """``{market}_precio`` and ``{market}_var`` columns to one row per product and market."""
    have = dict(df.dtypes)
    markets = [c.removesuffix("_precio") for c in df.columns if c.endswith("_precio")]
    cells = [
        F.struct(
            F.lit(m).alias("plaza"),
            to_double(F.col(f"{m}_precio"), have[f"{m}_precio"]).alias("precio"),
            (to_double(F.col(f"{m}_var"), have[f"{m}_var"]) if f"{m}_var" in have else F.lit(None).cast("double")).alias("variacion"),
        )
        for m in markets
    ]
    rows = df.select(F.col(product), F.inline(F.array(*cells)))
    return rows.filter(F.col("precio").isNotNull() | F.col("variacion").isNotNull())


# Patterns of personal data in free text.
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
PHONE = r"\+?\d[\d\s().\-]{6,}\d"


def pseudonym(col: Column, salt: str = "") -> Column:
    """Salted SHA-256 of a trimmed, lower-case identifier; NULL stays NULL."""
    return F.when(col.isNotNull(), F.sha2(F.concat(F.lit(salt), F.lower(F.trim(col.cast("string")))), 256))


def pseudonymise(df: DataFrame, columns: list[str], salt: str = "") -> DataFrame:
    return df.withColumns({c: pseudonym(F.col(c), salt) for c in columns if c in df.columns})


def mask_personal(col: Column) -> Column:
    """Mail addresses, then phone numbers, replaced by a placeholder."""
    steps = ((EMAIL, "[EMAIL]"), (PHONE, "[PHONE]"))
    return reduce(lambda c, s: F.regexp_replace(c, *s), steps, col)


def text_chunks(df: DataFrame, source: str, text: str, size: int = 1000) -> DataFrame:
    """Paragraph chunks of whole texts: (source, page_number, chunk_id, chunk_text, char_length).

    A page is a paragraph; longer paragraphs are cut every ``size`` characters, and nothing
    is left out but empty pieces.
    """
    pages = df.select(F.col(source).alias("source"), F.posexplode(F.split(text, "\n")).alias("page", "body"))
    starts = F.sequence(F.lit(0), F.greatest(F.floor((F.length("body") - 1) / size), F.lit(0)).cast("int"))
    pieces = pages.select("source", "page", "body", F.explode(starts).alias("part"))
    body = F.substring("body", F.col("part") * size + 1, F.lit(size))
    return pieces.select(
        "source",
        (F.col("page") + 1).alias("page_number"),
        (F.col("part") + 1).alias("chunk_id"),
        body.alias("chunk_text"),
        F.length(body).alias("char_length"),
    ).filter("char_length > 0")
