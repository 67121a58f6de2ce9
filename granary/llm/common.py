"""Small helpers that several operators of this package share."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.session import table, written

#: Separators of words, as a Java pattern: space and the five ASCII white-space controls.
BREAK = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

__all__ = ["BREAK", "DOCUMENT_COLUMNS", "ascii_lower", "bounded_share", "named_back", "set_apart", "table", "words_of", "written"]


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """The words of a text; NULL has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BREAK), lambda w: w != "")


def bounded_share(df: DataFrame, bound: int, key: Column, rows: int | None = None) -> DataFrame:
    """About ``bound`` rows of ``df``, chosen by a hash of ``key``; all of them if there are no more than that.

    The choice depends on the keys alone, so it is the same whenever a lost task is run again.
    """
    rows = df.count() if rows is None else rows
    if rows <= bound:
        return df
    span = 1 << 30
    return df.where(F.pmod(F.xxhash64(key, F.lit("share")), F.lit(span)) < int(span * bound / rows))


def set_apart(docs: DataFrame, results: Iterable[str]) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` without columns named like a result, and with those that start with ``_`` under names no operator uses.

    The second value is for ``named_back``. Names are compared as Spark does, without regard to case. Only names change,
    so the plan stays what it was.
    """
    taken = {name.lower() for name in results}
    kept = [c for c in docs.columns if c.lower() not in taken]
    names = {f"input column {k}": c for k, c in enumerate(kept) if c.startswith("_")}
    new = {c: n for n, c in names.items()}
    return docs.select(*[F.col(f"`{c}`").alias(new.get(c, c)) for c in kept]), names


def named_back(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    return rows.withColumnsRenamed(names) if names else rows
