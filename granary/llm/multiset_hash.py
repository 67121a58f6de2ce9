"""Fingerprints of documents as sums of vectors, one per paragraph.

A paragraph is hashed to a wide vector; a document's fingerprint is the sum of its paragraphs' vectors, lane by lane
modulo a power of two. Sums do not depend on order, so equal multisets of paragraphs have equal fingerprints, and a
paragraph can be put in or taken out by adding or subtracting its vector: nothing else has to be read again.

All lanes are modulo 2**32. The first ``STRONG`` ones come from a cryptographic hash of the paragraph and tell multisets apart. The
other ``LANES`` count the paragraph's word triples, each in a lane and with a sign of its own; the angle
between two such vectors estimates how much the texts share.

Results in special cases: NULL counts as an empty text, which is one empty paragraph; equal texts, also in repeated
rows, have equal fingerprints and a likeness of 1; texts without any word are alike (1) if equal and otherwise 0; very
long texts take memory for a few numbers per word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRONG, LANES = 8, 256
WIDTH = STRONG + LANES
SHINGLE = 3
MASKS = np.full(WIDTH, 0xFFFFFFFF, np.int64)


def paragraphs(text: str | None) -> list[str]:
    return (text or "").split("\n")


def vector(parts: list[str]) -> np.ndarray:
    """The sum of the vectors of some paragraphs."""
    import xxhash

    out = np.zeros(WIDTH, np.int64)
    if not parts:
        return out
    encoded = [p.encode("utf-8", "surrogatepass") for p in parts]
    digests = np.frombuffer(b"".join(hashlib.blake2b(p, digest_size=4 * STRONG).digest() for p in encoded), "<u4").reshape(-1, STRONG)
    out[:STRONG] = digests.sum(axis=0, dtype=np.uint64).astype(np.int64)
    words = [p.split() for p in encoded]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    if sizes.any():
        digest = xxhash.xxh3_64_intdigest
        hashes = np.array([digest(w) for own in words for w in own], np.uint64)
        # each paragraph ends in blanks, so that a short one has triples too and none goes on in the next paragraph
        at = np.arange(len(hashes)) + np.repeat(np.arange(len(words)), sizes) * (SHINGLE - 1)
        line = np.zeros(len(hashes) + len(words) * (SHINGLE - 1), np.uint64)
        line[at] = hashes
        g = line[at] * np.uint64(0x9E3779B97F4A7C15) + (line[at + 1] ^ (line[at + 1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + line[at + 2] * np.uint64(0x94D049BB133111EB)
        g = (g ^ (g >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        g ^= g >> np.uint64(32)
        lanes = (g % np.uint64(LANES)).astype(np.int64)
        sign = 1 - 2 * ((g >> np.uint64(40)) & np.uint64(1)).astype(np.int64)
        out[STRONG:] = np.bincount(lanes[sign > 0], minlength=LANES) - np.bincount(lanes[sign < 0], minlength=LANES)
    return out & MASKS


def edit(total: np.ndarray, removed: list[str], added: list[str]) -> np.ndarray:
    """The fingerprint after some paragraphs are taken out and others put in."""
    return (total - vector(removed) + vector(added)) & MASKS


def as_text(total: np.ndarray) -> str:
    return total.astype("<u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 for equal fingerprints, about 0 for unrelated ones."""
    if np.array_equal(a, b):
        return 1.0
    x, y = (v[STRONG:].astype("<u4").view("<i4").astype(np.float64) for v in (a, b))
    size = float(np.sqrt((x @ x) * (y @ y)))
    return min(1.0, max(0.0, float(x @ y) / size)) if size else 0.0


def fingerprints(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``keep`` and the fingerprint of each text."""

    @F.pandas_udf(T.StringType())
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: as_text(vector(paragraphs(t))))

    return docs.select(*(["doc_id"] if keep is None else keep), of(F.col("text")).alias("fingerprint"))


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(doc_id: object, text: str, total: np.ndarray, following: str, next_total: np.ndarray) -> tuple:
    third = len(text) // 3
    edited = text[: len(text) - third] + following[:third]
    old, new = paragraphs(text), paragraphs(edited)
    same = 0
    while same < min(len(old), len(new)) and old[same] == new[same]:
        same += 1
    after = edit(total, old[same:], new[same:])
    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(text), digest, as_text(total), as_text(after), likeness(total, after), likeness(total, next_total)


def _in_sequence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of range and then of id downwards; each own row is compared with the row behind it."""
    waiting, out = None, []
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [c.split(" ")[0] for c in EDITED.split(", ")]
    flush = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
    for batch in batches:
        for k in range(batch.num_rows):
            bucket, guest, doc_id = (batch.column(c)[k].as_py() for c in ("bucket", "guest", "doc_id"))
            if guest and (waiting is None or waiting[0] != bucket):
                continue  # ties of the first guest
            text = batch.column("text")[k].as_py() or ""
            total = vector(paragraphs(text))
            if waiting is not None:
                out.append(_compared(*waiting[1:], text, total))
            waiting = None if guest else (bucket, doc_id, text, total)
            if len(out) >= 512:
                yield flush(out)
                out = []
    if out:
        yield flush(out)


def compare_with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Each document's fingerprint against that of an edited text and of the next document in descending doc_id.

    Ids are cut into ranges, and the texts are moved once, to their range; the first document of each range also goes
    to the range before it (that of the very first to the last), so that every document meets its successor in one
    task, which reads its rows in order and holds two of them. Ids that repeat are ordered by text, NULL comes last.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    cuts = rows.select(F.percentile_approx("doc_id", [k / n for k in range(1, n)] or [0.5], 100 * n)).first()[0] or []
    bounds = np.unique(np.array(cuts, np.int64))

    @F.pandas_udf(T.IntegerType())
    def bucket_of(ids: pd.Series) -> pd.Series:
        found = len(bounds) - np.searchsorted(bounds, ids.fillna(0).to_numpy(np.int64), side="right")
        return pd.Series(np.where(ids.isna(), len(bounds) + 1, found).astype(np.int32))

    heads = rows.select("doc_id", bucket_of("doc_id").alias("bucket")).groupBy("bucket").agg(F.max("doc_id").alias("head")).orderBy("bucket").collect()
    if not heads:
        return spark.createDataFrame([], EDITED)
    before = [(r["head"], heads[k - 1]["bucket"]) for k, r in enumerate(heads)]  # no more than there are ranges
    sent = F.broadcast(spark.createDataFrame(before, "head long, bucket int"))
    guests = rows.join(sent, rows["doc_id"].eqNullSafe(sent["head"])).select("doc_id", "text", "bucket", F.lit(1).alias("guest"))
    both = rows.select("doc_id", "text", bucket_of("doc_id").alias("bucket"), F.lit(0).alias("guest")).unionByName(guests)
    dealt = both.repartitionByRange(n, "bucket").sortWithinPartitions("bucket", "guest", F.desc_nulls_last("doc_id"), "text")
    return dealt.select("bucket", "guest", "doc_id", "text").mapInArrow(_in_sequence, EDITED)
