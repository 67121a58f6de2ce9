"""Target-distribution importance resampling over hashed n-grams.

1. Words come from an untrained pre-tokeniser: a ``Split`` of the ``tokenizers`` library whose pattern is a run of
   separators returns the words of the ASCII-lower-cased text with their offsets.
2. Windows of one or two neighbouring offset pairs are the features; the CRC-32 of a window's words, joined by one space, picks
   one of ``BUCKETS`` buckets. A pair's CRC goes on from its first word's, so no window is ever built as a string.
   Each text is split once: its buckets are written as two bytes a feature, and both later steps read these.
3. Histograms of the corpus and the target are summed in the tasks; what reaches the driver is one number a bucket.
4. A document's weight is the floored mean of its features' gains; a Gumbel number hashed from its id is added, and the
   highest scores are drawn. Ranks come from a range partitioning by score, never from one sorted task.

Results in special cases: NULL, blank and wordless texts have no feature and weight 0; a NULL id counts as an empty one in the hash;
repeated rows are rows of their own with equal weights and scores and neighbouring ranks; ties go to the smaller id, NULL
ids last; very long texts are split block by block at separators; an empty table gives no rows, an empty target has a histogram of
zeros. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import written
from granary.operators.ordered import row_positions

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SEED = "7"
#: After A-Z have become a-z, these separate words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Characters that are split at a time, about.
BLOCK = 1 << 20


@functools.cache
def _splitter():
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(SEPARATORS), "removed")


def words_with_offsets(lower: str) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Blocks of a lower-case text, each with the offsets of its words; no word spans two blocks."""
    start = 0
    while start < len(lower):
        cut = re.compile(SEPARATORS).search(lower, start + BLOCK) if len(lower) - start > BLOCK else None
        block = lower[start : cut.end() if cut else len(lower)]
        yield block, [at for _, at in _splitter().pre_tokenize_str(block)]
        start += len(block)


def feature_buckets(text: str | None, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """(number of words, bucket of every window of one or two words, repeats included)."""
    crc, n, found, last = zlib.crc32, 0, [], None
    for block, offsets in words_with_offsets((text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")):
        words = [block[a:b].encode("utf-8", "surrogatepass") for a, b in offsets]
        heads = [crc(w) for w in words]
        before = ([last] if last is not None else []) + heads[:-1] if heads else []
        tails = words if last is not None else words[1:]
        found.append(np.array(heads + [crc(b" " + w, h) for h, w in zip(before, tails)], np.int64))
        n, last = n + len(words), heads[-1] if heads else last
    return n, (np.concatenate(found) if found else np.zeros(0, np.int64)) % buckets


def with_features(docs: DataFrame, text: str, keep: list[str], buckets: int = BUCKETS) -> DataFrame:
    """``keep``, n_words and the buckets of the features, packed as little-endian numbers."""
    dtype = "<u2" if buckets <= 1 << 16 else "<u4"

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [feature_buckets(t.as_py(), buckets) for t in batch.column(0)]
            columns = [pa.array([n for n, _ in found], pa.int64()), pa.array([b.astype(dtype).tobytes() for _, b in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(batch.columns[1:] + columns, names=keep + ["n_words", "packed"])

    kept = docs.select(*keep)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema)
    schema = ", ".join(x for x in (fields, "n_words long, packed binary") if x)
    return docs.select(F.col(text).alias("__text"), *keep).mapInArrow(split, schema)


def histogram(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs: summed by task, then by bucket; the driver gets one number a bucket."""
    dtype = "<u2" if buckets <= 1 << 16 else "<u4"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for packed in batch.column(0):
                total += np.bincount(np.frombuffer(packed.as_buffer(), dtype), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    rows = features.select("packed").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for row in rows:
        out[row.bucket] = row.n
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed target share over the smoothed source share) of each bucket."""
    k, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + k) / ((s + 1) * (t_all + k)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def with_weights(features: DataFrame, keep: list[str], gains: np.ndarray) -> DataFrame:
    """``keep``, n_words, n_features and weight, the floored mean gain."""
    dtype = "<u2" if len(gains) <= 1 << 16 else "<u4"

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(p.as_buffer(), dtype) for p in batch.column(0)]
            sizes = [len(b) for b in found]
            weights = [int(gains[b].sum()) // n if n else 0 for b, n in zip(found, sizes)]
            yield pa.RecordBatch.from_arrays(batch.columns[1:] + [pa.array(sizes, pa.int64()), pa.array(weights, pa.int64())], names=keep + ["n_words", "n_features", "weight"])

    kept = features.select("packed", *keep, "n_words")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema[1:])
    return kept.mapInArrow(weigh, f"{fields}, n_features long, weight long")


def gumbel(key: Column, seed: str = SEED) -> Column:
    """floor(-1000 ln(-ln u)) of a number u in (0, 1) hashed from the seed and a key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(-1000 * F.log(-F.log(u)))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every document; of those with enough words, the given
    share with the highest scores has ranks 1, 2, 3..., all others NULL."""
    features = written(with_features(docs, "text", ["doc_id"], buckets), "features")
    gains = gains_of(histogram(features, buckets), histogram(with_features(target, "text", [], buckets), buckets))
    scored = with_weights(features, ["doc_id"], gains).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    scored = written(scored, "scored")
    enough = F.col("n_words") >= least_words
    quota = percent * scored.where(enough).count() // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features")]
    placed = row_positions(scored.where(enough), [], order, "place", bounded=False)
    rank = F.when(F.col("place") < quota, F.col("place") + 1)
    drawn = placed.withColumn("rank", rank).drop("place")
    return drawn.unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("long")))
