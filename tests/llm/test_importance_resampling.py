import collections
import hashlib
import math
import re
import zlib

import pytest

from granary.llm import importance_resampling as m


def plain_features(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def plain_resample(docs, target, percent, least, buckets):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = collections.Counter(bucket(f) for _, t in docs for f in plain_features(t)[1])
    t_ = collections.Counter(bucket(f) for t in target for f in plain_features(t)[1])
    big = lambda c: sum(c.values()) + buckets
    rows = []
    for i, text in docs:
        words, features = plain_features(text)
        gains = [math.floor(1000 * math.log((t_[bucket(f)] + 1) * big(s) / ((s[bucket(f)] + 1) * big(t_)))) for f in features]
        weight = math.floor(sum(gains) / len(gains)) if gains else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(words), len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    enough = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    drawn = {id(r): k + 1 for k, r in enumerate(enough[: percent * len(enough) // 100])}
    return sorted((tuple(r) + (drawn.get(id(r)),) for r in rows), key=repr)


DOCS = [
    (1, None), (2, ""), (3, " ,.-\x00\t"), (4, "One WORD"), (5, "Éa É1 straße Straße 東京 x y"),
    *[(k, f"Spark reads {k} tables and writes {k % 7} of them, " * (k % 5 + 1)) for k in range(10, 60)],
    (61, "same text again " * 12), (62, "same text again " * 12), (62, "same text again " * 12), (None, "nobody knows whose text this is " * 5),
]


@pytest.mark.parametrize("target", [["Spark writes tables", "same text", None], []])
def test_against_a_plain_version(spark, target):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(5)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = m.resample(docs, bench, percent=30, least_words=10, buckets=97)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    got = sorted((tuple(r) for r in got.collect()), key=repr)
    assert got == plain_resample(DOCS, target, 30, 10, 97)
    assert sorted(r[-1] for r in got if r[-1]) == list(range(1, sum(r[-1] is not None for r in got) + 1))


def test_long_texts_are_split_in_blocks(monkeypatch):
    text = "Ab cd,, ef-GH " * 50 + "x" * 300 + " y z" * 40
    whole = m.feature_buckets(text)
    monkeypatch.setattr(m, "BLOCK", 7)
    n, buckets = m.feature_buckets(text)
    words, features = plain_features(text)
    assert n == whole[0] == len(words)
    assert sorted(buckets.tolist()) == sorted(whole[1].tolist()) == sorted(zlib.crc32(f.encode()) % m.BUCKETS for f in features)


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, packed int, place int, n_words string")
    assert m.resample(docs, docs).collect() == []
    docs = spark.createDataFrame([(1, "a b " * 20, 5, 6, "x", 7, 8)], "doc_id long, text string, packed int, place int, n_words string, bucket int, score int")
    row = m.resample(docs, docs, percent=100).first()
    assert (row.n_words, row.n_features, row["rank"]) == (40, 79, 1)
