import hashlib
import random

import numpy as np
import pytest

from granary.llm import multiset_hash as m

SCHEMA = "doc_id long, text string, bucket string"


def test_order_insertion_and_deletion():
    parts = ["one two three four", "", "five", "six seven", "five"]
    total = m.vector(parts)
    assert np.array_equal(total, m.vector(parts[::-1]))
    assert np.array_equal(total, m.edit(m.vector(parts[:2]), [], parts[2:]))
    assert np.array_equal(m.edit(total, ["five"], []), m.vector([parts[0], "", "six seven", "five"]))
    assert not np.array_equal(total, m.vector(parts[:-1])) and not np.array_equal(m.vector(["a b"]), m.vector(["b a"]))
    assert not np.array_equal(m.vector(["a b"]), m.vector(["a", "b"]))


def test_lanes_wrap():
    many = m.vector(["same words again"] * 40_000)
    assert np.array_equal(many, m.edit(m.vector(["same words again"] * 39_999), [], ["same words again"]))
    assert (many >= 0).all() and (many <= m.MASKS).all()


def test_likeness_follows_what_is_shared():
    rng = random.Random(1)
    words = [f"w{k}" for k in range(5000)]
    text = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(30)]
    other = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(30)]
    near = [m.likeness(m.vector(text), m.vector(text[:k] + other[k:])) for k in (0, 10, 20, 29, 30)]
    assert near == sorted(near) and near[0] < 0.25 and 0.8 < near[3] < near[4] == 1.0
    assert m.likeness(m.vector([""]), m.vector(["", ""])) == 0.0


@pytest.mark.parametrize("line", ["same words again", "word"])
@pytest.mark.parametrize("repeats", [40_000, 100_000])
def test_likeness_of_long_repetitive_texts(line, repeats):
    whole, other = [line] * repeats, [f"{line} {k}" for k in range(1000)]
    assert m.likeness(m.vector(whole), m.vector(whole[: repeats * 2 // 3])) > 0.99
    assert m.likeness(m.vector(whole), m.vector(whole[: repeats * 2 // 3] + other)) > 0.9


def test_near_edited_of_a_long_repetitive_text(spark):
    docs = [(2, "same words again\n" * 100_000, None), (1, "\n".join(f"{k} other text" for k in range(100_000)), None)]
    got = {r.doc_id: r.near_edited for r in m.compare_with_next(spark.createDataFrame(docs, SCHEMA), 2).collect()}
    assert got[2] > 0.9


def plain(docs):
    rows = sorted(sorted(docs, key=lambda d: d[1] or ""), key=lambda d: -1e9 if d[0] is None else d[0], reverse=True)
    out = []
    for k, (doc_id, text, _) in enumerate(rows):
        text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        a, b, c = (m.vector(m.paragraphs(t)) for t in (text, edited, following))
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), m.as_text(a), m.as_text(b), m.likeness(a, b), m.likeness(a, c)))
    return out


@pytest.mark.parametrize("ranges", [1, 2, 7, 100])
def test_against_plain_version(spark, ranges):
    rng = random.Random(ranges)
    docs = [(k * 3, "\n".join("é" * rng.randrange(3) + " ".join(rng.choice("abcd") for _ in range(rng.randrange(9))) for _ in range(rng.randrange(6))), "x") for k in range(60)]
    docs += [(6, None, None), (6, "again", None), (None, "no id", None), (10**15, "far " * 5000, None), docs[5], docs[5]]
    rng.shuffle(docs)
    got = [tuple(r) for r in m.compare_with_next(spark.createDataFrame(docs, SCHEMA), ranges).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plain(docs)))


def test_few_rows(spark):
    assert m.compare_with_next(spark.createDataFrame([], SCHEMA)).count() == 0
    got = m.compare_with_next(spark.createDataFrame([(1, "abc\ndef", None)], SCHEMA), 5).collect()
    assert [tuple(r) for r in got] == plain([(1, "abc\ndef", None)])
    prints = m.fingerprints(spark.createDataFrame([(1, None, None), (2, "", None)], SCHEMA)).collect()
    assert prints[0].fingerprint == prints[1].fingerprint
