import math
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from granary.llm import language_id as g

DATA = "/root/testdata/sf0.01/documents.parquet"


def test_counts_are_those_of_a_plain_loop():
    line = " ".join(w for w in "".join(c if c.isalpha() else " " for c in "Été, the 2nd. ÉTÉ!".lower()).split())
    grams = [f" {line} "[k : k + n] for n in g.GRAMS for k in range(len(line) + 3 - n)]
    counts = g.gram_counts("Été, the 2nd. ÉTÉ!")
    assert counts.sum() == len(grams) and (counts > 0).sum() == len(set(grams))
    assert np.array_equal(counts, g.gram_counts("  ÉTÉ the nd été"))
    assert g.gram_counts("ab " * 10_000).sum() == sum(30_001 - n + 1 for n in g.GRAMS)
    assert all(g.gram_counts(t) is None for t in (None, "", " 12 !!", "\n"))
    assert g.gram_counts("é" * (g.BLOCK + 5)) is not None


def test_l1_makes_weights_sparse_and_temperature_calibrates():
    rng = np.random.default_rng(1)
    rows = [(np.array([k % 2, 5 + int(rng.integers(50))]), np.array([1.0, 0.1]), k % 2) for k in range(400)]
    few, many = (g.train_ftrl(rows, 2, l1=x) for x in (1.0, 0.0))
    assert (few != 0).sum() < (many != 0).sum() and few[0, 0] > few[0, 1]
    scores = rng.normal(size=(2000, 3))
    y = np.array([rng.choice(3, p=p) for p in g.softmax(scores / 2.5)])
    assert math.isclose(g.fit_temperature(scores, y), 2.5, rel_tol=0.15)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DATA).withColumn("held_out", g.is_held_out(g.F.col("doc_id")))
    got = g.predict(docs, g.learn(docs.where("not held_out").select("doc_id", "text", "lang")), ["doc_id", "lang", "held_out"]).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.lang]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert len(got) == pq.read_metadata(DATA).num_rows


@pytest.mark.parametrize("rows", [[], [(1, "some text", None, 0.5)], [(1, "some text", "xx", 0.5), (2, None, "xx", None), (None, "7", None, None)]])
def test_few_or_no_labels(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = g.predict(docs, g.learn(docs), ["doc_id"]).collect()
    want = {1: ("xx", 1.0)} if len(rows) > 1 else {1: (g.UNKNOWN, 0.0)}
    assert [(r.lang_pred, r.score) for r in got] == [want.get(d[0], (g.UNKNOWN, 0.0)) for d in rows]
