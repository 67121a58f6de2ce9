import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import decision_list as d

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    counts = {w: windows.count(w) for w in set(windows)}
    covered = {k + j for k, w in enumerate(windows) if counts[w] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), sum(x in lines[:k] for k, x in enumerate(lines)), len(covered)


def texts():
    rng = random.Random(2)
    out = [None, "", " \n\t", "one", "a b c d e", "a b c d e " * 2, "x " * 40, "é\x0bb\x1cc # * <>|", "l 1\nl 1\n\n\nl 1 \nl 1", "a b c d e f a b c d e g b c d e f"]
    for _ in range(60):
        words = [rng.choice("abc") for _ in range(rng.randrange(60))]
        out.append("".join(w + rng.choice([" ", " ", "  ", "\n", "\t"]) for w in words))
    return out


def test_statistics(spark):
    docs = spark.createDataFrame([(k, t, "n") for k, t in enumerate(texts())], "doc_id long, text string, n_chars string")
    rows = d.judge(docs, []).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for r in rows:
        want = plain(texts()[r.doc_id])
        assert tuple(r[n] for n in names) == want, texts()[r.doc_id]
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and r.kept != r.base_failed
    assert d.judge(docs.limit(0), []).count() == 0


def test_long_repeats(spark):
    text = "one two three four five six " * 20_000
    assert d.judge(spark.createDataFrame([(1, text)], "doc_id long, text string"), []).first().n_repeat_words == 120_000


def test_covering_finds_planted_rules():
    rng = np.random.default_rng(0)
    a, b = rng.random(4000), rng.random(4000)
    bad = (a > 0.9) | (a < 0.3) & (b > 0.8)
    rules = d.learn_rules({"a": a, "b": b}, bad, rng.random(4000) < 0.33)
    hit = np.zeros(4000, bool)
    for rule in rules:
        hit |= np.logical_and.reduce([c.mask({"a": a, "b": b}[c.feature]) for c in rule])
    assert (hit & ~bad).sum() <= 0.03 * hit.sum() and (hit & bad).sum() >= 0.9 * bad.sum()
    assert d.learn_rules({"a": a}, np.zeros(4000, bool), a < 0.5) == []
    assert d.learn_rules({"a": a}, rng.random(4000) < 0.1, b < 0.3) == []


@pytest.mark.parametrize("labels", [[], [(1, 0)], [(None, 0), (2, None)]])
def test_no_labels_to_learn_from(spark, labels):
    docs = spark.createDataFrame([(1, "a " * 3), (2, None)], "doc_id long, text string")
    assert d.learn_from(docs, spark.createDataFrame(labels, "doc_id long, quality int")) == []


def test_given_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rules = d.learn_from(docs, labels)
    assert rules
    rows = d.judge(docs, rules).where("not base_failed").join(labels, "doc_id").collect()
    assert all(r.kept for r in rows if r.quality == 1)
    assert sum(not r.kept for r in rows if r.quality == 0) >= 0.8 * sum(r.quality == 0 for r in rows)


def test_input_columns_may_have_any_name(spark):
    plain = spark.createDataFrame([(1, "a few words " * 9), (2, None)], "doc_id long, text string")
    clash = plain.select("*", *[F.lit(f"<{c}>").alias(c) for c in ("_words", "_lines", "_pairs", "_at", "_upper", "_own", "a.b")], *[F.lit("x").alias(c) for c in ("N_WORDS", "kept", "rule", "stop_share")])
    want = d.judge(plain, [])
    got = d.judge(clash, [])
    assert sorted(got.select(want.columns).collect(), key=lambda r: r.doc_id) == sorted(want.collect(), key=lambda r: r.doc_id)
    first = got.first()
    assert all(first[c] == f"<{c}>" for c in ("_words", "_lines", "_pairs", "_at", "_upper", "_own", "a.b")) and len(set(map(str.lower, got.columns))) == len(got.columns)
