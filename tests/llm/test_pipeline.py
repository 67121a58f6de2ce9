"""Every stage of the pipeline against a plain version, on the smallest tables; the queries return what they promise."""

import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline as c
from granary.llm import decision_list, soft_mixing
from granary.llm.common import table, written
from tests.llm.test_best_two_fit import plain_pieces
from tests.llm.test_decision_list import plain as plain_statistics
from tests.llm.test_line_dedup import within_document
from tests.llm.test_simhash_trees import plain_components, plain_fingerprint

SF_DIR = "/root/testdata/sf0.001"
CLASH = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()), key=repr)


def test_stages_against_plain_versions(spark):
    docs, labels = table(spark, SF_DIR, "documents"), table(spark, SF_DIR, "labels")
    before = rows_of(docs)
    rules = decision_list.learn_from(docs, labels)
    ratios = {r.doc_id: r for r in decision_list.with_statistics(docs).collect()}
    operators = {True: lambda x, y: x > y, False: lambda x, y: x <= y}
    kept = []
    for row in before:
        n, _, _, _, repeated = plain_statistics(row[1])
        rejected = any(all(operators[k.above](ratios[row[0]][k.feature], k.cut) for k in rule) for rule in rules)
        if n >= 10 and 100 * repeated <= 20 * n and not rejected:
            kept.append(row)
    docs = written(c.quality_rules(spark, docs, SF_DIR), "t")
    assert rows_of(docs) == kept and 0 < len(kept) < len(before)

    texts = within_document([(r[0], r[1]) for r in kept])
    left = sorted(((d, texts[d], lang, source, len(texts[d])) for d, _, lang, source, _ in kept if texts[d].split()), key=repr)
    docs = written(c.line_copies(spark, docs, SF_DIR), "t")
    assert rows_of(docs) == left

    prints = {r[0]: plain_fingerprint(r[1]) for r in left}
    group = plain_components(sorted(set(prints.values())), 4)
    first = {}
    for d in sorted(prints):
        first.setdefault(group[prints[d]], d)
    single = [r for r in left if first[group[prints[r[0]]]] == r[0]]
    docs = written(c.near_copies(spark, docs, SF_DIR), "t")
    assert rows_of(docs) == single

    model = soft_mixing.learn(docs, labels)
    p, n = np.array([model.posterior(r[1]) for r in single]), np.array([len(r[1].split()) for r in single])
    tokens = n @ p
    share = np.array([c.WEIGHTS[d] for d in soft_mixing.DOMAINS])
    targets, scale, rates = share * tokens[0] / share[0], np.sqrt(np.maximum(tokens, 1e-6 * tokens.sum())), np.ones(len(single))
    width = 1 / np.linalg.eigvalsh((p * n[:, None]).T @ p / np.outer(scale, scale))[-1]
    error = lambda r: ((((n * r) @ p - targets) / scale) ** 2).sum()
    for _ in range(50_000):  # plain projected gradient
        rates = np.maximum(0.0, rates - p @ (((n * rates) @ p - targets) / scale**2) * width)
    fit = soft_mixing.settle(soft_mixing.with_posteriors(docs, model), c.WEIGHTS)
    settled = np.maximum(0.0, 1.0 + p @ np.array(fit.steps[0]))
    assert np.allclose(fit.reached, (n * settled) @ p) and error(settled) <= 1.01 * error(rates) + 1e-6 * error(np.ones(len(single)))
    mixed = c.mixing(spark, docs, SF_DIR)
    counts = {r[0]: 0 for r in single}
    for r in mixed.collect():
        counts[r.doc_id] += 1
    for r, rate in zip(single, settled):
        assert np.floor(rate - 1e-6) <= counts[r[0]] <= np.floor(rate + 1 + 1e-6)
    docs = written(mixed, "t")

    got = c.packing(spark, docs, SF_DIR).collect()
    want = plain_pieces([(r[0], r[1]) for r in rows_of(docs)])
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)


def test_run_is_the_stages_in_a_row(spark):
    got = c.run(spark, SF_DIR)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert got.count() > 0


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None), (1, "", "en", "s", 0), (1, None, None, "s", 3), (2, "x " * 30, "en", "s", 60), (2, "x " * 30, "en", "s", 60)]])
def test_stages_bear_odd_rows(spark, rows):
    docs = spark.createDataFrame(rows, CLASH)
    for _, stage in c.STAGES:
        stage(spark, docs, SF_DIR).collect()


def test_dealt_queries_are_registered():
    names = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


def test_queries_cover_whole_tables(spark):
    docs = table(spark, SF_DIR, "documents").select("doc_id", "text").collect()
    for name in ("op2_multiset_hash", "op3_simhash_trees", "op5_soft_mixing", "op6_language_id", "op7_secret_frequency", "op8_line_dedup", "op10_quality_rules", "op11_importance_resampling", "op13_ngram_product"):
        got = [r.doc_id for r in entry.queries()[name](spark, SF_DIR).select("doc_id").collect()]
        assert sorted(got) == sorted(r.doc_id for r in docs), name
    pieces = entry.queries()["op4_best_two_fit"](spark, SF_DIR).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces) == sorted(plain_pieces([tuple(r) for r in docs]))
    assert zlib.crc32(b"") == 0
