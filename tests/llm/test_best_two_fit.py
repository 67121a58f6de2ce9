import zlib

import numpy as np
import pyarrow as pa
import pytest

from granary.llm import best_two_fit as b

PATH = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
ODD = [
    None, "", "   ", "\n\n a", "don't they're it's 'm", "a<|endoftext|>b <|startoftext|>", "İstanbul ß ſ é é ﬁ Ⅷ x²", "x\x1cy\x0bz a\u00a0b\u3000c",
    "日本語 テスト。", "....,, !!, ,. '.' a'. ab,", "\u0301a \u200bb", "ΑΣ ΣΑΣ. Ӂ, ǅ", "A_b c|d~ {x} \"q\" (y) z-", "ÀÉÿ. Straße, ¡hola! 12,5%",
]


def plain_pieces(docs):
    from tokenizers import Tokenizer

    whole, out = Tokenizer.from_file(PATH), []
    for doc_id, text in docs:
        ids = np.array(whole.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        for piece, start in enumerate(range(0, len(ids), b.CAPACITY)):
            own = ids[start : start + b.CAPACITY]
            out.append((doc_id, piece, start, len(own), zlib.crc32(own.tobytes())))
    return out


def test_tokens_are_those_of_the_tokenizer():
    t = b.BatchTokenizer(PATH)
    for texts in (ODD, ODD[::-1], [x for x in ODD if x] * 2):
        ids, ends = t.encode(pa.array(texts, pa.string()))
        for k, text in enumerate(texts):
            assert ids[ends[k] : ends[k + 1]].tolist() == (t.whole.encode(text, add_special_tokens=False).ids if text else [])


def test_small_cache_changes_nothing():
    t = b.BatchTokenizer(PATH)
    t.STEMS = 3
    for _ in range(3):
        ids, _ = t.encode(pa.array(["some words that are new, or not new"]))
        assert ids.tolist() == t.whole.encode("some words that are new, or not new", add_special_tokens=False).ids


def test_two_fit_beats_the_greedy_choice():
    assert b.plan_bins({7: 1, 2: 1, 1: 1}, 10) == [((7, 2, 1), 1)]
    assert b.plan_bins({6: 1, 3: 1, 2: 2}, 10) == [((6, 2, 2), 1), ((3,), 1)]


def first_fit_decreasing(lengths, capacity):
    gaps = []
    for x in sorted(lengths, reverse=True):
        k = next((k for k, g in enumerate(gaps) if g >= x), None)
        if k is None:
            gaps.append(capacity - x)
        else:
            gaps[k] -= x
    return len(gaps)


@pytest.mark.parametrize("seed", range(5))
def test_plan_uses_each_piece_once(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(100, rng.lognormal(3, 1, 3000).astype(int) + 1)
    counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
    plan = b.plan_bins(counts, 100)
    used = {}
    for bin_, times in plan:
        assert sum(bin_) <= 100 and times > 0
        for x in bin_:
            used[x] = used.get(x, 0) + times
    assert used == counts
    assert sum(t for _, t in plan) <= first_fit_decreasing(lengths.tolist(), 100)


def test_pack(spark):
    rng = np.random.default_rng(0)
    words = ["alpha", "beta,", "gamma.", "Été", "zz12", "###"]
    docs = [(k, " ".join(rng.choice(words, rng.integers(0, 900)))) for k in range(120)] + [(k + 500, t) for k, t in enumerate(ODD)]
    docs += [(7, docs[7][1]), (None, "no id"), (900, "beta " * 5000)]
    frame = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, length int")
    rows = b.pack(frame, PATH).collect()
    assert sorted(map(repr, ((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows))) == sorted(map(repr, plain_pieces(docs)))
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= b.CAPACITY
    assert len(bins) <= first_fit_decreasing([r.length for r in rows], b.CAPACITY)
    assert b.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
    ids = b.cut_pieces(frame.where("doc_id = 900"), PATH, with_ids=True).collect()
    assert sum((list(r.ids) for r in sorted(ids, key=lambda r: r.piece)), [])[-1] == 0 and [r.length for r in ids].count(2048) == 2
