import random
import re

from pyspark.sql import functions as F

from granary.llm.line_dedup import LEAST_WORDS, dedup_lines

SCHEMA = "doc_id long, text string, other string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_force(docs):
    seen, out = [], {}
    for doc_id, text in sorted(docs, key=lambda d: d[0]):
        kept = []
        for line in text.split("\n"):
            words = WORD.findall(line.lower())
            if words and any(words == w or min(len(words), len(w)) >= LEAST_WORDS and abs(len(words) - len(w)) < 2 and edits(words, w) <= 1 for w in seen):
                continue
            kept.append(line)
        seen += [w for line in text.split("\n") if (w := WORD.findall(line.lower()))]
        out[doc_id] = "\n".join(kept)
    return out


def within_document(docs):
    """Lines of the same document count as earlier too: one pseudo document per line, put together again."""
    lines = [(d, n, line) for d, text in docs for n, line in enumerate(text.split("\n"))]
    kept = brute_force([((d, n), line) for d, n, line in lines])
    words = lambda s: WORD.findall(s)
    return {d: "\n".join(line for e, n, line in lines if e == d and (not words(line) or words(kept[d, n]))) for d, _ in docs}


def changed(rng, words):
    words = list(words)
    for _ in range(rng.choice([1, 1, 1, 2])):
        k = rng.randrange(len(words))
        how = rng.randrange(3)
        if how == 0:
            words[k] = rng.choice("xyz")
        elif how == 1:
            words.insert(k, rng.choice("xyz"))
        else:
            del words[k]
    return words


def test_against_brute_force(spark):
    rng = random.Random(5)
    bases = [[rng.choice("abcdefgh") for _ in range(rng.choice([3, 9, 10, 11, 12, 30]))] for _ in range(12)]
    docs = []
    for doc_id in range(80):
        lines = [" ".join(changed(rng, rng.choice(bases))) for _ in range(rng.randrange(6))] + rng.choice([[], ["", "  "], ["A b", "a  B"]])
        docs.append((doc_id, "\n".join(lines)))
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame([(d, t, "o") for d, t in docs], SCHEMA)).collect()}
    assert got == within_document(docs)


def test_very_long_lines(spark):
    words = [f"w{k}" for k in range(3000)]
    less, more, other = words[:1499] + words[1500:], words[:2000] + ["new"] + words[2000:], words[:-1] + ["end"]
    docs = [(k, " ".join(w), None) for k, w in enumerate([words, less, more, other, words[::-1]])]
    got = {r.doc_id: r.n_kept for r in dedup_lines(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert got == {0: 1, 1: 0, 2: 0, 3: 0, 4: 1}


def test_special_rows(spark):
    docs = [(1, None, "a"), (1, "one line", "b"), (1, "one line", "c"), (None, "one line", "d"), (2, "", "e"), (3, "\n\nX y\nx Y", "f")]
    got = dedup_lines(spark.createDataFrame(docs, SCHEMA))
    assert sorted((r.other, r.text, r.n_lines, r.n_kept) for r in got.collect()) == [
        ("a", None, 0, 0),
        ("b", "", 1, 0),
        ("c", "", 1, 0),
        ("d", "one line", 1, 1),
        ("e", "", 0, 0),
        ("f", "\n\nX y", 2, 1),
    ]
    assert dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_input_columns_may_have_any_name(spark):
    plain = spark.createDataFrame([(1, "one\ntwo"), (2, "two\nthree"), (3, None)], "doc_id long, text string")
    own = ("_ld_doc", "_ld_text", "_ld_keep", "_ld_lines", "_x", "a.b", "words", "id")
    clash = plain.select("*", *[F.lit(f"<{c}>").alias(c) for c in own], F.lit("x").alias("N_LINES"), F.lit("x").alias("n_kept"))
    got = sorted(dedup_lines(clash).collect(), key=lambda r: r.doc_id)
    assert [(r.text, r.n_lines, r.n_kept) for r in got] == [("one\ntwo", 2, 2), ("three", 2, 1), (None, 0, 0)]
    assert all(r[c] == f"<{c}>" for r in got for c in own)
