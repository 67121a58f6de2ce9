import random
import re

import numpy as np
import pytest

from granary.llm import ngram_product as m


def plain_set(text, words=5):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()


def plain_components(rows, percent=80):
    sets = [plain_set(t) for _, t in rows]
    name = list(range(len(rows)))
    for k in range(len(rows)):
        if name[k] == k:
            front = [k]
            while front:
                x = front.pop()
                for y in range(len(rows)):
                    if name[y] == y and y != k and sets[x] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                        name[y] = k
                        front.append(y)
    least = {}
    for (i, _), c in zip(rows, name):
        least[c] = min(least.get(c, i), i)
    return sorted((i, len(s), least[c]) for (i, _), s, c in zip(rows, sets, name))


def corpus(seed, base=60, group=150):
    """Unrelated texts, chains of near copies, one large group of near copies with and without its original, a shared passage."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(4))
    text = lambda n: [word() for _ in range(n)]

    def edited(w, k):
        w = list(w)
        for _ in range(k):
            w[rnd.randrange(len(w))] = word()
        return w

    rows = [text(rnd.randint(1, 120)) for _ in range(base)]
    for n in (30, 60, 120):
        w = text(n)
        for _ in range(12):  # a chain: the ends have little in common
            rows.append(w := edited(w, max(1, n // 60)))
    for keep_first in (True, False):
        w = text(100)
        rows += [edited(w, rnd.choice([0, 1, 1, 2, 2, 3]) if keep_first else 2) for _ in range(group)]
    passage = text(80)
    rows += [passage + text(rnd.randint(5, 60)) for _ in range(60)]
    rows += [passage[k:] for k in range(0, 20, 4)]
    rows += [rows[3]] * 20
    rnd.shuffle(rows)
    return [(k, " ".join(w)) for k, w in enumerate(rows)]


@pytest.mark.parametrize("part", [4096, 16])
def test_against_all_pairs(spark, monkeypatch, part):
    monkeypatch.setattr(m, "PART", part)
    rows = corpus(11 + part) + [(9001, None), (9002, " \t\n"), (9003, "Three Short words"), (9004, "three short\nWORDS"), (9005, "three short"), (9006, "É é x"), (9006, "É é x")]
    got = m.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(tuple(r) for r in got.collect()) == plain_components(rows)


def test_prefix_and_bounds():
    for n in range(1, 300):
        assert n - m.prefix_size(n) + 1 == -(-80 * n // 100)
    a, b = m.ngram_set("a b c d e f g"), m.ngram_set("A B  C\td e f g")
    assert (a == b).all() and len(a) == 3
    assert len(m.ngram_set("a a a a a a a")) == 1 and len(m.ngram_set("a b")) == 1 and len(m.ngram_set(None)) == 0
    words = [random.Random(1).choice("abc") for _ in range(3000)]
    assert len(m.ngram_set(" ".join(words))) == len(plain_set(" ".join(words)))


def test_marks_bound_the_overlap():
    rnd = random.Random(4)
    for n in (5, 90, 700):
        a = [rnd.choice("abcdefgh") * rnd.randint(1, 9) for _ in range(n)]
        b = [w if rnd.random() > 0.05 else "x" for w in a]
        x, y = (m.ngram_set(" ".join(w)) for w in (a, b))
        differ = int(np.bitwise_count(m.marks_of(x) ^ m.marks_of(y)).sum())
        assert len(np.setxor1d(x, y)) >= differ and (n < 90 or differ > 0)


def test_empty_table_null_ids_and_clashing_columns(spark):
    schema = "doc_id long, text string, sid string, n string, g int, pos int, th string, component int, node int"
    rows = [(None, "one two three four five six", "x", "y", 1, 2, "z", 3, 4), (5, "one two three four five six", "x", "y", 1, 2, "z", 3, 4), (None, None, "x", "y", 1, 2, "z", 3, 4)]
    docs = spark.createDataFrame(rows, schema)
    assert sorted((tuple(r) for r in m.jaccard_components(docs).collect()), key=repr) == [(5, 2, 5), (None, 0, None), (None, 2, 5)]
    assert m.jaccard_components(docs.where("n = 'none'")).collect() == []


def blocks_corpus(seed, pairs=12, short=False):
    """Pairs of long texts that share a rare block and have little else in common but common blocks; one is followed by a near copy."""
    rnd = random.Random(seed)
    block = lambda: [f"{rnd.randrange(10**6)}x" for _ in range(100)]
    common = [block() for _ in range(40)]
    rows = []
    for k in range(pairs):
        rare = block()
        for j in range(2):
            own = list(rare)
            for c in rnd.sample(common, 1 if short and j else 12):
                own += c
            rows.append(own)
        if not k:
            rows.append(rows[-1][:-8] + ["end"])
    return [(k, " ".join(w)) for k, w in enumerate(rows)]


def seen(monkeypatch, look):
    """What ``look`` says of each table that is written, by label."""
    found, write = {}, m.written

    def spy(df, label):
        out = write(df, label)
        found.setdefault(label, []).append(look(out, label))
        return out

    monkeypatch.setattr(m, "written", spy)
    return found


def test_long_texts_that_share_a_block_are_not_moved_whole(spark, monkeypatch):
    rows = blocks_corpus(7)
    found = seen(monkeypatch, lambda df, label: df.count() if label == "sets" else None)
    got = m.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert sorted(tuple(r) for r in got.collect()) == plain_components(rows)
    assert 2 <= sum(found["sets"]) <= 6  # the two that link, and few others; all 25 met in a column


def test_two_rows_that_sizes_keep_apart_share_no_column(spark, monkeypatch):
    def apart(df, label):
        if label == "columns":
            return df.groupBy("g").agg({"n": "min", "*": "count"}).join(df.groupBy("g").agg({"n": "max"}), "g").where("`count(1)` = 2 AND 100 * `min(n)` < 80 * `max(n)`").count()

    rows = blocks_corpus(9, short=True)
    found = seen(monkeypatch, apart)
    got = m.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert sorted(tuple(r) for r in got.collect()) == plain_components(rows)
    assert found["columns"][0] <= 60  # those at the ends of batches; hundreds are shared


def test_counts_bound_the_overlap():
    rnd = random.Random(6)
    for n in (1, 5, 90, 700, 9000):
        a = [str(rnd.randrange(10**6)) for _ in range(n)]
        for b in ([w if rnd.random() > 0.02 else "x" for w in a], a[: n * 4 // 5], [w + "y" for w in a], ["z"] * 6):
            x, y = (m.ngram_set(" ".join(w)) for w in (a, b))
            differ = m.counts_differ(m.counts_of(x), m.counts_of(y))
            assert differ == m.counts_differ(m.counts_of(y), m.counts_of(x)) <= len(np.setxor1d(x, y))
            if n > 50 and b[0] == a[0] + "y":
                assert 180 * (len(x) + len(y) - differ) < 160 * (len(x) + len(y))  # sets of any size are told apart
    same = np.full(1000, 64, np.uint64) * np.arange(1000, dtype=np.uint64)  # more than a byte holds in one bin
    assert m.counts_differ(m.counts_of(same), m.counts_of(same)) == 0


def test_places_that_may_link():
    rnd = random.Random(8)
    for _ in range(50):
        g = np.array(sorted(k for k in range(40) for _ in range(rnd.randint(1, m.SHORT))))
        n = np.array([rnd.choice([10, 11, 12, 13, 50, 55]) for _ in g])
        pos = np.array([rnd.randrange(0, k // 5 + 1) for k in n])
        for p, stay in enumerate(m.may_link(g, n, pos, 80)):
            others = [q for q in range(len(g)) if q != p and g[q] == g[p]]
            fit = any(100 * min(n[p], n[q]) >= 80 * max(n[p], n[q]) and 180 * min(n[p] - pos[p], n[q] - pos[q]) >= 80 * (n[p] + n[q]) for q in others)
            assert stay == (fit or g[p] in (g[0], g[-1]))
