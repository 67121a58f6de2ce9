import random

import numpy as np
import pytest

from granary.llm import soft_mixing as m

BAD = ["foul", "vile", "nasty"]


def corpus(n=400):
    rng = random.Random(4)
    docs, labels = [], []
    for k in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(rng.randrange(40, 200))]
        kind = rng.choice(["good"] * 6 + ["poor", "toxic"])
        if kind == "poor":
            words = [w + "###" for w in words]
        if kind == "toxic":
            for w in BAD:
                words[rng.randrange(len(words))] = w + ","
        docs.append((k, " ".join(words), f"s{k % 5}", "x"))
        labels.append((k, int(kind != "poor"), int(kind == "toxic")))
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string, source string, posterior string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


WEIGHTS = {"good": 0.9, "poor": 0.08, "toxic": 0.02}


def test_mix(spark):
    docs, labels = corpus()
    rows = m.mix(*frames(spark, docs, labels), WEIGHTS).collect()
    assert len(rows) == len(docs)
    kinds = {d: "toxic" if t else "good" if q else "poor" for d, q, t in labels}
    assert sum(kinds[r.doc_id] == r.domain for r in rows) >= 0.97 * len(rows)
    p, n, rates = np.array([r.posterior for r in rows]), np.array([r.n_tokens for r in rows]), np.array([r.rate for r in rows])
    before, after = n @ p, (n * rates) @ p
    target = np.array([WEIGHTS[d] for d in m.DOMAINS]) / WEIGHTS["good"] * before[0]
    assert np.allclose(p.sum(axis=1), 1) and (rates >= 0).all()
    assert np.abs(after - target).max() < 0.02 * n.sum()
    assert all(abs(r.copies - r.rate) < 1 for r in rows)
    assert np.abs(after - target).max() < 0.001 * n.sum()  # nothing holds these totals from their targets
    floored = m.mix(*frames(spark, docs, labels), WEIGHTS, floor=True).collect()
    assert all(r.copies >= 1 and r.rate >= 1 for r in floored if r.domain == "good")


def test_fit_takes_the_steps_of_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(m, "STRIDE", 3)
    rng = np.random.default_rng(2)
    p, n = rng.dirichlet([2, 0.5, 0.5], 300), rng.integers(0, 500, 300)
    rows = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p)], "n_tokens long, posterior array<double>")
    fit = m.fit_rates(rows, WEIGHTS)
    r = np.ones(300)
    for step in fit.steps:
        s = np.sqrt(n @ p)
        gram = (p * n[:, None]).T @ p / np.outer(s, s)
        want = -((n * r) @ p - np.array(fit.targets)) / s**2 / np.linalg.eigvalsh(gram)[-1]
        assert np.allclose(step, want)
        r = np.maximum(0, r + p @ step)
    assert np.allclose(fit.reached, (n * r) @ p)
    got = rows.select(fit.rate(m.F.col("posterior")).alias("r")).collect()
    assert np.allclose([x.r for x in got], r)
    error = lambda r: ((((n * r) @ p - np.array(fit.targets)) / s) ** 2).sum()
    assert error(r) < 0.05 * error(np.ones(300))


@pytest.mark.parametrize("weights", [WEIGHTS, {"good": 0.97, "poor": 0.03, "toxic": 0.0}, {"good": 0.3, "poor": 0.5, "toxic": 0.2}])
@pytest.mark.parametrize("alpha,floor", [([2, 0.5, 0.5], False), ([0.6, 0.1, 0.1], True), ([0.6, 0.1, 0.1], False), ([6, 3, 2], False)])
def test_rates_are_where_gradient_steps_end(spark, weights, alpha, floor):
    rng = np.random.default_rng(5)
    p, n = rng.dirichlet(alpha, 2000), rng.integers(0, 500, 2000)
    rows = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p)], "n_tokens long, posterior array<double>")
    fit = m.settle(rows, weights, floor=floor)
    t, s = np.array(fit.targets), np.sqrt(n @ p)
    low = np.where(floor & (t >= n @ p * (1 - 1e-9)), 1.0, 0.0)[p.argmax(axis=1)]
    width = 1 / np.linalg.eigvalsh((p * n[:, None]).T @ p / np.outer(s, s))[-1]
    plain = np.ones(2000)
    for _ in range(20_000):
        plain = np.maximum(low, plain - p @ (((n * plain) @ p - t) / s**2) * width)
    error = lambda r: ((((n * r) @ p - t) / s) ** 2).sum()
    got = np.array([x.r for x in rows.select(fit.rate(m.F.col("posterior")).alias("r")).collect()])
    assert (got >= low).all() and np.allclose(fit.reached, (n * got) @ p)
    assert error(got) <= 1.01 * error(plain) + 1e-6 * error(np.ones(2000))


def test_mix_uses_settled_rates(spark):
    docs, labels = corpus()
    blurred = [(a, 1 - q if a % 7 == 0 else q, 1 - t if a % 11 == 0 else t) for a, q, t in labels]
    rows = m.mix(*frames(spark, docs, blurred), WEIGHTS).collect()
    p, n, rates = np.array([r.posterior for r in rows]), np.array([r.n_tokens for r in rows]), np.array([r.rate for r in rows])
    t, s = np.array([WEIGHTS[d] for d in m.DOMAINS]) / WEIGHTS["good"] * (n @ p)[0], np.sqrt(n @ p)
    low = np.zeros(len(rows))
    slope = p @ (((n * rates) @ p - t) / s**2)  # least where no rate above its bound can be changed for the better
    held = rates <= low + 1e-9
    assert np.abs(slope[~held]).max() < 1e-3 and (not held.any() or slope[held].min() > -1e-3)


def test_resample_repeats_and_drops(spark):
    docs, labels = corpus(200)
    d, lab = frames(spark, docs, labels)
    once = {r.doc_id: r.copies for r in m.mix(d, lab, WEIGHTS).collect()}
    got = m.resample(d, lab, WEIGHTS)
    assert got.columns == d.columns
    counts = {k: 0 for k in once}
    for r in got.collect():
        counts[r.doc_id] += 1
    assert counts == once


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (2, 1, 0)], [(None, 1, 0), (1, None, None), (77, 0, 1)], [(1, 1, 0), (1, 0, 0), (2, 0, 1)]])
def test_few_labels(spark, labels):
    docs = [(1, "some words", "s", "x"), (2, None, None, None), (None, " ", "s", "x"), (1, "some words", "s", "x")]
    rows = m.mix(*frames(spark, docs, labels), WEIGHTS).collect()
    assert len(rows) == 4 and all(r.rate >= 0 and r.copies >= 0 for r in rows)
    assert {r.n_tokens for r in rows} == {2, 0}
    assert m.mix(*frames(spark, [], labels), WEIGHTS).count() == 0
