import hashlib
import math
import random

import numpy as np
import pytest

from granary.llm import ns_clustering as m


def plain(rows, dim, k, rounds):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for n in range(rounds + 1):
        chosen = [min((d(v, c), j) for j, c in enumerate(centroids)) for _, v in kept]
        for j in range(len(centroids) if n < rounds else 0):
            own = [v for (_, v), (_, c) in zip(kept, chosen) if c == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    return sorted(((i, j, dist) for (i, _), (dist, j) in zip(kept, chosen)), key=repr), centroids


def vectors(seed, n, dim, spread=1.0):
    rnd = random.Random(seed)
    middles = [[rnd.uniform(-spread, spread) for _ in range(dim)] for _ in range(6)]
    return [(i, [x + rnd.gauss(0, spread / 4) for x in rnd.choice(middles)]) for i in range(n)]


@pytest.mark.parametrize("seed,k,rounds,spread", [(1, 5, 3, 1.0), (2, 9, 6, 0.05), (3, 16, 4, 900.0)])
def test_against_plain_rounds(spark, seed, k, rounds, spread):
    rows = vectors(seed, 400, 8, spread)
    rows += [(900 + i, rows[0][1]) for i in range(100)]  # one very common vector
    rows += [(None, rows[1][1]), (7, rows[7][1]), (1001, None), (1002, [0.5] * 7), (1003, [None] + [0.5] * 7), (1004, [float("nan")] * 8), (1005, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    found, centroids = m.cluster_vectors(df, k=k, rounds=rounds, dim=8)
    want, want_centroids = plain(rows, 8, k, rounds)
    assert centroids.tolist() == want_centroids
    got = m.with_measures(found, centroids).collect()
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=repr) == want
    assert {r.inertia for r in got} == {sum(d for *_, d in want)}
    for j in {r.cluster for r in got}:
        assert {(r.cluster_inertia, r.centroid_sha256) for r in got if r.cluster == j} == {
            (sum(d for _, c, d in want if c == j), hashlib.sha256(",".join(map(str, want_centroids[j])).encode()).hexdigest())
        }


def test_bounds_hold_and_save_work():
    rng = np.random.default_rng(5)
    v = rng.integers(-60, 60, (3000, 16)) + rng.integers(0, 8, 3000)[:, None] * 40
    history = m.History([v[rng.choice(3000, 12, replace=False)].astype(np.int64)])
    cluster, bounds, since = np.zeros(3000, np.int64), np.zeros((3000, 12), np.float32), np.zeros((3000, 12), np.int16)
    took = []
    for _ in range(8):
        took.append(m.reassign(v, cluster, bounds, since, history))
        exact = np.stack([m.squared(v, c) for c in history.now], axis=1)
        assert (cluster == exact.argmin(axis=1)).all()
        moved = history.displacement()[since, np.arange(12)]
        assert (bounds - moved <= np.sqrt(exact)).all()
        now = history.now.copy()
        for j in range(12):
            if (cluster == j).any():
                now[j] = np.floor(v[cluster == j].mean(axis=0))
        history.rounds.append(now)
    assert took[0] == 3000 * 12 and took[-1] < 3000 * 3


def test_total_displacement_is_tighter_than_summed_drifts():
    there = np.array([[10, 0], [0, 0]])
    history = m.History([there, there + [[5, 0], [0, 0]], there])
    assert history.displacement()[0, 0] == 0  # summed moves would be 10


def test_few_vectors_empty_table_and_clashing_columns(spark):
    schema = "vec_id long, embedding array<float>, v int, cluster string, bounds int, since int, was int, distance int, h int"
    rows = spark.createDataFrame([(5, [0.25] * 64, 1, "x", 2, 3, 4, 5, 6), (6, [0.25] * 64, 1, "x", 2, 3, 4, 5, 6), (8, [1e30] * 64, 1, "x", 2, 3, 4, 5, 6)], schema)
    got = sorted(tuple(r)[:5] for r in m.with_measures(*m.cluster_vectors(rows)).collect())
    assert got == [(5, 0, 0, 0, 0), (6, 0, 0, 0, 0)]
    none = m.with_measures(*m.cluster_vectors(rows.where("vec_id < 0")))
    assert none.collect() == [] and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
