import random
import re

import numpy as np
import pytest
import xxhash

from granary.llm import simhash_trees as s


def plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(points, limit):
    name = {p: p for p in points}
    todo = set(points)
    while todo:
        start = todo.pop()
        front = [start]
        while front:
            p = front.pop()
            near = {q for q in todo if (p ^ q).bit_count() <= limit}
            todo -= near
            front += near
            for q in near:
                name[q] = start
    return name


def classes(name):
    out = {}
    for p, c in name.items():
        out.setdefault(c, set()).add(p)
    return {frozenset(x) for x in out.values()}


def clustered(rng, dense=400, alone=400):
    """A dense group, a chain, and fingerprints that have no neighbours."""
    flip = lambda p, n: p ^ sum(1 << b for b in rng.sample(range(64), n))
    center = rng.getrandbits(64)
    points = {flip(center, rng.choice([0, 1, 2, 2, 3, 4, 6])) for _ in range(dense)} | {rng.getrandbits(64) for _ in range(alone)} | {0}
    for p in rng.sample(sorted(points), 60):
        points |= {flip(p, 4), flip(p, 5)}
    return sorted(points)


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "A b\x0bC", "É Éa A B c D", "x y z w v " * 50, "a b c d e f g"])
def test_fingerprint(text):
    assert s.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("shard, hub_sample", [(8, 16_384), (64, 16_384), (4096, 16_384), (8, 100), (16, 40)])
def test_routes_and_search_lose_no_link(shard, hub_sample, monkeypatch):
    monkeypatch.setattr(s, "SAMPLE", hub_sample)
    monkeypatch.setattr(s, "DENSE", 8)
    monkeypatch.setattr(s, "LEAF", 6)
    rng = random.Random(shard)
    points = np.array(clustered(rng), np.uint64)
    sample = np.array(rng.sample(points.tolist(), 300), np.uint64)
    forest = s.plant(sample, len(points), shard=shard)
    rows = s.routes(forest, points)
    hub, _ = s.nearest_hub(forest, points)
    links = [(int(points[k]), int(forest.hubs[h])) for k, h in enumerate(hub) if h >= 0]
    links += [(a % 2**64, b % 2**64) for a, b in s.hub_links(s.few_of(sample, hub_sample), 4, forest)]
    shards = {}
    for tree, leaf, part, fp, query in zip(*(rows[c].tolist() for c in ("tree", "leaf", "part", "fp", "query"))):
        shards.setdefault((tree, leaf, part), ([], []))[query].append(fp % 2**64)
    for (tree, _, _), (members, queries) in shards.items():
        own = np.array(members + queries, np.uint64)
        at = np.arange(len(own))
        links += [(int(own[a]), int(own[b])) for a, b in s.search(own, at[: len(members)], at[len(members) :], s.block_masks()[tree], 4, 1)]
    assert all((a ^ b).bit_count() <= 4 for a, b in links)
    up = {p: p for p in points.tolist()}

    def root(p):
        while up[p] != p:
            p = up[p]
        return p

    for a, b in links:
        up[root(a)] = root(b)
    assert classes({p: root(p) for p in up}) == classes(plain_components(points.tolist(), 4))


def test_shards_do_not_grow_with_the_corpus():
    rng = np.random.default_rng(3)
    for total in (20_000, 200_000):
        points = rng.integers(0, 1 << 63, total, dtype=np.uint64)
        forest = s.plant(points[: s.PER_SHARD * total // 64], total, shard=64, depth=4)
        for tree, parts in zip(forest.trees, forest.parts):
            members = np.bincount(tree.leaves_of(points, 0)[1], minlength=tree.leaves) / parts
            assert members.max() <= 6 * 64
    assert s.tree_sample_size(10) == s.SAMPLE == s.tree_sample_size(8_000_000) and s.tree_sample_size(10**8) > 100_000
    assert s.tree_sample_size(10**12) == s.TREE_SAMPLE


def test_components_of_a_path_and_a_star(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7)]
    got = {r.node: r.component for r in s.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {100 + k: 100 for k in range(1, 30)}


def test_documents(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(500)]
    base = [rng.choice(words) for _ in range(400)]
    texts = [" ".join(base[:k] + ["new"] + base[k + 1 :]) for k in range(60)] + [" ".join(rng.choice(words) for _ in range(300)) for _ in range(60)]
    texts += [None, "", "   ", texts[0].upper(), "x"]
    docs = [(k + 5, t, "s") for k, t in enumerate(texts)] + [(None, "x", "s"), (5, texts[0], "s")]
    got = s.near_copies(spark.createDataFrame(docs, "doc_id long, text string, fp string"), ["doc_id"]).collect()
    prints = [plain_fingerprint(t) for _, t, _ in docs]
    name = plain_components(sorted(set(prints)), 4)
    first = {}
    for (doc_id, _, _), p in zip(docs, prints):
        if doc_id is not None:
            first[name[p]] = min(doc_id, first.get(name[p], doc_id))
    want = [(d, p - (p >> 63 << 64), first[name[p]]) for (d, _, _), p in zip(docs, prints)]
    assert sorted(map(repr, [(r.doc_id, r.fp, r.component_id) for r in got])) == sorted(map(repr, want))
    assert s.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0
