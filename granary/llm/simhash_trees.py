"""Near copies by SimHash: fingerprints are linked within a Hamming distance through vantage-point trees.

Distances over all 64 bits of unrelated texts lie so close together that no vantage point tells them apart within a
radius of 4. The bits are therefore cut into ``BLOCKS`` blocks: two fingerprints within the distance differ by no more
than distance / blocks in one of them, so each block has a tree of its own, over the Hamming distance within the block, which is
searched with that smaller radius.

1. The upper part of each tree is built on a bounded sample of the distinct fingerprints that grows with the corpus up
   to its bound, and so does the depth: a node has a vantage point
   and a median distance. Every fingerprint is a member of one leaf (shard) of each tree, and is a query in all leaves that the
   triangle inequality cannot rule out: its own, and those whose boundary its radius overlaps.
2. A shard holds its members and its queries. It goes on splitting both by vantage points in memory, compares whole
   fingerprints in the leaves, and returns links that keep together what is linked, never all pairs of a group.
3. Links are joined into components by repeated large-star and small-star steps on tables.

Groups of copies: equal fingerprints are one. Dense groups show in the sample; their sampled fingerprints become hubs. What lies
within the distance of a hub is linked to it at once; members of the group that dominates a leaf do not look for each
other there (``silent``), but everything else in reach of the leaf looks for them. Leaves that the sample
shows to be large are dealt out over several tasks, each of which sees all queries. No link between different
groups is lost by this; see ``routes``.

Results in special cases: NULL or blank texts have the fingerprint zero and are linked like any other; repeated rows
get the same component each; NULL doc_ids never name a component unless all of it are NULL; an empty table gives no
rows; further columns are carried along if named in ``keep``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import bounded_share, written

SHINGLE = 4
DISTANCE = 4
BLOCKS = 3
BITS = 64
#: Sampled fingerprints, at most: for hubs, and for vantage points and the sizes of leaves.
SAMPLE = 16_384
TREE_SAMPLE = 1 << 18
#: Members of a shard, about; sampled fingerprints a shard, if the bound allows for them; and the least depth of the upper
#: trees, which get deeper as the corpus grows.
SHARD = 4_096
PER_SHARD = 8
DEPTH = 12
#: Sampled fingerprints that a dense group has at least, and hubs that it gets at most.
DENSE = 24
HUBS = 128
LEAF = 48


# --- fingerprints ----------------------------------------------------------------------------------------------------


def fingerprint(text: str | None) -> int:
    """SimHash of the word shingles of a text, repeats included."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # on bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], 42) for a, b in zip(starts[: len(words) - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist())]
    h = np.array(hashes, np.uint64)
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(h), 1 << 16):  # bounded memory for very long texts
        ones += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the fingerprint as a signed long, ``fp``."""
    return docs.select(*keep, _fingerprints()(F.col("text")).alias("fp"))


def _fingerprints():
    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))

    return fp


# --- trees -----------------------------------------------------------------------------------------------------------


def block_masks(blocks: int = BLOCKS) -> list[np.uint64]:
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    return [np.uint64(((1 << (b - a)) - 1) << a) for a, b in zip(edges, edges[1:])]


def distance(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def split_of(points: np.ndarray) -> tuple[np.uint64, int] | None:
    """A vantage point (masked) and the distance up to which points are inside; None if all are equal."""
    low = points.min()
    if low == points.max():
        return None
    far = distance(points, low)
    vantage = points[int(np.argmax(far))]  # at the rim, distances spread most
    d = distance(points, vantage)
    cut = int(np.median(d))
    return (vantage, cut) if cut < d.max() else (vantage, cut - 1)


@dataclass
class Tree:
    """Nodes in arrays; leaves are numbered. A point is inside if its distance to the vantage point is at most the cut."""

    mask: np.uint64
    vantage: list[int]
    cut: list[int]
    inside: list[int]
    outside: list[int]
    leaves: int

    @classmethod
    def build(cls, mask: np.uint64, sample: np.ndarray, leaf_size: int, depth: int) -> Tree:
        tree = cls(mask, [], [], [], [], 0)

        def grow(points: np.ndarray, level: int) -> int:
            """Positive: a node; negative: the leaf -1 - x."""
            found = split_of(points) if len(points) > leaf_size and level < depth else None
            if found is None:
                tree.leaves += 1
                return -tree.leaves
            k = len(tree.vantage)
            for column, value in ((tree.vantage, int(found[0])), (tree.cut, found[1]), (tree.inside, 0), (tree.outside, 0)):
                column.append(value)
            near = distance(points, found[0]) <= found[1]
            tree.inside[k] = grow(points[near], level + 1)
            tree.outside[k] = grow(points[~near], level + 1)
            return k

        grow(sample & mask, 0)
        return tree

    def leaves_of(self, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of point, leaf) for every leaf that may hold something within the radius."""
        todo = [(0 if self.vantage else -1, np.arange(len(points)))]
        masked, who, where = points & self.mask, [], []
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if node < 0:
                who.append(at)
                where.append(np.full(len(at), -1 - node))
                continue
            d = distance(masked[at], np.uint64(self.vantage[node])).astype(np.int64)
            todo.append((self.inside[node], at[d - radius <= self.cut[node]]))
            todo.append((self.outside[node], at[d + radius > self.cut[node]]))
        return (np.concatenate(who), np.concatenate(where)) if who else (np.zeros(0, np.int64),) * 2


@dataclass
class Forest:
    """What every task needs to know; its size is bounded by the sample's."""

    trees: list[Tree]
    parts: list[np.ndarray]  # of each tree: over how many tasks a leaf's members are dealt
    dominant: list[np.ndarray]  # of each tree: the dense group that a leaf is full of, or -1
    hubs: np.ndarray
    hub_group: np.ndarray
    limit: int
    radius: int


def components_of(points: np.ndarray, limit: int) -> np.ndarray:
    """Component numbers of a bounded set of points, by breadth-first search over those not reached yet."""
    out = np.full(len(points), -1)
    left = np.arange(len(points))
    n = 0
    while len(left):
        front, left = left[:1], left[1:]
        while len(front):
            out[front] = n
            reached = np.zeros(len(left), bool)
            for k in range(0, len(front), 64):
                open_ = np.flatnonzero(~reached)
                if not len(open_):
                    break
                reached[open_] = (distance(points[left[open_]][None, :], points[front[k : k + 64]][:, None]) <= limit).any(axis=0)
            front, left = left[reached], left[~reached]
        n += 1
    return out


def tree_sample_size(total: int, shard: int = SHARD) -> int:
    """Sampled fingerprints for the trees: some for every shard of the corpus, within the bound."""
    return min(TREE_SAMPLE, max(SAMPLE, PER_SHARD * total // shard))


def few_of(sample: np.ndarray, bound: int) -> np.ndarray:
    """``bound`` points of a sample, those with the smallest hashes, sorted."""
    mixed = sample * np.uint64(0xBF58476D1CE4E5B9)
    return np.sort(sample[np.argsort(mixed ^ (mixed >> np.uint64(29)), kind="stable")[:bound]])


def plant(sample: np.ndarray, total: int, limit: int = DISTANCE, blocks: int = BLOCKS, shard: int = SHARD, depth: int = DEPTH) -> Forest:
    """Trees on all of the sample, hubs on a share of it that is compared with itself. Leaves with more members than a shard
    has, as far as the sample tells, are dealt out, so that no task's members grow with the corpus."""
    sample = np.sort(sample)
    per_row = max(1.0, total / max(1, len(sample)))
    radius = limit // blocks
    depth = max(depth, math.ceil(math.log2(max(1.0, total / shard))))
    trees = [Tree.build(m, sample, max(1, int(shard / per_row)), depth) for m in block_masks(blocks)]
    everything, sample = sample, few_of(sample, SAMPLE)
    group = components_of(sample, limit)
    sizes = np.bincount(group) if len(group) else np.zeros(0, int)
    hubs, hub_group = [], []
    for g in np.flatnonzero(sizes >= DENSE):
        own = sample[group == g]
        todo = np.ones(len(own), bool)
        for _ in range(HUBS):  # a cover: each next hub is the one that reaches most of what no hub has reached yet
            if not todo.any():
                break
            some = np.flatnonzero(todo)[:: max(1, int(todo.sum()) // 64)]
            reach = distance(own[some][:, None], own[None, :]) <= limit
            best = int(np.argmax((reach & todo).sum(axis=1)))
            hubs.append(own[some[best]])
            hub_group.append(g)
            todo &= ~reach[best]
    parts, dominant = [], []
    for tree in trees:
        full = np.bincount(tree.leaves_of(everything, 0)[1], minlength=tree.leaves)
        parts.append(np.maximum(1, np.ceil(full * per_row / shard)).astype(np.int64))
        who, leaf = tree.leaves_of(sample, 0)
        top = np.full(tree.leaves, -1)
        for k in np.flatnonzero(parts[-1] > 1):
            counts = np.bincount(group[who[leaf == k]], minlength=1)
            best = int(np.argmax(counts))
            if counts[best] >= DENSE and best in set(hub_group):
                top[k] = best
        dominant.append(top)
    return Forest(trees, parts, dominant, np.array(hubs, np.uint64), np.array(hub_group, np.int64), limit, radius)


def nearest_hub(forest: Forest, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a hub within the limit or -1, its group or -1) of each point."""
    hub = np.full(len(points), -1)
    for k in range(0, len(points), 4096):
        at = slice(k, k + 4096)
        if len(forest.hubs):
            near = distance(points[at][:, None], forest.hubs[None, :]) <= forest.limit
            hub[at] = np.where(near.any(axis=1), near.argmax(axis=1), -1)
    return hub, np.where(hub >= 0, forest.hub_group[hub] if len(forest.hubs) else -1, -1)


ROUTES = "tree int, leaf int, part int, fp long, query boolean, grp long"


def routes(forest: Forest, points: np.ndarray) -> dict[str, np.ndarray]:
    """Where each fingerprint is a member, and where it is a query.

    A point that belongs to the group dominating its own leaf does not query leaves dominated by that group. No link is
    lost: if x skips the home of y, both homes are dominated by x's group; were y of another group, it would not skip
    x's home and so would find x; and if it is of the same group, hubs link them.
    """
    _, group = nearest_hub(forest, points)
    out: list[tuple] = []
    mixed = (points * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
    for t, tree in enumerate(forest.trees):
        who, leaf = tree.leaves_of(points, 0)
        home = np.empty(len(points), np.int64)
        home[who] = leaf
        out.append((np.full(len(who), t), leaf, (mixed[who] % forest.parts[t][leaf].astype(np.uint64)).astype(np.int64), who, np.zeros(len(who), bool)))
        who, leaf = tree.leaves_of(points, forest.radius)
        dom = forest.dominant[t]
        silent = (group[who] >= 0) & (dom[leaf] == group[who]) & (dom[home[who]] == group[who])
        who, leaf = who[~silent], leaf[~silent]
        times = forest.parts[t][leaf]
        part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        who, leaf = np.repeat(who, times), np.repeat(leaf, times)
        out.append((np.full(len(who), t), leaf, part, who, np.ones(len(who), bool)))
    tree_, leaf, part, who, query = (np.concatenate(x) for x in zip(*out))
    return {"tree": tree_, "leaf": leaf, "part": part, "fp": points[who].view(np.int64), "query": query, "grp": group[who]}


class Links:
    """Union-find over the points of one shard; keeps the pairs that joined two sets."""

    def __init__(self, n: int):
        self.up, self.pairs = np.arange(n), []

    def root(self, k: int) -> int:
        up = self.up
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist()):
            r, s = self.root(x), self.root(y)
            if r != s:
                self.up[max(r, s)] = min(r, s)
                self.pairs.append((x, y))


def search(points: np.ndarray, members: np.ndarray, queries: np.ndarray, mask: np.uint64, limit: int, radius: int) -> list[tuple[int, int]]:
    """Links (pairs of positions in ``points``) that connect whatever a query and a member within the limit connect."""
    links = Links(len(points))
    masked = points & mask
    todo = [(members, queries)]
    while todo:
        m, q = todo.pop()
        if not len(m) or not len(q):
            continue
        split = split_of(masked[m]) if len(m) > LEAF else None
        if split is not None:
            vantage, cut = split
            dm, dq = distance(masked[m], vantage).astype(np.int64), distance(masked[q], vantage).astype(np.int64)
            todo.append((m[dm <= cut], q[dq - radius <= cut]))
            todo.append((m[dm > cut], q[dq + radius > cut]))
            continue
        # in a leaf: members that the first one reaches need not be joined one by one again
        for k in range(0, len(q), 256):
            own = q[k : k + 256]
            for j in range(0, len(m), 4096):
                a, b = np.nonzero(distance(points[own][:, None], points[m[j : j + 4096]][None, :]) <= limit)
                if len(a):
                    x, y = own[a], m[j : j + 4096][b]
                    for _ in range(3):  # most pairs are joined already
                        up = links.up
                        while not np.array_equal(up, up[up]):
                            up = links.up = up[up]
                        fresh = up[x] != up[y]
                        x, y = x[fresh], y[fresh]
                        if not len(x):
                            break
                        first = np.unique(np.maximum(up[x], up[y]), return_index=True)[1]
                        links.join(x[first], y[first])
                    links.join(x, y)
    return links.pairs


def shard_links(forest_masks: list[int], limit: int, radius: int):
    def links(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        points, at = np.unique(rows["fp"].to_numpy().view(np.uint64), return_inverse=True)
        query = rows["query"].to_numpy()
        found = search(points, np.unique(at[~query]), np.unique(at[query]), np.uint64(forest_masks[int(key[0])]), limit, radius)
        ends = np.array(found, np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": points[ends[:, 0]].view(np.int64), "b": points[ends[:, 1]].view(np.int64)})

    return links


def links_between(fps: DataFrame, limit: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """Links (a, b) of distinct fingerprints (column fp) whose components are those of all pairs within the limit."""
    total = fps.count()
    sample = bounded_share(fps.select("fp"), tree_sample_size(total), F.col("fp"), total).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    forest = plant(sample, total, limit, blocks)

    def to_hubs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            points = batch["fp"].to_numpy(np.int64).view(np.uint64)
            hub, _ = nearest_hub(forest, points)
            at = np.flatnonzero(hub >= 0)
            yield pd.DataFrame({"a": points[at].view(np.int64), "b": forest.hubs[hub[at]].view(np.int64)})

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            points = batch["fp"].to_numpy(np.int64).view(np.uint64)
            for k in range(0, len(points), 2048):
                yield pd.DataFrame(routes(forest, points[k : k + 2048]))

    masks = [int(m) for m in block_masks(blocks)]
    found = fps.select("fp").mapInPandas(dealt, ROUTES).groupBy("tree", "leaf", "part").applyInPandas(shard_links(masks, limit, limit // blocks), "a long, b long")
    if not len(forest.hubs):
        return found
    # sampled hubs of one group are linked among themselves through the sample's own points
    pairs = hub_links(few_of(sample, SAMPLE), limit, forest)
    known = fps.sparkSession.createDataFrame(pairs, "a long, b long") if pairs else found.limit(0)
    return found.unionByName(fps.select("fp").mapInPandas(to_hubs, "a long, b long")).unionByName(known)


def hub_links(sample: np.ndarray, limit: int, forest: Forest) -> list[tuple[int, int]]:
    """Links within the sample that hold each dense group together: no more than the sample has points."""
    group = components_of(sample := np.sort(sample), limit)
    out: list[tuple[int, int]] = []
    for g in np.unique(forest.hub_group):
        own = sample[group == g]
        left, front = np.arange(1, len(own)), np.array([0])
        while len(front) and len(left):
            d = distance(own[left][None, :], own[front][:, None]) <= limit
            reached = d.any(axis=0)
            out += zip(own[front[d.argmax(axis=0)[reached]]].view(np.int64).tolist(), own[left[reached]].view(np.int64).tolist())
            front, left = left[reached], left[~reached]
    return out


# --- components ------------------------------------------------------------------------------------------------------


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component): the smallest node that each linked node reaches, by large-star and small-star steps.

    Both steps give every node's neighbours the smallest of them, from minima that are aggregated before the shuffle;
    they end when no link changes.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = written(small.where("a <> b").distinct(), "small-star")
        now = tuple(edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 30)))).first())
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def near_copies(docs: DataFrame, keep: list[str] | None = None, limit: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """``keep``, fp, component (the smallest fp that can be reached, both signed longs), component_id (the smallest such doc_id)."""
    keep = ["doc_id"] if keep is None else keep
    rows = written(with_fingerprints(docs, keep), "fingerprints")
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    found = components(links_between(fps, limit, blocks))
    named = fps.join(found, fps["fp"] == found["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    ids = named.groupBy("component").agg(F.min("first").alias("component_id"))
    return rows.join(named.join(ids, "component").select("fp", "component", "component_id"), "fp").select(*keep, "fp", "component", "component_id")


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
