"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence matrix.

Two documents link if the Jaccard similarity of their sets of word shingles reaches a threshold. Only rows that can reach it are ever
multiplied, and only in columns that matter:

1. Equal sets are one row of the matrix (``sid``). While the sets are made, every task counts n-grams in a sketch of
   ``COUNTERS`` counters, summed over all documents. Counter and hash give all n-grams one order, rare ones first.
2. A row of n n-grams needs at least t n of them in common with any partner, so two rows that link share a column among their first
   n - ceil(t n) + 1. Only these columns are multiplied, and only those that two rows have.
3. Where two rows meet in a column, the pair is compared with the bound that the sizes give: what they can still share from
   there on must reach t / (1 + t) of both sizes. Each row also carries ``MARKS`` parity bits of its n-grams: marks that
   differ are never more than n-grams that differ, which bounds the overlap from above. What is left is compared by counts
   of n-grams in bins (``counts_of``), whose number grows with the set, so that long sets are told apart too. Only rows in pairs
   that this leaves are read again whole, and their whole overlap is summed up.
4. A column that a whole group of copies shares is not multiplied out. In a first product two rows stand for each
   column, the one whose place of this column is earliest and one that a hash picks anew in each column; every row meets
   two of those that stand for its columns, and their links make components (large-star and small-star steps). It may leave links out. In a second product, rows of different components meet, so a group that hangs together already gives no pairs.
   Long columns are cut into blocks of ``PART`` rows; rows of the component that most of a column belongs to are
   asked for, but never ask. Both products together link whatever all pairs would link.

Results in special cases: NULL, blank and wordless texts have no n-gram and link with nothing, so their component is their own id;
texts with fewer words than a shingle have their whole sequence as one; repeated rows and equal texts link; NULL ids never
name a component unless all of it are NULL; very long texts give their whole set; an empty table gives no rows. Other
columns, whatever their names, are not read. N-grams are compared by 64-bit hashes of their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import written
from granary.llm.simhash_trees import components

WORDS = 5
PERCENT = 80
#: Counters of the sketch (a power of two); more tell common from rare n-grams in larger corpora.
COUNTERS = 1 << 20
#: Counters sent in one row.
SLICE = 1 << 12
#: Rows of a column that one block holds.
PART = 4_096
#: Bits of the filters that keep most unshared n-grams, and texts without any shared one, from being moved.
FILTER_BITS = 1 << 26
#: Parity bits of a set; a multiple of 64.
MARKS = 512
#: Bins that the smallest sets are counted in (a power of two).
LEAST_BINS = 64
#: Rows of a column up to which its rows are compared by size and place before anything else is done with them.
SHORT = 8
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


# --- sets ------------------------------------------------------------------------------------------------------------


def ngram_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # on bytes: A-Z and ASCII white space only
    if not tokens:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(digest, tokens), np.uint64, len(tokens))
    n = min(words, len(h))
    mixed = np.full(len(h) - n + 1, np.uint64(n))
    for k in range(n):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX[k % len(_MIX)] + h[k : len(h) - n + 1 + k]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * _MIX[1]
    return np.unique(mixed ^ (mixed >> np.uint64(29)))


def set_id(members: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(members.tobytes())).view(np.int64))


def marks_of(members: np.ndarray) -> np.ndarray:
    """For each of MARKS bits, whether an odd number of n-grams falls on it, packed into longs."""
    odd = np.bincount((members % np.uint64(MARKS)).astype(np.int64), minlength=MARKS) & 1
    return np.packbits(odd.astype(bool)).view("<i8")


def counts_of(members: np.ndarray) -> bytes:
    """How many n-grams fall on each of as many bins as the set has n-grams, rounded down to a power of two; one byte each, so that a
    set of any size is told from others as well as a small one. Fuller bins count as 255, which only brings two sets closer."""
    bins = max(LEAST_BINS, 1 << max(0, len(members).bit_length() - 1))
    found = np.bincount((members % np.uint64(bins)).astype(np.int64), minlength=bins)
    return np.minimum(found, 255).astype(np.uint8).tobytes()


def counts_differ(a: bytes, b: bytes) -> int:
    """By how much the counts of two sets differ: never more than their n-grams do. The finer ones are folded into the coarser bins."""
    x, y = (np.frombuffer(c, np.uint8).astype(np.int64) for c in (a, b))
    bins = min(len(x), len(y))
    return int(np.abs(x.reshape(-1, bins).sum(axis=0) - y.reshape(-1, bins).sum(axis=0)).sum())


def _scan(docs: DataFrame, words: int) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, hash of the text, sid, n of every document, the sketch)."""
    shift = np.uint64(64 - (COUNTERS.bit_length() - 1))
    names = ["doc_id", "th", "sid", "n", "slice", "counts"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, kind = np.zeros(COUNTERS, np.uint32), None
        for batch in batches:
            kind, sids, sizes = batch.column(0).type, [], []
            for text in batch.column(2):
                members = ngram_set(text.as_py(), words)
                counts[members >> shift] += np.uint32(1)
                sizes.append(len(members))
                sids.append(set_id(members) if len(members) else None)
            empty = [pa.nulls(len(sizes), pa.int32()), pa.nulls(len(sizes), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sids, pa.int64()), pa.array(sizes, pa.int64()), *empty], names=names)
        parts = [k for k in range(COUNTERS // SLICE) if counts[k * SLICE : (k + 1) * SLICE].any()]
        if parts:
            none = [pa.nulls(len(parts), t) for t in (kind, pa.int64(), pa.int64(), pa.int64())]
            own = [pa.array(parts, pa.int32()), pa.array([counts[k * SLICE : (k + 1) * SLICE].tobytes() for k in parts], pa.binary())]
            yield pa.RecordBatch.from_arrays(none + own, names=names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[k] = sums.get(k, 0) + np.frombuffer(c.as_buffer(), np.uint32).astype(np.uint64)
        whole = [np.minimum(s, np.uint64((1 << 32) - 1)).astype(np.uint32).tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(whole, pa.binary())], names=["slice", "counts"])

    source = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    kind = dict(docs.dtypes)["doc_id"]
    found = written(source.mapInArrow(scan, f"doc_id {kind}, th long, sid long, n long, slice int, counts binary"), "scan")
    sketch = np.zeros(COUNTERS, np.uint32)
    for row in found.where("slice IS NOT NULL").select("slice", "counts").repartition("slice").mapInArrow(add, "slice int, counts binary").collect():
        sketch[row["slice"] * SLICE : (row["slice"] + 1) * SLICE] = np.frombuffer(row["counts"], np.uint32)
    return found.where("slice IS NULL").select("doc_id", "th", "sid", "n"), sketch


def prefix_size(n: int, percent: int = PERCENT) -> int:
    """Of n n-grams in order, so many hold one of every partner's."""
    return n + percent * n // -100 + 1


def _prefixes(docs: DataFrame, sketch: np.ndarray, words: int, percent: int) -> DataFrame:
    """(sid, n, marks, prefix) of the distinct sets: their first n-grams, rare ones first."""
    shift = np.uint64(64 - (COUNTERS.bit_length() - 1))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sids, sizes, marks, heads = [], [], [], []
            for text in batch.column(0):
                members = ngram_set(text.as_py(), words)
                if len(members):
                    marks.append(marks_of(members))
                    order = np.argsort(sketch[members >> shift], kind="stable")  # equal counters: by hash
                    sids.append(set_id(members))
                    sizes.append(len(members))
                    heads.append(members[order[: prefix_size(len(members), percent)]].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(sizes, pa.int64()), _lists(marks), _lists(heads)], names=["sid", "n", "marks", "prefix"])

    found = docs.select("text").mapInArrow(cut, "sid long, n long, marks array<long>, prefix array<long>")
    return found.groupBy("sid").agg(*[F.first(c).alias(c) for c in ("n", "marks", "prefix")])


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))


def _bits_of(keys: DataFrame) -> np.ndarray:
    """A filter of FILTER_BITS bits with those of the keys (column k) set. Its size is bounded; the fuller it is, the more it lets
    through needlessly, so what it passes is always joined with the keys themselves."""
    bit = F.pmod("k", F.lit(FILTER_BITS))
    words = keys.groupBy((bit / 64).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(pmod(k, 64) AS int)))").alias("bits"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [c.to_numpy(zero_copy_only=False).astype("<i8").tobytes() for c in batch.columns]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in packed], names=["word", "bits"])

    out = np.zeros(FILTER_BITS // 64, np.uint64)
    for row in words.mapInArrow(pack, "word binary, bits binary").collect():
        out[np.frombuffer(row["word"], "<i8")] = np.frombuffer(row["bits"], "<i8").view(np.uint64)
    return out


def _passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys % FILTER_BITS
    return np.flatnonzero(bits[at // 64] >> (at % 64).astype(np.uint64) & np.uint64(1))


def may_link(g: np.ndarray, n: np.ndarray, pos: np.ndarray, percent: int) -> np.ndarray:
    """Which places (g, n, pos), in the order of g, have another one in their column whose row they can link with, if the column is the
    first that both share. Columns have SHORT places at most; the first and the last one may go on outside, so all of them stay."""
    fit = np.zeros(len(g), bool)
    for d in range(1, min(SHORT, len(g))):
        na, nb = n[:-d], n[d:]
        pair = (g[:-d] == g[d:]) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
        pair &= (100 + percent) * np.minimum(na - pos[:-d], nb - pos[d:]) >= percent * (na + nb)
        fit[:-d] |= pair
        fit[d:] |= pair
    return fit | (g == g[0]) | (g == g[-1])


def _columns(prefixes: DataFrame, percent: int) -> DataFrame:
    """(g, sid, n, marks, pos): the n-grams of prefixes that two rows have there, and these rows; few of all, so that most are left out
    by the filter where they are read. Most columns are short ones that rows share by chance: of these, rows stay only if size and
    place let them link with another. Longer ones keep all rows and are spread. Marks come last, as they are most of a row."""
    found = prefixes.select(F.explode("prefix").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    shared = written(found, "shared")
    bits, long = (_bits_of(shared.where(F.col("k") > k).select(F.col("g").alias("k"))) for k in (1, SHORT))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            pos = np.arange(len(g)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            hit = _passes(bits, g)
            sid, n = (batch.column(k).to_numpy(zero_copy_only=False)[row[hit]] for k in range(2))
            short = np.ones(len(hit), bool)
            short[_passes(long, g[hit])] = False
            yield pa.RecordBatch.from_arrays([pa.array(g[hit]), pa.array(sid), pa.array(n), pa.array(pos[hit]), pa.array(sid, mask=short)], names=["g", "sid", "n", "pos", "spread"])

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                g, n, pos = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2, 3))
                stay = may_link(g, n, pos, percent) | batch.column(4).is_valid().to_numpy(zero_copy_only=False)
                yield batch.select([0, 1, 2, 3]).filter(pa.array(stay))

    places = prefixes.select("sid", "n", "prefix").mapInArrow(cut, "g long, sid long, n long, pos long, spread long")
    places = places.repartition("g", "spread").sortWithinPartitions("g").mapInArrow(prune, "g long, sid long, n long, pos long")
    return places.join(prefixes.select("sid", "marks"), "sid").select("g", "sid", "n", "marks", "pos")


def _read_again(docs: DataFrame, wanted: DataFrame, words: int, counted: bool = False) -> DataFrame:
    """(sid, members), or (sid, counts), of the wanted sets (columns sid, th); other texts are neither moved nor cut again, but for what the
    filter lets through."""
    bits = _bits_of(wanted.select(F.col("th").alias("k")))
    name, kind = ("counts", "binary") if counted else ("members", "array<long>")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = _passes(bits, batch.column(0).to_numpy(zero_copy_only=False))
            sets = [ngram_set(batch.column(1)[k].as_py(), words) for k in hit.tolist()]
            sets = [s for s in sets if len(s)]
            own = pa.array([counts_of(s) for s in sets], pa.binary()) if counted else _lists([s.view(np.int64) for s in sets])
            yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in sets], pa.int64()), own], names=["sid", name])

    found = docs.select(F.xxhash64("text").alias("th"), "text").mapInArrow(cut, f"sid long, {name} {kind}")
    return found.join(wanted.select("sid"), "sid", "left_semi").groupBy("sid").agg(F.first(name).alias(name))


# --- products --------------------------------------------------------------------------------------------------------


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _reaches(overlap: Column, a: Column, b: Column, percent: int) -> Column:
    """The overlap that the sizes ask for: t / (1 + t) of their sum."""
    return (100 + percent) * overlap >= percent * (a + b)


def _marks_fit(a: str, b: str, na: Column, nb: Column, percent: int) -> Column:
    """Whether the overlap can reach the bound, going by the marks: it is at most half of both sizes less the marks that differ."""
    differ = sum((F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))) for k in range(MARKS // 64)), F.lit(0)).cast("long")
    return (100 + percent) * (na + nb - differ) >= 2 * percent * (na + nb)


def _places_fit(n: Column, pos: Column, n_b: Column, pos_b: Column, percent: int) -> Column:
    """Whether two rows can link if a column in these places is the first that they share."""
    return _reaches(F.least(n - pos, n_b - pos_b), n, n_b, percent)


def _with_both(pairs: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """Pairs (a, b, na, nb) with the column of both rows, under the names of the rows."""
    own = [rows.select(F.col("sid").alias(end), F.col(column).alias(f"{column}_{end}")) for end in "ab"]
    return pairs.join(own[1], "b").join(own[0], "a")


def _counts_fit(pairs: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b, na, nb, counts_a, counts_b) whose overlap can reach the bound, going by the counts. Marks tell only sets
    apart that are not much larger than they are; without this, long texts that share a column would all be moved whole."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = (batch.column(2).to_numpy(zero_copy_only=False) + batch.column(3).to_numpy(zero_copy_only=False)).astype(np.int64)
            differ = np.array([counts_differ(a.as_py(), b.as_py()) for a, b in zip(batch.column(4), batch.column(5))], np.int64)
            yield batch.select([0, 1, 2, 3]).filter(pa.array((100 + percent) * (both - differ) >= 2 * percent * both))

    return pairs.select("a", "b", "na", "nb", "counts_a", "counts_b").mapInArrow(cut, "a long, b long, na long, nb long")


def _linked(docs: DataFrame, pairs: DataFrame, named: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b, na, nb) whose whole overlap reaches the bound. ``named`` has a text's hash (th) for each sid."""

    def ends(pairs: DataFrame) -> DataFrame:
        either = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
        return written(named.join(either, "sid", "left_semi").select("sid", "th"), "ends")

    pairs = written(pairs, "pairs")
    counts = written(_read_again(docs, ends(pairs), words, counted=True), "counts")
    pairs = written(_counts_fit(_with_both(pairs, counts, "counts"), percent), "pairs")
    sets = written(_read_again(docs, ends(pairs), words), "sets")
    overlap = F.size(F.array_intersect("members_a", "members_b")).cast("long")
    return _with_both(pairs, sets, "members").where(_reaches(overlap, F.col("na"), F.col("nb"), percent)).select("a", "b")


def _first_product(columns: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb) of each row and two of the rows that stand for its columns: the earliest ones and some that a hash picks."""
    row = F.struct("sid", "n", "marks", "pos")
    heads = columns.groupBy("g").agg(F.min(F.struct("pos", "n", "sid", row.alias("row")))["row"].alias("e"), F.min(F.struct(F.xxhash64("g", "sid"), row.alias("row")))["row"].alias("r"))
    heads = heads.select("g", F.explode(F.array_distinct(F.array("e", "r"))).alias("h"))
    heads = heads.select("g", F.col("h.sid").alias("a"), F.col("h.n").alias("na"), F.col("h.marks").alias("marks_a"), F.col("h.pos").alias("pos_a"))
    n, na = F.col("n"), F.col("na")
    met = columns.join(heads, "g").where("sid <> a").where(_sizes_fit(n, na, percent) & _marks_fit("marks", "marks_a", n, na, percent))
    # of a row's partners, two are enough to hang a group together: by a hash, which the rows of a group agree on, and by place
    other = F.struct("a", "na")
    two = met.groupBy("sid", "n").agg(F.min(F.struct(F.xxhash64("a"), other.alias("o")))["o"].alias("x"), F.min(F.struct("pos_a", "na", "a", other.alias("o")))["o"].alias("y"))
    return two.select("sid", "n", F.explode(F.array_distinct(F.array("x", "y"))).alias("h")).select(F.col("h.a").alias("a"), F.col("sid").alias("b"), F.col("h.na").alias("na"), F.col("n").alias("nb"))


def _second_product(columns: DataFrame, component: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb) of rows in different components that may link."""
    labelled = columns.join(component, columns["sid"] == component["node"], "left").select("g", "sid", "n", "marks", "pos", F.coalesce("component", "sid").alias("c"))
    counted = labelled.groupBy("g", "c").agg(F.count(F.lit(1)).alias("k"))
    most = counted.groupBy("g").agg(F.sum("k").alias("rows"), F.max(F.struct("k", "c"))["c"].alias("most"), F.count(F.lit(1)).alias("groups")).where("groups > 1")
    rows = labelled.join(most, "g").withColumn("parts", F.ceil(F.col("rows") / PART).cast("int"))
    asked = rows.select("g", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int").alias("part"), *[F.col(c).alias(f"{c}_b") for c in ("sid", "n", "marks", "pos", "c")], "most")
    asking = rows.where("c <> most").select("g", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "sid", "n", "marks", "pos", "c")
    met = asking.join(asked, ["g", "part"]).where(
        (F.col("c") != F.col("c_b"))
        & ((F.col("c_b") == F.col("most")) | (F.col("sid") < F.col("sid_b")))  # each pair from one side
        & _sizes_fit(F.col("n"), F.col("n_b"), percent)
        & _places_fit(F.col("n"), F.col("pos"), F.col("n_b"), F.col("pos_b"), percent)
        & _marks_fit("marks", "marks_b", F.col("n"), F.col("n_b"), percent)
    )
    return met.select(F.col("sid").alias("a"), F.col("sid_b").alias("b"), F.col("n").alias("na"), F.col("n_b").alias("nb")).distinct()


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id that links reach, of every document."""
    rows, sketch = _scan(docs, words)
    prefixes = written(_prefixes(docs, sketch, words, percent), "prefixes")
    columns = written(_columns(prefixes, percent), "columns")
    named = written(rows.where("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("first"), F.min("th").alias("th")), "named")
    found = components(_linked(docs, _first_product(columns, percent), named, words, percent))
    more = written(_linked(docs, _second_product(columns, found, percent), named, words, percent), "links")
    if not more.isEmpty():
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    label = named.join(found, named["sid"] == found["node"], "left").select("sid", "first", F.coalesce("component", "sid").alias("c"))
    least = label.groupBy("c").agg(F.min("first").alias("component_id"))
    of_set = label.join(least, "c").select("sid", "component_id")
    whole = rows.where("sid IS NOT NULL").join(of_set, "sid").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return whole.unionByName(rows.where("sid IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
