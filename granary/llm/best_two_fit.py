"""Packs tokenised documents into sequences of a fixed length by best-two-fit.

Tokens are counted where the documents lie. Packing needs nothing but how many pieces there are of each length, which
is at most ``capacity`` numbers however large the corpus is: bins are planned on that histogram as patterns (a list of
lengths, and how many bins follow it), and then every piece takes the place that its rank among the pieces of its
length gives it. Ranks are running counts over small blocks of pieces, so no length has to fit one task.

Results in special cases: a NULL or empty text is its end mark alone; repeated rows are packed each; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import written

CAPACITY = 2048
END_ID = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class BatchTokenizer:
    """The tokenizer's ids of many texts at once: every distinct blank-separated part is encoded once a batch.

    Right for tokenizers that drop blanks and never join across them. A part made of Latin letters and marks behind
    them is two words to the tokenizer: the letters, which need no more than lower case and are kept in a bounded
    cache, and the run of marks. Every other part goes through the whole tokenizer.
    """

    STEMS = 400_000
    SHAPE = r"^(?P<stem>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[!#$%&*+,\-./:;=?@^_|~()\[\]{}\"]*)$"

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.words = Tokenizer.from_file(path)  # for lower-case letters: blanks part them, and nothing is to be normalised
        self.words.normalizer = None
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.array([t.endswith("</w>") for t, _ in sorted(self.whole.get_vocab().items(), key=lambda x: x[1])], bool)
        self.stems: dict[str, bytes] = {}

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where those of each text begin (and the last end); NULL has none."""
        parts = pc.split_pattern(pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), "\n", " "), " ")
        coded = parts.flatten().dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False)
        ids = self._parts(coded.dictionary)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        starts, flat = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(ids), "<u4")
        own = sizes[which]
        ends = np.concatenate([[0], np.cumsum(own)])
        out = flat[np.repeat(starts[which] - ends[:-1], own) + np.arange(ends[-1])]
        return out, ends[parts.offsets.to_numpy()]

    def _parts(self, parts: pa.Array) -> list[bytes]:
        shape = pc.extract_regex(parts, self.SHAPE)
        plain = shape.is_valid().to_numpy(zero_copy_only=False)
        stems = pc.utf8_lower(pc.struct_field(shape, "stem")).dictionary_encode()
        tails = pc.struct_field(shape, "tail").dictionary_encode()
        stem_ids, tail_ids = self._stems(stems.dictionary.to_pylist()), self._others(tails.dictionary.to_pylist())
        at = np.flatnonzero(plain)
        s, t = (x.indices.take(at).to_pylist() for x in (stems, tails))
        out: list[bytes] = [b""] * len(parts)
        for k, a, b in zip(at.tolist(), s, t):
            out[k] = stem_ids[a] + tail_ids[b]
        rest = np.flatnonzero(~plain)
        for k, found in zip(rest.tolist(), self._others(parts.take(rest).to_pylist())):
            out[k] = found
        return out

    def _stems(self, stems: list[str]) -> list[bytes]:
        known = self.stems
        if len(known) > self.STEMS:  # what came first is what comes most often
            known = self.stems = dict(islice(known.items(), self.STEMS // 4))
        new = [s for s in stems if s not in known]
        if new:
            ids = np.array(self.words.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(new):
                raise ValueError("this tokenizer doesn't end each word with an end-of-word token")
            data, at = ids.tobytes(), 0
            for stem, stop in zip(new, (stops * 4).tolist()):
                known[stem] = data[at:stop]
                at = stop
        return [known[s] for s in stems]

    def _others(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.whole.encode_batch_fast(texts, add_special_tokens=False)] if texts else []


#: Code units of text that one round of a task encodes together, unless one text alone has more.
ROUND_BYTES = 8_000_000


def _tokenizer(path: str) -> BatchTokenizer:
    """One a worker process: functions travel by value, so it is kept with a module that all tasks of a worker share."""
    import tokenizers

    kept = vars(tokenizers).setdefault("_batch_tokenizers", {})
    if path not in kept:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        kept[path] = BatchTokenizer(path)
    return kept[path]


def rounds(batch: pa.RecordBatch, bytes_: int = ROUND_BYTES) -> Iterator[pa.RecordBatch]:
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + bytes_, side="right"))
        to = max(to, at + 1)
        yield batch.slice(at, to - at)
        at = to


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([END_ID], "<u4")
        for batch in batches:
            for part in rounds(batch):
                ids, ends = _tokenizer(tokenizer).encode(part.column("text"))
                rows, piece, starts, lengths, crcs, kept = [], [], [], [], [], []
                for k, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
                    whole = np.concatenate([ids[a:b], end])
                    for n, start in enumerate(range(0, len(whole), capacity)):
                        own = whole[start : start + capacity]
                        rows.append(k)
                        piece.append(n)
                        starts.append(start)
                        lengths.append(len(own))
                        crcs.append(zlib.crc32(own.tobytes()))
                        if with_ids:
                            kept.append(own.astype("int64"))
                columns = {"doc_id": part.column("doc_id").take(pa.array(rows, pa.int64())).cast(pa.int64()), "piece": pa.array(piece, pa.int32())}
                columns |= {n: pa.array(v, pa.int64()) for n, v in (("start", starts), ("length", lengths), ("ids_crc32", crcs))}
                if with_ids:
                    columns["ids"] = pa.array(kept, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(columns)

    return docs.select("doc_id", "text").mapInArrow(pieces, PIECES + ", ids array<long>" * with_ids)


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Bins as (lengths in order, number of such bins) for so many pieces of each length.

    A bin is filled greedily with the longest pieces that fit; then its shortest piece gives way to the two pieces left
    over that fill the widened gap best, if they fill it better. Bins that come out alike are made at once.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens can't be packed into {capacity}")
        left[length] += n
    plan: list[tuple[tuple[int, ...], int]] = []
    while left.any():
        bin_, gap, rest = [], capacity, left.copy()
        while gap:
            fitting = np.flatnonzero(rest[1 : gap + 1])
            if not len(fitting):
                break
            longest = int(fitting[-1]) + 1
            bin_.append(longest)
            rest[longest] -= 1
            gap -= longest
        if gap:
            smallest = bin_[-1]
            pair = best_pair(rest, gap + smallest)
            if pair and sum(pair) > smallest:
                bin_[-1:] = pair
        use = np.bincount(bin_, minlength=capacity + 1)
        times = int((left[use > 0] // use[use > 0]).min())
        left -= use * times
        plan.append((tuple(bin_), times))
    return plan


def best_pair(rest: np.ndarray, room: int) -> list[int] | None:
    """The two lengths left over whose sum comes closest to ``room`` from below; the longer first."""
    have = np.flatnonzero(rest[: room + 1])
    have = have[have > 0]
    if not len(have):
        return None
    at = np.searchsorted(have, room - have, side="right") - 1  # for each, the longest partner
    alone = (at >= 0) & (have[at] == have) & (rest[have] < 2)
    at = at - alone
    sums = np.where(at >= 0, have + have[at], -1)
    best = int(np.argmax(sums))
    return sorted((int(have[best]), int(have[at[best]])), reverse=True) if sums[best] > 0 else None


def places(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, list[int]]]:
    """(length, first rank, rank behind the last, first bin, uses in a bin, their offsets)."""
    taken: dict[int, int] = {}
    out, first_bin = [], 0
    for bin_, times in plan:
        offsets: dict[int, list[int]] = {}
        at = 0
        for length in bin_:
            offsets.setdefault(length, []).append(at)
            at += length
        for length, found in offsets.items():
            rank = taken.get(length, 0)
            taken[length] = rank + times * len(found)
            out.append((length, rank, taken[length], first_bin, len(found), found))
        first_bin += times
    return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    pieces = written(cut_pieces(docs, tokenizer, capacity), "pieces")
    counts = {int(r["length"]): r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = places(plan_bins(counts, capacity))
    # a block holds a small share of the pieces of one length
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = max(64, sum(counts.values()) // (8 * parts))
    blocks = spark.createDataFrame([(n, -(-c // size)) for n, c in sorted(counts.items())], "length long, blocks long")
    at = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.col("blocks"))
    dealt = pieces.join(F.broadcast(blocks), "length").withColumn("block", at).drop("blocks")  # at most `capacity` rows
    before = dealt.groupBy("length", "block").agg(F.count("*").alias("n"))
    running = "sum(n) OVER (PARTITION BY length ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    before = before.select(F.col("length").alias("_l"), F.col("block").alias("_b"), F.expr(f"coalesce({running}, 0)").alias("base"))
    rank = F.expr("row_number() OVER (PARTITION BY length, block ORDER BY doc_id, piece, ids_crc32) - 1")
    ranked = dealt.withColumn("_rank", rank).join(before, (F.col("length") == F.col("_l")) & (F.col("block") == F.col("_b")))
    ranked = ranked.withColumn("rank", F.col("_rank") + F.col("base")).drop("_l", "_b", "_rank", "base", "block")
    # the places of a length, in order of rank; their number depends on the lengths there are, not on the corpus
    table = spark.createDataFrame(plan, "length long, first long, last long, bin long, uses long, offsets array<long>")
    table = table.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first", "last", "bin", "uses", "offsets"))).alias("places"))
    placed = ranked.join(F.broadcast(table), "length").withColumn("place", F.expr("filter(places, p -> p.first <= rank and rank < p.last)[0]"))
    step = F.col("rank") - F.col("place.first")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("place.bin") + F.floor(step / F.col("place.uses"))).alias("sequence_id"),
        F.get("place.offsets", F.pmod(step, F.col("place.uses")).cast("int")).alias("offset"),
    )
