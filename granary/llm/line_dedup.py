"""Removes lines that an earlier line of the corpus repeats, word for word or up to one edited word.

Lines are compared as lower-case words. The edit bound is one word inserted, deleted or replaced, for lines of
``LEAST_WORDS`` words or more; shorter ones must be equal. A line goes if any line before it, in the order of doc_id
and line number, lies within the bound, whether or not that line stays itself.

1. Equal lines are one class, kept by its earliest line (partial minima, so a line of any frequency is cheap).
2. Two lines within the bound share their first or their second half; classes that share neither with another class
   can have no neighbour and go no further. This only saves work: it loses no pair.
3. The others emit the deletion neighbourhood as hashed keys: the line without each of its words. A key tells the
   place for replacements, and which line is the shorter one otherwise, so lines that meet in a key are one edit apart.
   The earliest of them is all the others need: no pairs are emitted, whatever the size of the group.
4. The earliest line of each key is compared word by word, and what is left of each document is put together.

Results in special cases: a NULL text stays NULL, and lines without a word always stay; rows with the same doc_id and
text are one document and keep the same lines; rows with the same doc_id and other text are ordered by a hash of the
text; a NULL doc_id comes first; an empty table gives no rows; other columns are carried along, whatever their names,
but one named like a result (n_lines, n_kept) is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.nulls import stage
from granary.llm.common import named_back, set_apart, words_of, written

#: Lines of fewer words have no near copies, only equal ones: one word would be more than a tenth of them.
LEAST_WORDS = 10
BLOCK = 256
PLACE = ["_ld_doc", "_ld_text", "_ld_line"]
#: What a line is to a key: one whose word is replaced there, the longer or the shorter line of a pair.
REPLACED, LONGER, SHORTER = 0, 1, 2


def lines_of(docs: DataFrame) -> DataFrame:
    """One row per line that has a word: its place, its words joined by single spaces."""
    text = F.col("text")
    lines = docs.select(F.col("doc_id").cast("long").alias("_ld_doc"), F.xxhash64(text).alias("_ld_text"), F.posexplode(F.split(text, "\n")).alias("_ld_line", "line"))
    words = stage(lines, {"norm": F.array_join(words_of(F.lower("line")), " ")})
    return words.where(F.col("norm") != "").select(*PLACE, "norm")


def classes_of(lines: DataFrame) -> DataFrame:
    """One row per distinct line: two hashes, the place of its earliest line, and the hashes of its halves."""
    rows = stage(lines, {"words": F.split("norm", " ")})
    rows = stage(rows, {"n": F.size("words")})
    half, less = F.floor(F.col("n") / 2).cast("int"), F.floor((F.col("n") - 1) / 2).cast("int")
    part = lambda side, first, size: F.xxhash64(F.lit(side), F.slice("words", first, size))
    # prefixes and suffixes of a line as the one of equal or shorter length and as the longer one of a pair
    keys = F.array_distinct(F.array(part("p", F.lit(1), half), part("p", F.lit(1), less), part("s", half + 1, F.col("n") - half), part("s", F.col("n") - (F.col("n") - 1 - less) + 1, F.col("n") - 1 - less)))
    halves = F.when(F.col("n") >= LEAST_WORDS, keys).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select(*PLACE, F.xxhash64("norm").alias("h1"), F.xxhash64(F.lit(1), "norm").alias("h2"), halves.alias("halves"))
    return rows.groupBy("h1", "h2").agg(F.min(F.struct(*PLACE, "halves")).alias("first")).select("h1", "h2", *[F.col(f"first.{c}") for c in [*PLACE, "halves"]])


def near_classes(classes: DataFrame) -> DataFrame:
    """Classes that share a half with another one."""
    keys = classes.select(*PLACE, F.explode("halves").alias("half"))
    shared = keys.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half")
    return keys.join(shared, "half", "left_semi").select(*PLACE).distinct()


def with_keys(lines: DataFrame) -> DataFrame:
    """One row per key of the deletion neighbourhood of ``lines`` (id, words): id, key, and the line's role in it.

    A sequence is hashed as the exclusive-or of its words hashed with their places, so taking a word out, with the
    words behind it moving up, takes a few operations instead of hashing the line anew.
    """
    at = lambda w, i: F.xxhash64(w, i)
    xor = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(x))
    rows = stage(lines, {"n": F.size("words"), "here": F.transform("words", lambda w, i: at(w, i)), "up": F.transform("words", lambda w, i: at(w, i - 1))})
    rows = stage(rows, {"whole": xor(F.col("here")), "moved": xor(F.col("up")), "turn": F.zip_with("here", "up", lambda a, b: a.bitwiseXOR(b))})
    grow = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1).bitwiseXOR(x)))
    zero = F.array(F.lit(0).cast("long"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice("turn", b * BLOCK + 1, BLOCK), zero, grow))
    rows = stage(rows, {"blocks": blocks})
    rows = stage(rows, {"offsets": F.aggregate("blocks", zero, lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1).bitwiseXOR(F.element_at(b, -1)))))})
    before = lambda i: F.get(F.get("blocks", F.floor(i / BLOCK).cast("int")), i % BLOCK).bitwiseXOR(F.get("offsets", F.floor(i / BLOCK).cast("int")))
    # the line without word i, which others replace there; and the shorter line that this leaves
    replaced = F.transform("here", lambda h, i: F.xxhash64(F.lit("r"), F.col("n"), i, F.col("whole").bitwiseXOR(h)))
    dropped = F.transform("up", lambda u, i: F.xxhash64(F.lit("d"), F.col("n") - 1, before(i).bitwiseXOR(F.col("moved")).bitwiseXOR(u)))
    keys = F.concat(
        F.transform(replaced, lambda k: F.struct(k.alias("key"), F.lit(REPLACED).alias("role"))),
        F.transform(F.array_distinct(dropped), lambda k: F.struct(k.alias("key"), F.lit(LONGER).alias("role"))),
        F.array(F.struct(F.xxhash64(F.lit("d"), F.col("n"), "whole").alias("key"), F.lit(SHORTER).alias("role"))),
    )
    return rows.select("id", F.inline(keys))


def within_bound(a: Column, b: Column) -> Column:
    """Whether two word arrays are at most one insertion, deletion or replacement apart."""
    n, m = F.size(a), F.size(b)
    replaced = F.size(F.filter(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), lambda d: d)) <= 1
    long, short = F.when(n > m, a).otherwise(b), F.when(n > m, b).otherwise(a)
    split = F.array_position(F.zip_with(long, short, lambda x, y: ~x.eqNullSafe(y)), F.lit(True)).cast("int")
    rest = F.slice(long, split + 1, F.size(long)).eqNullSafe(F.slice(short, split, F.size(long)))
    return F.when(n == m, replaced).when(F.abs(n - m) == 1, rest).otherwise(F.lit(False))


def near_copies(lines: DataFrame) -> DataFrame:
    """Places of the given distinct lines (place, words, and an id in the order of places) that have an earlier one within the bound."""
    keys = with_keys(lines.select("id", "words"))
    role, first = F.col("role"), lambda which: F.min(F.when(F.col("role") == which, F.col("id")))
    # replacements: the earliest of all; otherwise the earliest longer line for the shorter one, and the other way round
    firsts = keys.groupBy("key").agg(F.min("id").alias("any"), first(SHORTER).alias("shorter"), first(LONGER).alias("longer"), F.count("*").alias("n"))
    firsts = firsts.where("n > 1").drop("n")
    found = F.when(role == REPLACED, F.col("any")).when(role == SHORTER, F.col("longer")).otherwise(F.col("shorter"))
    pairs = keys.join(firsts, "key").select("id", found.alias("other")).where(F.col("other") < F.col("id")).distinct()
    theirs = lines.select(F.col("id").alias("other"), F.col("words").alias("b"))
    both = pairs.join(lines.withColumnRenamed("words", "a"), "id").join(theirs, "other")
    return both.where(within_bound(F.col("a"), F.col("b"))).select(*PLACE).distinct()


def same_document(left: str, right: str) -> Column:
    """NULL texts have no lines, so only the ids can be NULL."""
    return F.col(f"{left}._ld_doc").eqNullSafe(F.col(f"{right}._ld_doc")) & (F.col(f"{left}._ld_text") == F.col(f"{right}._ld_text"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with text reduced to the lines that stay, and n_lines, n_kept: lines that have a word, before and after."""
    docs, names = set_apart(docs, ["n_lines", "n_kept"])
    classes = written(classes_of(lines_of(docs)), "line-classes")
    keyed = docs.select("*", F.col("doc_id").cast("long").alias("_ld_doc"), F.xxhash64("text").alias("_ld_text"))
    # the words of the lines that may have a near copy, fetched by document
    asked = near_classes(classes).groupBy("_ld_doc", "_ld_text").agg(F.collect_set("_ld_line").alias("_ld_asked"))
    met = keyed.select("_ld_doc", "_ld_text", "text").alias("d").join(asked.alias("a"), same_document("a", "d"))
    met = stage(met.select("d._ld_doc", "d._ld_text", "d.text", "a._ld_asked"), {"lines": F.split("text", "\n")})
    line = F.transform("_ld_asked", lambda i: F.struct(i.alias("_ld_line"), F.get("lines", i).alias("line")))
    met = met.select("_ld_doc", "_ld_text", F.inline(line))
    words = met.select(*PLACE, words_of(F.lower("line")).alias("words")).dropDuplicates(PLACE)
    words = words.orderBy(*PLACE).withColumn("id", F.monotonically_increasing_id())  # ids in the order of places
    gone = near_copies(written(words, "near-lines"))
    same_line = same_document("c", "g") & (F.col("c._ld_line") == F.col("g._ld_line"))
    left = classes.alias("c").join(gone.alias("g"), same_line, "left_anti")
    kept = left.groupBy("_ld_doc", "_ld_text").agg(F.collect_list("_ld_line").alias("_ld_keep"))
    rows = keyed.alias("d").join(kept.alias("k"), same_document("k", "d"), "left")
    rows = rows.select(*[F.col(f"d.`{x}`") for x in docs.columns], F.coalesce("k._ld_keep", F.array().cast("array<int>")).alias("_ld_keep"))
    rows = stage(rows, {"_ld_lines": F.split("text", "\n")})
    blank = F.filter(F.transform("_ld_lines", lambda x, i: F.when(F.size(words_of(x)) == 0, i)), lambda i: i.isNotNull())
    rows = stage(rows, {"_ld_blank": blank})
    stays = F.transform(F.sort_array(F.concat("_ld_keep", "_ld_blank")), lambda i: F.get("_ld_lines", i))
    others = [F.col(f"`{x}`") for x in docs.columns if x != "text"]
    n_lines = F.coalesce(F.size("_ld_lines") - F.size("_ld_blank"), F.lit(0))
    out = rows.select(
        *others, F.array_join(stays, "\n").alias("text"), F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"), F.size("_ld_keep").cast("long").alias("n_kept")
    )
    return named_back(out, names)
