"""Text normalisation and string similarity as Spark expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space that is not already a single plain space: Unicode blanks plus the four ASCII
# separators Python also strips. Single spaces do not match, so plain text is not rebuilt.
BLANK = r"(?U) [\s\x1c-\x1f]+|[[\s\x1c-\x1f]&&[^ ]][\s\x1c-\x1f]*"
# Anything beyond printable ASCII, or a doubled space.
NOT_PLAIN = r"[^\x20-\x7e]|  "
HANGUL = range(0xAC00, 0xD7A4)
# A Hangul syllable is composed of one of 19 leading, 21 middle and up to 27 closing letters.
LEADING, MIDDLE, CLOSING = ("".join(chr(first + k) for k in range(n)) for first, n in ((0x1100, 19), (0x1161, 21), (0x11A8, 27)))
# Planes with characters that fold to others.
FOLDED_PLANES = (range(0xA0, 0xD800), range(0xE000, 0xFFFE), range(0x10000, 0x20000), range(0x2F800, 0x2FA20), range(0xE0000, 0xE0200))
NOT_ASCII = r"[^\x00-\x7f]"


def _fold_char(ch: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str, dict[str, str]]:
    """Compatibility folding, derived from the Unicode database; Hangul syllables follow a rule instead.

    Returns translate() arguments for the one-to-one part (marks, which fold to
    nothing, come last so that translate() deletes them) and a dict of the
    characters that expand to several.
    """
    single, marks, multi = [], [], {}
    for code in (c for plane in FOLDED_PLANES for c in plane if c not in HANGUL):
        ch = chr(code)
        base = _fold_char(ch)
        if base == ch:
            continue
        if not base:
            marks.append(ch)
        elif len(base) == 1:
            single.append((ch, base))
        else:
            multi[ch] = base
    source = "".join(s for s, _ in single) + "".join(marks)
    return source, "".join(b for _, b in single), multi


@lru_cache(maxsize=1)
def _unfolded_class() -> str:
    """Regex for a character beyond ASCII and the Latin letters that have no folding (such
    as sharp s), written as ranges."""
    keep = [c for c in range(0xA1, 0x250) if _fold_char(chr(c)) == chr(c)]
    ranges: list[list[int]] = []
    for c in keep:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    listed = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges)
    return f"[^\\x00-\\x7f{listed}]"


def strip_marks(col: Column) -> Column:
    """Accents and compatibility forms removed."""
    source, target, multi = _folding()
    single = F.translate(col, source, target)
    listing = "\u0001".join(f"{k}\u0002{v}" for k, v in multi.items())
    pairs = F.str_to_map(F.lit(listing), F.lit("\u0001"), F.lit("\u0002"))
    # `when` evaluates lazily: only rows that still hold such a character pay for the walk,
    # and only rows that are still not plain ASCII pay for looking.
    hangul = f"[\\x{{{HANGUL.start:x}}}-\\x{{{HANGUL.stop - 1:x}}}]"
    more = (F.length(F.translate(single, "".join(multi), "")) != F.length(single)) | single.rlike(hangul)
    rare = single.rlike(_unfolded_class()) & more
    letters = F.transform(F.split(single, ""), lambda c: F.coalesce(F.try_element_at(pairs, c), F.when(c.rlike(hangul), _jamo(c)), c))
    return F.when(rare, F.array_join(letters, "")).otherwise(single)


def _jamo(syllable: Column) -> Column:
    """The letters of one Hangul syllable, which are numbered in the order of the alphabet."""
    at = F.ascii(syllable) - HANGUL.start
    per_middle, per_leading = len(CLOSING) + 1, len(MIDDLE) * (len(CLOSING) + 1)
    pick = lambda letters, k: F.substring(F.lit(letters), k, F.lit(1))
    closing = F.when(at % per_middle > 0, pick(CLOSING, at % per_middle)).otherwise("")
    leading = F.floor(at / per_leading).cast("int") + 1
    middle = F.floor((at % per_leading) / per_middle).cast("int") + 1
    return F.concat(pick(LEADING, leading), pick(MIDDLE, middle), closing)


def sanitize_text(col: Column) -> Column:
    """Accent-free, single-spaced, trimmed, upper-case; NULL becomes the empty string.

    Plain rows, the bulk of most columns, cost one scan of the text.
    """
    folded = F.when(col.rlike(NOT_ASCII), strip_marks(col)).otherwise(col)
    spaced = F.regexp_replace(folded, BLANK, " ")
    tidy = F.when(col.rlike(NOT_PLAIN), spaced).otherwise(col)
    return F.coalesce(F.upper(F.trim(tidy)), F.lit(""))


def zero_fill(col: Column, width: int) -> Column:
    """Left-pad with zeros without cutting longer codes."""
    code = F.coalesce(F.trim(col.cast("string")), F.lit(""))
    return F.when(F.length(code) < width, F.lpad(code, width, "0")).otherwise(code)


def label_from_name(name: str) -> Column:
    """Upper-case label of a column name: underscores become spaces."""
    return sanitize_text(F.lit(name.replace("_", " ")))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / longest)


def jaro_winkler(a: Column, b: Column, prefix_weight: float = 0.1) -> Column:
    """Jaro-Winkler similarity; the prefix bonus applies at every Jaro level.

    A fold over the letters of ``a`` consumes the first equal letter of ``b``
    inside the search window by overwriting it with U+0000.
    """
    len_a, len_b = F.length(a), F.length(b)
    reach = F.floor(F.greatest(len_a, len_b) / 2).cast("int") - 1
    used = F.lit("\u0000")

    def consume(state, i):
        ch = F.substring(a, i, F.lit(1))
        start = F.greatest(F.lit(1), i - reach)
        width = F.greatest(F.least(i + reach, len_b) - start + 1, F.lit(0))
        hit = F.instr(F.substring(state["rest"], start, width), ch)
        at = start + hit - 1
        found = (hit > 0) & (width > 0)
        return F.struct(
            F.when(found, F.overlay(state["rest"], used, at, F.lit(1))).otherwise(state["rest"]).alias("rest"),
            F.when(found, F.concat(state["seen"], ch)).otherwise(state["seen"]).alias("seen"),
        )

    start_state = F.struct(b.alias("rest"), F.lit("").alias("seen"))
    steps = F.when(len_a > 0, F.sequence(F.lit(1), len_a)).otherwise(F.array().cast("array<int>"))

    def score(pair):
        seen, other = pair["seen"], pair["other"]
        matches = F.length(seen)
        swaps = F.aggregate(
            F.sequence(F.lit(1), matches),
            F.lit(0),
            lambda n, k: n + F.when(F.substring(seen, k, F.lit(1)) != F.substring(other, k, F.lit(1)), 1).otherwise(0),
        )
        jaro = (matches / len_a + matches / len_b + (matches - swaps / 2.0) / matches) / 3.0
        return F.when(matches == 0, F.lit(0.0)).otherwise(jaro)

    def pair_up(end):
        taken = F.filter(F.sequence(F.lit(1), len_b), lambda j: F.substring(end["rest"], j, F.lit(1)) == used)
        other = F.array_join(F.transform(taken, lambda j: F.substring(b, j, F.lit(1))), "")
        return F.struct(end["seen"].alias("seen"), other.alias("other"))

    jaro = let(let(F.aggregate(steps, start_state, consume), pair_up), score)
    shorter = F.least(len_a, len_b)
    prefix = F.lit(0)
    for i in (4, 3, 2, 1):
        same = (shorter >= i) & (F.substring(a, i, 1) == F.substring(b, i, 1))
        prefix = F.when(same, 1 + prefix).otherwise(F.lit(0))
    boosted = let(jaro, lambda j: F.when(j == 0, F.lit(0.0)).otherwise(j + prefix * F.lit(prefix_weight) * (1.0 - j)))
    return (
        F.when(a == b, F.lit(1.0))
        .when((len_a == 0) | (len_b == 0), F.lit(0.0))
        .otherwise(boosted)
    )


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a lambda variable."""
    return F.element_at(F.transform(F.array(value), body), 1)
