"""Fuzzy matching of raw names to a master catalogue without pairing everything.

score = 0.6 * Jaro-Winkler + 0.4 * Levenshtein similarity. With Jaro-Winkler at most
0.8 + 0.2 r (r = shorter/longer length), a score of at least t needs a Levenshtein
similarity of at least (t - 0.48 - 0.12 r) / 0.4, that is at most
d = floor(longer * (1 - that)) edits. A string within d edits of another keeps at least
one of any d + 1 disjoint pieces of it unchanged, shifted by at most d places. So the
catalogue names are cut into pieces, raw names offer their substrings at the possible
places, and an equi-join on (length pair, piece number, text) finds every acceptable pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.text import jaro_winkler, levenshtein_similarity, sanitize_text, zero_fill

# Weights, department penalty and default threshold of the score.
W_JW, W_LEV = 0.6, 0.4
DEPARTMENT_PENALTY = 0.8
THRESHOLD = 0.85
LOWEST_LENGTH_BOUND = 0.55
# Keys over which the names of one letter are spread.
LETTER_SALTS = 16
EPS = 1e-9


def golden_catalogue(df: DataFrame, order: str) -> DataFrame:
    """Cleaned catalogue, last row per code wins, first place of a code is kept as ``seq``."""
    clean = df.select(
        zero_fill(F.col("cod_municipio"), 5).alias("cod_municipio"),
        sanitize_text(F.col("nombre_municipio")).alias("nombre_municipio"),
        zero_fill(F.col("cod_departamento"), 2).alias("cod_departamento"),
        sanitize_text(F.col("nombre_departamento")).alias("nombre_departamento"),
        F.col(order).alias("__at"),
    ).filter(F.col("nombre_municipio") != "")
    names = ["nombre_municipio", "cod_departamento", "nombre_departamento"]
    return clean.groupBy("cod_municipio").agg(
        *[F.max_by(n, F.struct("__at", *names)).alias(n) for n in names], F.min("__at").alias("seq")
    )


def match_score(a: Column, b: Column) -> Column:
    return W_JW * jaro_winkler(a, b) + W_LEV * levenshtein_similarity(a, b)


def _allowed_edits(len_a: Column, len_b: Column, threshold: float) -> Column:
    """Most edits an acceptable pair can have; negative when the lengths rule it out."""
    longer, shorter = F.greatest(len_a, len_b), F.least(len_a, len_b)
    ratio = shorter / longer
    # Both Jaro-Winkler <= 1 and <= 0.8 + 0.2 r hold; the second is the tighter one.
    needed = (F.lit(threshold) - W_JW * (0.8 + 0.2 * ratio)) / W_LEV
    return F.floor(longer * (1.0 - F.greatest(needed, F.lit(0.0))) + F.lit(1e-6)).cast("int")


def _shortest(longer: Column, threshold: float) -> Column:
    floor_ratio = (threshold - 0.48) / 0.52
    return F.greatest(F.lit(1), F.ceil(longer * F.lit(floor_ratio) - F.lit(1e-6)).cast("int"))


def _longest(shorter: Column, threshold: float) -> Column:
    floor_ratio = (threshold - 0.48) / 0.52
    return F.floor(shorter / F.lit(floor_ratio) + F.lit(1e-6)).cast("int")


def _letters_by_rarity(names: DataFrame, name: str, frequency: DataFrame) -> DataFrame:
    """(name, letters): its distinct letters that the catalogue has, the rarest first."""
    each = names.select(name, F.explode(F.array_distinct(F.split(name, ""))).alias("letter")).join(frequency, "letter")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("names", "letter"))), lambda s: s["letter"])
    return each.groupBy(name).agg(ordered.alias("letters"))


def best_score_of(overlap: Column, len_a: Column, len_b: Column) -> Column:
    """The highest score of two names of these lengths that have ``overlap`` letters in common, repeats included."""
    jaro = (overlap / len_a + overlap / len_b + 1.0) / 3.0
    head = F.least(overlap, F.lit(4)) * 0.1
    return W_JW * (jaro + head * (1.0 - jaro)) + W_LEV * overlap / F.greatest(len_a, len_b)


def pairs_by_rarest_letter(raw: DataFrame, golden: DataFrame, threshold: float, salts: int = LETTER_SALTS) -> DataFrame:
    """Pairs (name, nombre) that have a letter in common, each once, if their letters and lengths allow for the threshold.

    Names without a common letter score 0. A pair meets at the rarest letter that both have and nowhere else, so nothing has to
    be made distinct, and letters that nearly every name has join only names with nothing rarer in common. Rows of a letter
    are spread over ``salts`` keys.
    """
    frequency = (
        golden.select(F.explode(F.array_distinct(F.split("nombre", ""))).alias("letter")).where("letter <> ''").groupBy("letter").agg(F.count(F.lit(1)).alias("names"))
    )
    asked = _letters_by_rarity(raw.select("name"), "name", frequency).select(
        "name", F.col("letters").alias("own"), F.explode("letters").alias("letter"), F.pmod(F.xxhash64("name"), F.lit(salts)).alias("salt")
    )
    known = _letters_by_rarity(golden.select("nombre"), "nombre", frequency).select("nombre", "letters", F.explode("letters").alias("letter"))
    known = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    both = F.array_intersect("own", "letters")
    met = asked.join(known, ["letter", "salt"]).where(F.element_at(both, 1) == F.col("letter"))
    times = lambda text, letter: F.length(text) - F.length(F.replace(F.col(text), letter, F.lit("")))
    overlap = F.aggregate(both, F.lit(0), lambda n, x: n + F.least(times("name", x), times("nombre", x)))
    return met.where(best_score_of(overlap, F.length("name"), F.length("nombre")) >= threshold - EPS).select("name", "nombre")


def candidate_pairs(raw: DataFrame, golden: DataFrame, threshold: float) -> DataFrame:
    """Distinct (name, nombre) pairs that may reach the threshold: no acceptable pair is lost.

    Below ``LOWEST_LENGTH_BOUND`` lengths say too little, and names meet by letters, see ``pairs_by_rarest_letter``.
    """
    if threshold <= 0:
        raise ValueError("a threshold must be above 0")
    if threshold < LOWEST_LENGTH_BOUND:
        return pairs_by_rarest_letter(raw, golden, threshold)
    r_len, g_len = F.length("name"), F.length("nombre")
    other = F.sequence(_shortest(g_len, threshold), _longest(g_len, threshold))
    pieces = (
        golden.select("nombre", g_len.alias("gl"), F.explode(other).alias("rl"))
        .withColumn("edits", _allowed_edits(F.col("rl"), F.col("gl"), threshold))
        .filter((F.col("edits") >= 0) & (F.abs(F.col("rl") - F.col("gl")) <= F.col("edits")))
        .withColumn("cuts", F.col("edits") + 1)
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("edits"))))
        .withColumn("from", F.floor(F.col("piece") * F.col("gl") / F.col("cuts")).cast("int"))
        .withColumn("to", F.floor((F.col("piece") + 1) * F.col("gl") / F.col("cuts")).cast("int"))
        .select("nombre", "gl", "rl", "piece", F.substring("nombre", F.col("from") + 1, F.col("to") - F.col("from")).alias("text"))
    )
    offers = (
        raw.select("name", r_len.alias("rl"))
        .withColumn("gl", F.explode(F.sequence(_shortest(F.col("rl"), threshold), _longest(F.col("rl"), threshold))))
        .withColumn("edits", _allowed_edits(F.col("rl"), F.col("gl"), threshold))
        .filter((F.col("edits") >= 0) & (F.abs(F.col("rl") - F.col("gl")) <= F.col("edits")))
        .withColumn("cuts", F.col("edits") + 1)
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("edits"))))
        .withColumn("from", F.floor(F.col("piece") * F.col("gl") / F.col("cuts")).cast("int"))
        .withColumn("size", F.floor((F.col("piece") + 1) * F.col("gl") / F.col("cuts")).cast("int") - F.col("from"))
        .withColumn("low", F.greatest(F.lit(0), F.col("from") - F.col("edits")))
        .withColumn("high", F.least(F.col("rl") - F.col("size"), F.col("from") + F.col("edits")))
        .filter(F.col("high") >= F.col("low"))
        .withColumn("at", F.explode(F.sequence("low", "high")))
        .select("name", "gl", "rl", "piece", F.substring("name", F.col("at") + 1, F.col("size")).alias("text"))
        .distinct()
    )
    met = offers.join(pieces, ["gl", "rl", "piece", "text"]).select("name", "nombre").distinct()
    # the edit bound itself is cheap next to a score, and rules out most pairs that merely share a piece
    return met.filter(F.levenshtein("name", "nombre") <= _allowed_edits(r_len, g_len, threshold))


def match_names(
    raw: DataFrame, golden: DataFrame, name: str, hint: str | None = None, threshold: float = THRESHOLD
) -> DataFrame:
    """Best catalogue entry per distinct (raw name, department hint), or NULLs.

    An exact name wins with score 1 before any penalty; otherwise the best penalised
    score at or above the threshold, earliest catalogue entry on equal scores.
    """
    hint_col = F.col(hint) if hint else F.lit(None).cast("string")
    asked = raw.select(F.col(name).alias("raw_name"), hint_col.alias("raw_hint")).distinct()
    asked = asked.withColumn("name", sanitize_text(F.col("raw_name"))).withColumn(
        "hint", F.nullif(sanitize_text(F.col("raw_hint")), F.lit(""))
    )
    names = asked.filter("name != ''").select("name").distinct()
    entries = golden.withColumnRenamed("nombre_municipio", "nombre")

    # Homonyms: the exact rule looks only at the earliest entry of a name.
    first = entries.groupBy("nombre").agg(F.min_by("cod_municipio", F.struct("seq", "cod_municipio")).alias("cod_exact"))
    exact = asked.join(first, F.col("name") == F.col("nombre")).select("raw_name", "raw_hint", "cod_exact")

    pairs = candidate_pairs(
        names.join(first.select(F.col("nombre").alias("name")), "name", "left_anti"),
        entries.select("nombre").distinct(),
        threshold,
    )
    scored = pairs.withColumn("score", match_score(F.col("name"), F.col("nombre"))).filter(
        F.col("score") >= threshold - EPS
    )
    full = asked.join(scored, "name").join(entries, "nombre")
    other_department = F.col("hint").isNotNull() & (F.col("nombre_departamento") != "") & (
        F.col("hint") != F.col("nombre_departamento")
    )
    full = full.withColumn("score", F.when(other_department, F.col("score") * DEPARTMENT_PENALTY).otherwise(F.col("score")))
    w = Window.partitionBy("raw_name", "raw_hint").orderBy(F.col("score").desc(), "seq", "cod_municipio")
    fuzzy = (
        full.filter(F.col("score") >= threshold)
        .withColumn("__rank", F.row_number().over(w))
        .filter("__rank = 1")
        .select("raw_name", "raw_hint", F.col("cod_municipio").alias("cod_fuzzy"), "score")
    )
    on = lambda a, b: F.col(f"{a}.raw_name").eqNullSafe(F.col(f"{b}.raw_name")) & F.col(f"{a}.raw_hint").eqNullSafe(
        F.col(f"{b}.raw_hint")
    )
    both = (
        asked.alias("a")
        .join(exact.alias("e"), on("a", "e"), "left")
        .join(fuzzy.alias("f"), on("a", "f"), "left")
        .select(
            F.col("a.raw_name"),
            F.col("a.raw_hint"),
            F.coalesce("cod_exact", "cod_fuzzy").alias("cod_municipio"),
            F.when(F.col("cod_exact").isNotNull(), F.lit(1.0)).otherwise(F.round("score", 4)).alias("similarity_score"),
            F.when(F.col("cod_exact").isNotNull(), F.lit("EXACT"))
            .when(F.col("cod_fuzzy").isNotNull(), F.lit("FUZZY"))
            .alias("match_type"),
        )
    )
    return both.join(golden.drop("seq"), "cod_municipio", "left").select(
        "raw_name",
        "raw_hint",
        "cod_municipio",
        "nombre_municipio",
        "cod_departamento",
        "nombre_departamento",
        "similarity_score",
        "match_type",
    )
