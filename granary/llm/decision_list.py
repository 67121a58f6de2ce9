"""Quality rules: text statistics, and a decision list learned from them by sequential covering.

The statistics are native expressions over the whole text. The list is grown on a bounded sample of labelled rows:
each rule is a conjunction of thresholds that grows by information gain on two thirds of the sample and is pruned on
the rest; a rule that is not precise enough there ends the list. The learned list is applied as one ordered conditional
expression, so scoring is a single pass without a shuffle.

Results in special cases: a NULL or blank text has no words, all counts 0 and fails the base rule; repeated rows are
judged each; without labels, or with labels of one class only, the list is empty and the base rule alone decides;
labels that are NULL or whose document is missing are not learned from. An empty table gives no rows; very long texts are
one row each, whole; other columns are carried along, but one named like a result is replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.nulls import stage
from granary.llm.common import bounded_share, named_back, set_apart, words_of

#: Labelled rows that the list is learned from, at most.
SAMPLE_ROWS = 20_000
WINDOW = 5
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        return F.col(self.feature) > self.cut if self.above else F.col(self.feature) <= self.cut

    def mask(self, values: np.ndarray) -> np.ndarray:
        return values > self.cut if self.above else values <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


Rules = list[tuple[Condition, ...]]


def count_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the ratios that rules are made of."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = stage(docs, {"_words": words_of(F.col(text)), "_lines": F.filter(F.split(body, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)})
    n = F.size("_words")
    starts = F.when(n >= WINDOW, F.sequence(F.lit(1), n - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
    rows = stage(
        rows,
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.translate(body, BLANKS, "")).cast("long"),
            "n_symbols": count_of(body, SYMBOLS).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_n_lines": F.size("_lines"),
            "_windows": F.transform(starts, lambda i: F.xxhash64(F.slice(F.col("_words"), i, WINDOW))),
            "_distinct": F.size(F.array_distinct("_words")),
            "_upper": F.length(body) - F.length(F.regexp_replace(body, r"\p{Lu}+", "")),
            "_bangs": count_of(body, "!?"),
            "_digits": count_of(body, "0123456789"),
            "_stops": count_of(body, ".,;:"),
        },
    ).drop("_words", "_lines")
    # only texts with a repeated window are sorted
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    pairs = F.when(repeats, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(
        F.array().cast("array<struct<h:bigint,i:int>>")
    )
    rows = stage(rows, {"_pairs": pairs}).drop("_windows")
    same = lambda i, j: F.get("_pairs", i)["h"].eqNullSafe(F.get("_pairs", j)["h"])
    twins = F.filter("_pairs", lambda x, i: F.when(i > 0, same(i, i - 1)).otherwise(False) | same(i, i + 1))
    rows = stage(rows, {"_at": F.sort_array(F.transform(twins, lambda x: x["i"]))}).drop("_pairs")
    covered = F.transform("_at", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_at", i + 1), x + WINDOW) - x))
    rows = stage(rows, {"n_repeat_words": F.aggregate(covered, F.lit(0).cast("long"), lambda acc, x: acc + x)}).drop("_at")
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    ratios = {
        "mean_word_chars": share("word_chars", "n_words"),
        "symbol_share": share("n_symbols", "word_chars"),
        "upper_share": share("_upper", "word_chars"),
        "bang_share": share("_bangs", "word_chars"),
        "digit_share": share("_digits", "word_chars"),
        "stop_share": share("_stops", "word_chars"),
        "distinct_share": share("_distinct", "n_words"),
        "dup_line_share": share("n_dup_lines", "_n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "words_per_line": share("n_words", "_n_lines"),
    }
    return rows.withColumns(ratios).drop("_n_lines", "_distinct", "_upper", "_bangs", "_digits", "_stops")


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "mean_word_chars symbol_share upper_share bang_share digit_share stop_share distinct_share dup_line_share repeat_share words_per_line"
).split()


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS) -> DataFrame:
    """Statistics and label of at most about ``bound`` labelled documents.

    The sampled labels are no more than the bound, so they may be broadcast; documents are neither moved nor sorted.
    """
    wanted = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "quality")
    wanted = bounded_share(wanted, bound, F.col("doc_id"))
    met = docs.select("doc_id", "text").join(F.broadcast(wanted.withColumnRenamed("doc_id", "_id")), F.col("doc_id") == F.col("_id")).drop("_id")
    return with_statistics(met).where(~base_failed()).select("doc_id", "quality", *FEATURES)


def learn_rules(
    features: dict[str, np.ndarray],
    bad: np.ndarray,
    prune: np.ndarray,
    min_precision: float = 0.95,
    min_cover: int = 5,
    max_rules: int = 16,
    max_conditions: int = 3,
    cuts: int = 64,
) -> Rules:
    """Sequential covering of the ``bad`` rows; ``prune`` marks the rows held back for pruning."""
    if not bad.any() or bad.all():
        return []
    choices = [
        (c, c.mask(values)) for name, values in features.items() for cut in cut_points(values, bad, cuts) for c in (Condition(name, True, cut), Condition(name, False, cut))
    ]
    rules: Rules = []
    left = np.ones(len(bad), bool)
    while len(rules) < max_rules:
        covered, grown = left & ~prune, []
        while len(grown) < max_conditions and (covered & ~bad).any():
            p, n = (covered & bad).sum(), (covered & ~bad).sum()
            if not p:
                break
            now = np.log2(p / (p + n))
            gains = [(q * (np.log2(q / c) - now) if (q := int((m & covered & bad).sum())) and (c := int((m & covered).sum())) else 0.0) for _, m in choices]
            best = int(np.argmax(gains))
            if gains[best] <= 1e-9:
                break
            grown.append(choices[best])
            covered = covered & choices[best][1]
        if not grown:
            break

        def worth(size: int, grown=grown, left=left) -> tuple[float, int]:
            hit = left & prune & np.logical_and.reduce([m for _, m in grown[:size]])
            p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
            return ((p - n) / (p + n) if p + n else -1.0), p

        size = max(range(1, len(grown) + 1), key=lambda s: (*worth(s), -s))
        rule = grown[:size]
        hit = left & np.logical_and.reduce([m for _, m in rule])
        held = hit & prune
        good_enough = (held & bad).sum() >= min_precision * max(1, held.sum()) and (hit & bad).sum() >= min_precision * max(1, hit.sum())
        if not good_enough or (hit & bad).sum() < min_cover:
            break
        rules.append(tuple(c for c, _ in rule))
        left &= ~hit
    return rules


def cut_points(values: np.ndarray, bad: np.ndarray, cuts: int) -> list[float]:
    """Quantiles of either class, each moved halfway to the next value seen."""
    steps, seen = np.linspace(0, 1, cuts + 2)[1:-1], np.unique(values)
    at = np.unique(np.searchsorted(seen, np.concatenate([np.quantile(values[m], steps, method="inverted_cdf") for m in (bad, ~bad)])))
    return [float(seen[i] + seen[i + 1]) / 2 for i in at if i + 1 < len(seen)]


def learn_from(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS) -> Rules:
    rows = labelled_sample(docs, labels, bound).withColumn("_prune", F.pmod(F.xxhash64("doc_id", F.lit("prune")), F.lit(3)) == 0).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["quality"], [r[f] for f in FEATURES]))
    columns = {f: np.array([r[f] for r in rows], float) for f in FEATURES}
    return learn_rules(columns, np.array([r["quality"] == 0 for r in rows], bool), np.array([r["_prune"] for r in rows], bool)) if rows else []


def decision(rules: Rules) -> Column:
    """The first rule that holds, as text; NULL if none does."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for rule in rules:
        holds = rule[0].column()
        for c in rule[1:]:
            holds = holds & c.column()
        out = out.when(holds, F.lit(" and ".join(map(str, rule))))
    return out


def judge(docs: DataFrame, rules: Rules) -> DataFrame:
    """``docs`` with the statistics, base_failed, rule (the learned rule that rejects it, or NULL) and kept."""
    docs, names = set_apart(docs, [*COUNTS, *FEATURES, "base_failed", "rule", "kept"])
    rows = with_statistics(docs).withColumns({"base_failed": base_failed(), "rule": decision(rules)})
    return named_back(rows.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()), names)
