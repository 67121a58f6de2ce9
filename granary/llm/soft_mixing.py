"""Mixes documents to target weights of domains that are known only as probabilities.

A classifier learned from labelled rows gives every document a probability for each domain (soft membership), so a
domain's tokens are expected totals. Nonnegative rates, how often each document is to be used, are then fitted so that the
expected totals under these rates match the targets: least squares, and of all such rates those that change documents
least. In the metric that weighs documents by their tokens, a document's gradient is its posterior times the errors of the
domains, so rates that started at 1 are always the bound or 1 + posterior * change, whichever is more, with one change per
domain for all documents. A step moves these few numbers against the gradient, scaled by the curvature of the documents above the bound
(plain steps would need thousands of passes), and projects all rates onto the bound again; it needs a few sums from all
documents (``settle``). Steps go on until the gradient is gone, or the fit fails. The bound is 0; with ``floor``, a
document of a domain that does not shrink has a rate of 1 at least, which keeps totals from their targets where posteriors
overlap. Rates become whole copies by a hash of the document.

Results in special cases: a NULL or blank text has no tokens and keeps the rate that its probabilities give; repeated
rows get equal rates; labels that are NULL or name no document are not learned from; with labels of one domain only,
or none, every document belongs to the one that was seen, or else to the first; an empty table gives no rows; further
columns are carried along by ``resample``, or if named in ``keep``.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.common import bounded_share, written

DOMAINS = ("good", "poor", "toxic")
#: Labelled documents that the classifier is learned from, at most about, and words it looks at.
SAMPLE_ROWS = 6000
VOCABULARY = 384
LEAST_DOCUMENTS = 8
STYLES = 6
WORD = re.compile(r"[^\W\d_]+")
SYMBOLS = "#*$%&|<>"
#: Steps of the fit at most, steps after which rates are written down, the error that is good enough as a share of all
#: tokens, and the share by which a step has to lower the squared error for another one to follow.
STEPS, STRIDE, TOLERANCE, PROGRESS = 48, 8, 1e-4, 0.005

#: Newton steps of ``settle`` at most, the error that its totals may have as a share of all tokens, the weight of errors
#: against changes of documents, and the lengths that are tried for each step.
NEWTON_STEPS, SETTLED, STIFFNESS, LENGTHS = 100, 1e-7, 1e5, (1.0, 0.5, 0.2, 0.05, 0.005)


def domain_of(quality: Column, toxic: Column) -> Column:
    """The domain that a label stands for; NULL if it says too little."""
    return F.when(toxic == 1, "toxic").when(quality == 0, "poor").when(quality == 1, "good")


def words_in(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def style(text: str | None) -> list[float]:
    """A few shares of characters and words, roughly from 0 to 1."""
    text = text or ""
    words = text.split()
    n = max(1, len(words))
    symbols = sum(map(text.count, SYMBOLS))
    upper = sum(w.isupper() and len(w) > 1 for w in words)
    return [1.0, symbols / n, upper / n, text.count("!") / n, (text.count("\n") + 1) / n, len(set(words)) / n]


@dataclass
class Classifier:
    domains: list[str]
    vocabulary: list[str]
    weights: np.ndarray  # (STYLES + words) x domains

    def features(self, text: str | None) -> tuple[list[float], list[int]]:
        places = self.__dict__.setdefault("_places", {w: k for k, w in enumerate(self.vocabulary)})
        return style(text), [places[w] for w in words_in(text) & places.keys()]

    def posterior(self, text: str | None) -> np.ndarray:
        styles, found = self.features(text)
        z = np.array(styles) @ self.weights[:STYLES] + self.weights[[STYLES + k for k in found]].sum(axis=0)
        e = np.exp(z - z.max())
        return e / e.sum()


def train_softmax(x: np.ndarray, y: np.ndarray, n: int, penalty: float = 1e-3, steps: int = 300, rate: float = 0.05) -> np.ndarray:
    """Weights of a multinomial logistic regression, by full passes with adaptive moments."""
    w, m, v = (np.zeros((x.shape[1], n)) for _ in range(3))
    want = np.eye(n)[y]
    for t in range(1, steps + 1):
        z = x @ w
        e = np.exp(z - z.max(axis=1, keepdims=True))
        g = x.T @ (e / e.sum(axis=1, keepdims=True) - want) / len(y) + penalty * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def learn(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS) -> Classifier:
    """A classifier from at most about ``bound`` labelled documents."""
    domain = domain_of(F.col("quality"), F.col("toxic"))
    marked = labels.select(F.col("doc_id").alias("_id"), domain.alias("domain")).where("_id is not null and domain is not null")
    marked = bounded_share(marked, bound, F.col("_id"))
    met = docs.select("doc_id", "text").join(F.broadcast(marked), F.col("doc_id") == F.col("_id"))  # no more than the bound
    sample = written(met.select("doc_id", "text", "domain"), "labelled")
    sizes = {r["domain"]: r["n"] for r in sample.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    domains = [d for d in DOMAINS if d in sizes]
    if len(domains) < 2:
        return Classifier(list(DOMAINS), [], np.where(np.array(DOMAINS) == (domains or DOMAINS)[0], 0.0, -1e3)[None, :].repeat(STYLES, 0) * np.eye(STYLES)[:, :1])

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(w, d) for text, d in zip(batch["text"], batch["domain"]) for w in words_in(text)]
            yield pd.DataFrame(out, columns=["word", "domain"])

    total = sum(sizes.values())
    counts = sample.select("text", "domain").mapInPandas(words, "word string, domain string").groupBy("word")
    counts = counts.agg(F.count("*").alias("df"), *[F.sum(F.when(F.col("domain") == d, 1).otherwise(0)).alias(d) for d in domains])
    counts = counts.where(F.col("df") >= LEAST_DOCUMENTS)
    # how far a word's documents are from falling on the domains as all do
    terms = [F.col(d) * F.log(F.greatest(F.col(d), F.lit(0.5)) * total / (F.col("df") * sizes[d])) for d in domains]
    best = counts.withColumn("gain", sum(terms[1:], terms[0])).orderBy(F.desc("gain"), "word").limit(VOCABULARY)
    model = Classifier(domains, [r["word"] for r in best.select("word").collect()], np.zeros((STYLES + VOCABULARY, len(domains))))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [model.features(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "domain": batch["domain"], "styles": [s for s, _ in found], "words": [sorted(w) for _, w in found]})

    rows = sample.mapInPandas(features, "doc_id long, domain string, styles array<double>, words array<int>").toPandas()
    rows = rows.sort_values(["doc_id", "domain"])
    x = np.zeros((len(rows), STYLES + VOCABULARY))
    x[:, :STYLES] = np.stack(rows["styles"].to_list())
    for k, found in enumerate(rows["words"]):
        x[k, STYLES + np.asarray(found, np.int64)] = 1.0
    weights = train_softmax(x, np.array([domains.index(d) for d in rows["domain"]]), len(domains))
    out = np.full((STYLES + VOCABULARY, len(DOMAINS)), 0.0)
    for k, d in enumerate(DOMAINS):
        if d in domains:
            out[:, k] = weights[:, domains.index(d)]
        else:
            out[0, k] = -1e3  # never seen
    return Classifier(list(DOMAINS), model.vocabulary, out)


def with_posteriors(docs: DataFrame, model: Classifier) -> DataFrame:
    """``docs`` with n_tokens (words) and posterior, one probability per domain."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred words

    @F.pandas_udf(T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("posterior", T.ArrayType(T.DoubleType()))]))
    def of(texts: pd.Series) -> pd.DataFrame:
        known = shared.value
        return pd.DataFrame({"n_tokens": [len((t or "").split()) for t in texts], "posterior": [known.posterior(t) for t in texts]})

    others = [F.col(f"`{c}`") for c in docs.columns]
    return docs.select(*others, of(F.col("text")).alias("_mix")).select(*others, F.col("_mix.n_tokens").alias("n_tokens"), F.col("_mix.posterior").alias("posterior"))


def after_steps(rate: Column, posterior: Column, steps: list[list[float]]) -> Column:
    """The rate after some projected gradient steps, each given as a change per domain."""
    if not steps:
        return rate
    listed = F.array(*[F.array(*[F.lit(float(x)) for x in step]) for step in steps])
    change = lambda step: F.aggregate(F.zip_with(posterior, step, lambda p, s: p * s), F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(listed, rate, lambda r, step: F.greatest(F.lit(0.0), r + change(step)))


@dataclass
class Fit:
    steps: list[list[float]]
    tokens: list[float]  # expected tokens of each domain before
    targets: list[float]
    reached: list[float]
    least: list[float] | None = None  # bounds on the rates, by the likeliest domain of a document

    def rate(self, posterior: Column) -> Column:
        if self.least is None:
            return after_steps(F.lit(1.0), posterior, self.steps)
        return F.greatest(bound_of(posterior, self.least), 1.0 + dot(posterior, self.steps[0]))


def dot(posterior: Column, change: list[float]) -> Column:
    terms = [F.get(posterior, k) * F.lit(float(x)) for k, x in enumerate(change)]
    return sum(terms[1:], terms[0])


def bound_of(posterior: Column, least: list[float]) -> Column:
    top = F.array_position(posterior, F.array_max(posterior)).cast("int")
    return F.get(F.array(*[F.lit(float(x)) for x in least]), top - 1)


def targets_of(tokens: np.ndarray, weights: dict[str, float], anchor: str) -> np.ndarray:
    at = DOMAINS.index(anchor)
    share = np.array([weights.get(d, 0.0) for d in DOMAINS])
    return share * (tokens[at] / share[at]) if share[at] > 0 else share * tokens.sum() / max(share.sum(), 1e-12)


def stays(tokens: list[float], targets: list[float]) -> list[bool]:
    """Which domains do not shrink."""
    return [bool(t >= s * (1 - 1e-9)) for s, t in zip(tokens, targets)]


def settle(rows: DataFrame, weights: dict[str, float], anchor: str = DOMAINS[0], floor: bool = False) -> Fit:
    """The rates for ``rows`` (n_tokens, posterior) that gradient steps, held above the bounds at each step, end at.

    The total is chosen so that the anchor's tokens stay as they are. ``floor``: documents of domains that do not shrink keep a
    rate of 1 at least.

    Least squares of the totals' errors, each relative to its domain's own tokens, plus a small share (1 / STIFFNESS) of
    the squared changes of documents weighted by their tokens. Its rates are max(bound, 1 + posterior * change), so only
    the changes are unknown. They are where a convex function of them is least; its gradient and curvature are sums over
    all documents, and as it is piecewise quadratic, Newton steps come to rest. Fails if they do not.
    """
    n = len(DOMAINS)
    p = [F.get("posterior", k) for k in range(n)]
    tokens = np.array([float(x or 0.0) for x in rows.agg(*[F.sum(F.col("n_tokens") * p[k]).alias(f"s{k}") for k in range(n)]).first()])
    targets = targets_of(tokens, weights, anchor)
    total = max(tokens.sum(), 1.0)
    scale = np.sqrt(np.maximum(tokens, 1e-6 * total))
    least = [1.0 if floor and x else 0.0 for x in stays(tokens.tolist(), targets.tolist())]

    def measured(changes: list[np.ndarray]) -> list[tuple[float, np.ndarray, np.ndarray, np.ndarray]]:
        """Value, gradient, curvature and totals at each of some changes (in units of 1 / scale), in one pass."""
        listed = [u / scale for u in changes]

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((len(listed), 1 + n + n * n))
            for batch in batches:
                tokens_ = batch.column("n_tokens").to_numpy(zero_copy_only=False).astype(np.float64)
                own = batch.column("posterior").flatten().to_numpy().reshape(-1, n)
                bound = np.array(least)[own.argmax(axis=1)]
                for row, change in zip(sums, listed):
                    free = 1.0 + own @ change
                    rate, up = np.maximum(free, bound), free >= bound
                    row[0] += tokens_ @ (rate * (free - rate / 2) - 0.5)
                    row[1 : n + 1] += (tokens_ * rate) @ own
                    row[n + 1 :] += ((own * (tokens_ * up)[:, None]).T @ own).ravel()
            yield pa.RecordBatch.from_arrays([pa.array([sums.ravel().tolist()], pa.list_(pa.float64()))], ["sums"])

        got = rows.select("n_tokens", "posterior").mapInArrow(partial, "sums array<double>").collect()  # one short row a task
        got = np.array([r["sums"] for r in got] or [np.zeros(len(listed) * (1 + n + n * n))]).sum(axis=0).reshape(len(listed), -1)
        out = []
        for u, x in zip(changes, got):
            reached = x[1 : n + 1]
            value = x[0] - float(u / scale @ targets) + float(u @ u) / (2 * STIFFNESS)
            out.append((value, u / STIFFNESS + (reached - targets) / scale, np.eye(n) / STIFFNESS + x[n + 1 :].reshape(n, n) / np.outer(scale, scale), reached))
        return out

    at = np.zeros(n)
    value, gradient, curvature, reached = measured([at])[0]
    for step in range(NEWTON_STEPS):
        if np.abs(gradient * scale).max() <= SETTLED * total:
            break
        move = -np.linalg.solve(curvature, gradient)
        tried = [at + length * move for length in LENGTHS]
        found = measured(tried)
        best = min(range(len(tried)), key=lambda k: found[k][0])
        # close to rest, values no longer differ: the smallest gradient decides
        if not found[best][0] < value - 1e-12 * total:
            best = min(range(len(tried)), key=lambda k: float(np.abs(found[k][1]).max()))
        at, (value, gradient, curvature, reached) = tried[best], found[best]
    else:
        raise RuntimeError(f"rates did not settle in {NEWTON_STEPS} steps: {reached.tolist()} tokens of {targets.tolist()}")
    logging.getLogger(__name__).info("%d steps; tokens of %s: %s before, target %s, reached %s", step, DOMAINS, tokens.tolist(), targets.tolist(), reached.tolist())
    return Fit([(at / scale).tolist()], tokens.tolist(), targets.tolist(), reached.tolist(), least)


def fit_rates(rows: DataFrame, weights: dict[str, float], anchor: str = DOMAINS[0]) -> Fit:
    """The first plain gradient steps for ``rows`` (n_tokens, posterior), for comparison; ``settle`` has where they lead.

    The total is chosen so that the anchor's tokens stay as they are. In the metric that weighs documents by their
    tokens the gradient for a document is its posterior times the errors of the domains, so rates depend on the posterior alone, and
    all that a step needs is summed in one pass. Errors are taken relative to each domain's own tokens.
    """
    n = len(DOMAINS)
    p = [F.get("posterior", k) for k in range(n)]
    sums = [F.sum(F.col("n_tokens") * p[k]) for k in range(n)] + [F.sum(F.col("n_tokens") * p[a] * p[b]) for a in range(n) for b in range(n)]
    first = [float(x or 0.0) for x in rows.agg(*[s.alias(f"s{k}") for k, s in enumerate(sums)]).first()]
    tokens = np.array(first[:n])
    targets = targets_of(tokens, weights, anchor)
    total = max(tokens.sum(), 1.0)
    scale = np.sqrt(np.maximum(tokens, 1e-6 * total))
    gram = np.array(first[n:]).reshape(n, n) / np.outer(scale, scale)
    step = 1.0 / max(float(np.linalg.eigvalsh(gram)[-1]), 1e-9)
    done: list[list[float]] = []
    state, pending = rows.select("n_tokens", "posterior", F.lit(1.0).alias("rate")), []
    reached, error = tokens, lambda at: float((((at - targets) / scale) ** 2).sum())
    last = np.inf
    while len(done) < STEPS and np.abs(reached - targets).max() > TOLERANCE * total and error(reached) < (1 - PROGRESS) * last:
        last = error(reached)
        move = [float(x) for x in -step * (reached - targets) / scale**2]
        done.append(move)
        pending.append(move)
        now = after_steps(F.col("rate"), F.col("posterior"), pending)
        if len(pending) == STRIDE:
            state, pending = written(state.select("n_tokens", "posterior", now.alias("rate")), "rates"), []
            now = F.col("rate")
        held = state.select("n_tokens", "posterior", now.alias("r"))
        reached = np.array([float(x or 0.0) for x in held.agg(*[F.sum(F.col("n_tokens") * p[k] * F.col("r")).alias(f"s{k}") for k in range(n)]).first()])
    return Fit(done, tokens.tolist(), targets.tolist(), reached.tolist())


def copies(rate: Column, posterior: Column, fit: Fit, *key: Column) -> Column:
    """Whole copies whose expectation is the rate, and no fewer than the fit's bounds."""
    draw = F.pmod(F.xxhash64(*key, F.lit("copies")), F.lit(1 << 40)) / float(1 << 40)
    least = bound_of(posterior, fit.least or [0.0] * len(DOMAINS))
    return F.greatest(F.floor(rate + draw), least).cast("int")


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float], keep: list[str] | None = None, floor: bool = False) -> DataFrame:
    """``keep``, n_tokens, posterior, domain (the likeliest), rate, copies of every document."""
    keep = ["doc_id"] if keep is None else keep
    model = learn(docs, labels)
    small = written(with_posteriors(docs.select(*dict.fromkeys([*keep, "doc_id", "text"])), model).drop("text"), "posteriors")
    return rated(small, settle(small, weights, floor=floor)).select(*keep, "n_tokens", "posterior", "domain", "rate", "copies")


def rated(rows: DataFrame, fit: Fit) -> DataFrame:
    posterior = F.col("posterior")
    rows = rows.withColumn("rate", fit.rate(posterior))
    top = F.get(F.array(*map(F.lit, DOMAINS)), (F.array_position(posterior, F.array_max(posterior)) - 1).cast("int"))
    return rows.withColumns({"domain": top, "copies": copies(F.col("rate"), posterior, fit, F.col("doc_id"))})


def resample(docs: DataFrame, labels: DataFrame, weights: dict[str, float], fitted: Callable[[DataFrame, dict[str, float]], Fit] = settle) -> DataFrame:
    """``docs`` with every document as often as its copies say, at the rates of ``fitted``."""
    model = learn(docs, labels)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_document")
    rows = with_posteriors(docs.select(whole, "doc_id", "text"), model).drop("text")
    fit = fitted(written(rows.select("n_tokens", "posterior"), "posteriors"), weights)
    times = F.array_repeat(F.lit(1), F.col("copies"))
    return rated(rows, fit).select("_document", F.explode(times).alias("_copy")).select("_document.*")
