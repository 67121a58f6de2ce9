"""Language of a text by multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of one to four characters, taken from the letters of the lower-case text with single
spaces between words. Document frequencies are counted over all training documents, in the tasks that read them. The
weights are trained on a bounded sample by follow-the-regularised-leader (per-coordinate steps; the L1 part keeps them
sparse, the L2 part small); a temperature is then fitted on sampled documents that the weights were not trained on.

Results in special cases: a NULL text, or one without a letter, is ``und`` with score 0; without any training document all
are; one language alone is always predicted, with score 1; repeated rows get equal results; very long texts are
counted block by block; labels of NULL are not learned from. Further columns are carried along if named in ``keep``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 15
SIZE = 1 << BITS
GRAMS = (1, 2, 3, 4)
#: Training documents that go to the driver, at most about: of each language, and in all. A fifth is for the temperature.
SAMPLE_PER_LANGUAGE, SAMPLE_ROWS = 1000, 4000
BLOCK = 1 << 20
UNKNOWN = "und"


def gram_counts(text: str | None) -> np.ndarray | None:
    """How often each hashed n-gram occurs; None if the text has no letter."""
    if not text:
        return None
    out = None
    for k in range(0, len(text), BLOCK):
        codes = np.frombuffer(text[k : k + BLOCK].lower().encode("utf-32-le", "surrogatepass"), "<u4")
        table, index = np.unique(codes, return_inverse=True) if len(codes) < 4096 else _ranked(codes)
        letter = np.fromiter((chr(c).isalpha() for c in table.tolist()), bool, len(table))
        if not letter.any():
            continue
        line = np.where(letter, table, 32).astype(np.uint64)[index]
        line = line[np.concatenate([[True], (line[1:] != 32) | (line[:-1] != 32)])]  # runs of other characters are one space
        if line[0] != 32:
            line = np.concatenate([[np.uint64(32)], line])
        if line[-1] != 32:
            line = np.concatenate([line, [np.uint64(32)]])
        counts, h = np.zeros(SIZE, np.int64), np.zeros(len(line), np.uint64)
        for n in range(1, max(GRAMS) + 1):
            h = (h[: len(line) - n + 1] * np.uint64(0x100000001B3) + line[n - 1 :] + np.uint64(n)) if len(line) >= n else h[:0]
            if n in GRAMS:
                mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                counts += np.bincount((mixed >> np.uint64(64 - BITS)).astype(np.int64), minlength=SIZE)
        out = counts if out is None else out + counts
    return out


def _ranked(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique for long texts of few characters, without sorting them."""
    top = int(codes.max()) + 1
    seen = np.zeros(top, bool)
    seen[codes] = True
    table = np.flatnonzero(seen)
    rank = np.zeros(top, np.int64)
    rank[table] = np.arange(len(table))
    return table.astype(np.uint32), rank[codes]


def sparse(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, values) of the TF-IDF vector, of length 1."""
    at = np.flatnonzero(counts)
    values = (1.0 + np.log(counts[at])) * idf[at]
    size = math.sqrt(float(values @ values))
    return at, values / size if size else values


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # SIZE x languages
    idf: np.ndarray
    temperature: float = 1.0

    def scores(self, counts: np.ndarray) -> np.ndarray:
        at, values = sparse(counts, self.idf)
        return values @ self.weights[at]

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = gram_counts(text)
        if counts is None or not self.languages:
            return UNKNOWN, 0.0
        p = softmax(self.scores(counts) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], n: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.02, epochs: int = 2) -> np.ndarray:
    """Weights (SIZE x n) after some passes of follow-the-regularised-leader over (positions, values, class)."""
    z, squares = np.zeros((SIZE, n)), np.zeros((SIZE, n))

    def weights(at: np.ndarray | slice) -> np.ndarray:
        lean = np.abs(z[at]) - l1
        return np.where(lean > 0, -np.sign(z[at]) * lean / ((beta + np.sqrt(squares[at])) / alpha + l2), 0.0)

    order = np.random.default_rng(0)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at, values, y = rows[k]
            w = weights(at)
            error = softmax(values @ w)
            error[y] -= 1.0
            g = values[:, None] * error[None, :]
            before = squares[at]
            after = before + g * g
            z[at] += g - (np.sqrt(after) - np.sqrt(before)) / alpha * w
            squares[at] = after
    return weights(slice(None))


def fit_temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The temperature of the least log loss, by golden-section search on its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        z = scores / math.exp(t)
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]).mean())

    low, high, ratio = math.log(0.05), math.log(20.0), (math.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return math.exp((low + high) / 2)


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Documents with a letter, and in how many of them each hashed n-gram occurs; counted where they are read."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, df = 0, np.zeros(SIZE, np.int64)
        for batch in batches:
            for text in batch["text"]:
                counts = gram_counts(text)
                if counts is not None:
                    total += 1
                    df += counts > 0
        at = np.flatnonzero(df)
        yield pd.DataFrame({"gram": np.concatenate([[-1], at]), "n": np.concatenate([[total], df[at]])})

    rows = docs.select("text").mapInPandas(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()  # SIZE + 1 at most
    df = np.zeros(SIZE + 1, np.int64)
    df[rows["gram"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)  # -1 is the last
    return int(df[-1]), df[:-1]


def learn(docs: DataFrame, label: str = "lang", key: str = "doc_id", bound: int = SAMPLE_PER_LANGUAGE, rows_in_all: int = SAMPLE_ROWS) -> Model:
    """A model from all labelled rows of ``docs``: frequencies of all, weights and temperature of a bounded sample."""
    rows = docs.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("label"), F.col(key).alias("key"), "text")
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if len(languages) < 2:
        return Model(languages, np.zeros((SIZE, len(languages))), np.ones(SIZE))
    bound = min(bound, max(1, rows_in_all // len(languages)))
    total, df = document_frequencies(rows)
    idf = np.log((1.0 + total) / (1.0 + df)) + 1.0
    share = F.create_map(*[x for s in languages for x in (F.lit(s), F.lit(min(1.0, bound / sizes[s])))])
    draw = F.pmod(F.xxhash64("key", F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    number = {s: k for k, s in enumerate(languages)}

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for label_, key_, text in zip(batch["label"], batch["key"], batch["text"]):
                counts = gram_counts(text)
                if counts is not None:
                    at, values = sparse(counts, idf)
                    out.append((number[label_], str(key_), at.astype(np.uint16).tobytes(), values.astype(np.float32).tobytes()))
            yield pd.DataFrame(out, columns=["label", "key", "at", "vals"])

    sample = rows.where(draw < share[F.col("label")]).mapInPandas(vectors, "label int, key string, at binary, vals binary")
    held = F.pmod(F.xxhash64("key", F.lit("temperature")), F.lit(5)) == 0
    found = sample.withColumn("held", held).toPandas().sort_values(["key", "label", "at"]).reset_index(drop=True)
    data = [(np.frombuffer(a, np.uint16), np.frombuffer(v, np.float32), y) for a, v, y in zip(found["at"], found["vals"], found["label"])]
    mark = found["held"].to_numpy(bool)
    weights = train_ftrl([r for r, h in zip(data, mark) if not h], len(languages))
    rest = [r for r, h in zip(data, mark) if h]
    scores = np.array([values @ weights[at] for at, values, _ in rest]).reshape(-1, len(languages))
    return Model(languages, weights, idf, fit_temperature(scores, np.array([y for *_, y in rest], np.int64)))


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``keep``, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SIZE numbers a language

    @F.pandas_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    def of(texts: pd.Series) -> pd.DataFrame:
        known = shared.value
        return pd.DataFrame([known.predict(t) for t in texts], columns=["lang_pred", "score"])

    return docs.select(*(["doc_id"] if keep is None else keep), of(F.col("text")).alias("p")).select(*(["doc_id"] if keep is None else keep), "p.*")


def is_held_out(doc_id: Column) -> Column:
    """A third of the documents, by the checksum of their id; a NULL id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
