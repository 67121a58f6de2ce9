"""Centroid clustering (Lloyd's rounds in exact integers) with ns-bounds.

Every vector carries, for each centroid, the distance it was last evaluated at and the round of that evaluation. The centroids of
all rounds are kept, so a stored distance is loosened by the norm of the centroid's *total* displacement since that round,
which is never more than the sum of the single moves. A vector whose bound for its own centroid stays under all
other bounds is left alone; otherwise its own distance is evaluated, and then exactly those other centroids whose bounds
still overlap it. Stored distances are single-precision numbers rounded down, and displacements are rounded up, so
bounds only ever err towards another evaluation, and all decisions are made on exact integers.

Rounds are Spark jobs over a table of vectors with their state, written anew each round. A centroid's sums change by the vectors that
moved only: a round reads these back (the filter reaches the Parquet scan) and adds or takes them, summed by task before anything is
shuffled. The driver holds centroids and sums, ``k`` times ``dim`` numbers a round; no vector goes there but the first ``k``.

Results in special cases: a vector is left out if it is NULL, has another number of components, or a NULL or non-finite one, or one
beyond ``LARGEST`` after scaling (squared distances would not fit 64 bits); NULL ids count as empty ones in the hash
that picks the first centroids and are kept; repeated rows are vectors of their own; equal centroids and other ties go
to the smaller number; with fewer vectors than ``k``, each is a centroid; an empty table gives no rows. Other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import written

DIM, K, ROUNDS, SCALE, SEED = 64, 16, 3, 64, "1"
#: Largest scaled component in size: 64 squared differences of such numbers fit a long.
LARGEST = 1 << 27
STATE = "vec_id {id}, v array<int>, bounds binary, since binary, was int, cluster int"


def scaled(df: DataFrame, vector: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the vector's components as integers: floor of scale * x in doubles; others are left out."""
    v = F.col(vector)
    whole = v.isNotNull() & (F.size(v) == dim)
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(F.floor(x.cast("double") * scale)) < LARGEST) & (F.abs(x.cast("double")) < LARGEST))
    return df.where(whole & usable).select("vec_id", F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("v"))


def hash_order(key: Column, seed: str = SEED) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)


@dataclass
class History:
    """The centroids of all rounds so far."""

    rounds: list[np.ndarray] = field(default_factory=list)

    @property
    def now(self) -> np.ndarray:
        return self.rounds[-1]

    def displacement(self) -> np.ndarray:
        """[r, j]: how far centroid j is from where it was in round r, rounded up."""
        moved = np.stack(self.rounds).astype(np.float64) - self.now
        return np.sqrt((moved**2).sum(axis=2)) * (1 + 1e-9)


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = v.astype(np.int64) - c
    return (d * d).sum(axis=-1)


def rounded_down(squares: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(np.sqrt(squares.astype(np.float64)).astype(np.float32), np.float32(0)), 0)


def reassign(v: np.ndarray, cluster: np.ndarray, bounds: np.ndarray, since: np.ndarray, history: History) -> int:
    """Moves every vector to its nearest centroid (ties: the smaller number), updating its state; returns how many distances it took."""
    now, at = history.now, len(history.rounds) - 1
    moved, rows = history.displacement(), np.arange(len(v))
    shift = moved[since, np.arange(len(now))[None, :]]
    low = np.maximum(bounds.astype(np.float64) * (1 - 1e-9) - shift, 0)
    own = np.nextafter(np.nextafter(bounds[rows, cluster], np.float32(np.inf)), np.float32(np.inf)).astype(np.float64)  # the stored distance from above
    high = own * (1 + 1e-9) + shift[rows, cluster]
    low[rows, cluster] = np.inf
    todo = np.flatnonzero((low <= high[:, None]).any(axis=1))
    if not len(todo):
        return 0
    best, took = squared(v[todo], now[cluster[todo]]), len(todo)
    bounds[todo, cluster[todo]], since[todo, cluster[todo]] = rounded_down(best), at
    chosen = cluster[todo].copy()
    fails = low[todo] <= (np.sqrt(best.astype(np.float64)) * (1 + 1e-9))[:, None]
    for j in range(len(now)):  # the exact rescan, one centroid at a time
        k = np.flatnonzero(fails[:, j])
        if len(k):
            d = squared(v[todo[k]], now[j])
            took += len(k)
            bounds[todo[k], j], since[todo[k], j] = rounded_down(d), at
            closer = (d < best[k]) | ((d == best[k]) & (j < chosen[k]))
            best[k[closer]], chosen[k[closer]] = d[closer], j
    cluster[todo] = chosen
    return took


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _round(rows: DataFrame, history: History, dim: int, fresh: bool) -> DataFrame:
    """The table with its state after one assignment; ``fresh`` tables have no state yet."""
    k = len(history.now)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            v = _vectors(batch.column("v"), dim)
            if fresh:  # a bound of zero for all: every distance is evaluated
                cluster, bounds, since = np.zeros(n, np.int64), np.zeros((n, k), np.float32), np.zeros((n, k), np.int16)
                was = np.full(n, -1)
            else:
                was = batch.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64)
                cluster = was.copy()
                bounds, since = (np.frombuffer(b"".join(x.as_py() for x in batch.column(name)), kind).reshape(n, k).copy() for name, kind in (("bounds", "<f4"), ("since", "<i2")))
            reassign(v, cluster, bounds, since, history)
            packed = [pa.array([row.tobytes() for row in x], pa.binary()) for x in (bounds.astype("<f4"), since.astype("<i2"))]
            columns = [batch.column("vec_id"), batch.column("v"), *packed, pa.array(was, pa.int32()), pa.array(cluster, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "v", "bounds", "since", "was", "cluster"])

    return rows.mapInArrow(assign, STATE.format(id=dict(rows.dtypes)["vec_id"]))


def _changes(rows: DataFrame, k: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """What the vectors that moved add to each centroid's sums (k x dim) and counts."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, dim + 1), np.int64)
        for batch in batches:
            v = np.column_stack([_vectors(batch.column("v"), dim).astype(np.int64), np.ones(batch.num_rows, np.int64)])
            was, cluster = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("was", "cluster"))
            np.add.at(sums, cluster, v)
            np.subtract.at(sums, was[was >= 0], v[was >= 0])
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums.ravel()[at], pa.int64())], names=["at", "x"])

    moved = rows.where("was <> cluster").select("v", "was", "cluster").mapInArrow(add, "at int, x long")
    out = np.zeros(k * (dim + 1), object)
    for row in moved.groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():
        out[row["at"]] = int(row["x"])
    out = out.reshape(k, dim + 1)
    return out[:, :dim], out[:, dim]


def cluster_vectors(df: DataFrame, vector: str = "embedding", k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: str = SEED) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, v, cluster of every vector kept, the final centroids)."""
    vectors = scaled(df, vector, dim, scale)
    first = vectors.select("v", hash_order(F.col("vec_id"), seed).alias("h")).orderBy("h", "v").limit(k).collect()
    if not first:
        return vectors.withColumn("cluster", F.lit(0)), np.zeros((0, dim), np.int64)
    history = History([np.array([r.v for r in first], np.int64)])
    sums, counts = np.zeros((len(first), dim), object), np.zeros(len(first), object)
    rows = written(_round(vectors, history, dim, fresh=True), "assigned")
    for _ in range(rounds):
        more, n = _changes(rows, len(first), dim)
        sums, counts = sums + more, counts + n
        now = history.now.copy()
        for j in np.flatnonzero(counts):
            now[j] = [s // counts[j] for s in sums[j]]
        history.rounds.append(now)
        rows = written(_round(rows, history, dim, fresh=False), "assigned")
    return rows.select("vec_id", "v", "cluster"), history.now


def with_measures(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and the hash of the centroid's components."""
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster = batch.column("cluster").to_numpy(zero_copy_only=False)
            d = squared(_vectors(batch.column("v"), centroids.shape[1]), centroids[cluster])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("cluster"), pa.array(d, pa.int64())], names=["vec_id", "cluster", "distance"])

    spark = rows.sparkSession
    measured = rows.mapInArrow(measure, f"vec_id {dict(rows.dtypes)['vec_id']}, cluster int, distance long")
    if not len(centroids):
        return measured.select("*", *[F.lit(None).cast(t).alias(n) for n, t in (("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    measured = written(measured, "measured")
    parts = {r.cluster: r.d for r in measured.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    of_cluster = [(j, parts.get(j, 0), sum(parts.values()), digests[j]) for j in range(len(centroids))]  # k rows
    small = spark.createDataFrame(of_cluster, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return measured.join(F.broadcast(small), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
