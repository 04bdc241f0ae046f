"""Centroid clustering by the threshold algorithm, on integer vectors.

Centroids are sorted by component once for every dimension.  For a vector each
of these lists is walked outward from the vector's own value, all lists in step;
a centroid met for the first time gets its exact squared distance (random
access).  The squares of the lists' frontier distances add up to a lower bound
for every centroid not met, so a vector stops when that sum strictly exceeds its
best exact distance; equal distances go to the smaller number.  Vectors of a
batch are walked together in numpy.

Vectors that are null, of another length, or hold null or non-finite components
take no part.  A null vec_id is clustered, but starts no centroid; repeated
vec_ids are vectors of their own (ties among starting vectors by components).
Fewer vectors than centroids give fewer centroids; an empty table gives no rows.
Components must stay below 2**25 in absolute value (distances are exact in 64
bits); a larger one is an error.  The k * d centroid components pass through the
driver in every round; nothing else does.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefold.llm.graph import staged

SCALE, DIMENSIONS, CENTROIDS, ROUNDS = 64, 64, 16, 3
BLOCK_CELLS = 1 << 21      # vectors times centroids, or dimensions, that are walked together
LARGEST = 1 << 25


def integer_vectors(embeddings: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v) with v = floor(scale * component) of every usable vector."""
    usable = (f"size(embedding) = {dimensions} AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) "
              "AND abs(x) < double('Infinity'))")
    whole = (f"transform(embedding, x -> CASE WHEN abs({scale} * CAST(x AS DOUBLE)) < {LARGEST} THEN CAST(floor({scale} * CAST(x AS DOUBLE)) AS INT) "
             f"ELSE raise_error('component beyond {LARGEST}') END)")
    return embeddings.filter(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.expr(whole).alias("v"))


class Walk:
    """Sorted lists of ``centroids`` (k x d), one for each dimension."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.order = np.argsort(centroids, axis=0, kind="stable")
        self.values = np.take_along_axis(centroids, self.order, axis=0)
        self.depth = 0                                       # steps made, for tests

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of each row's nearest centroid."""
        step = max(1, BLOCK_CELLS // max(self.centroids.shape))
        parts = [self._block(x[i:i + step]) for i in range(0, len(x), step)]
        return tuple(np.concatenate(p) if p else np.zeros(0, np.int64) for p in (zip(*parts) if parts else ((), ())))

    def _block(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, d = x.shape
        k = len(self.centroids)
        far = np.iinfo(np.int64).max
        high = np.stack([np.searchsorted(self.values[:, j], x[:, j]) for j in range(d)], axis=1)   # next entry upward
        low = high - 1                                                                              # next entry downward
        best, which = np.full(n, far), np.full(n, k)
        met = np.zeros((n, k), bool)
        going = np.arange(n)
        dims = np.arange(d)
        for _ in range(k):
            if not len(going):
                break
            self.depth += 1
            xs, lo, hi = x[going], low[going], high[going]
            down = np.where(lo >= 0, xs - self.values[np.maximum(lo, 0), dims], LARGEST * 4)
            up = np.where(hi < k, self.values[np.minimum(hi, k - 1), dims] - xs, LARGEST * 4)
            below = down <= up
            entry = np.where(below, lo, hi)
            frontier = np.where(below, down, up)
            low[going] = lo - below
            high[going] = hi + ~below
            seen = np.zeros((len(going), k), bool)
            seen[np.arange(len(going))[:, None], self.order[entry, dims]] = True
            seen &= ~met[going]
            met[going] |= seen
            row, centroid = np.nonzero(seen)
            away = xs[row] - self.centroids[centroid]
            exact = np.full(seen.shape, far)
            exact[row, centroid] = np.einsum("ij,ij->i", away, away)
            nearest = exact.argmin(axis=1)                   # the smallest number of equal ones
            value = exact[np.arange(len(going)), nearest]
            nearest = np.where(value < far, nearest, k)
            better = (value < best[going]) | (value == best[going]) & (nearest < which[going])
            best[going[better]], which[going[better]] = value[better], nearest[better]
            going = going[(frontier * frontier).sum(axis=1) <= best[going]]
        return which, best


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy().astype(np.int64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _sums(centroids: np.ndarray):
    """(cluster, n, sums) of each batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = Walk(centroids)
        k, d = centroids.shape
        n, sums = np.zeros(k, np.int64), np.zeros((k, d), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                which, _ = walk.nearest(x)
                n += np.bincount(which, minlength=k)
                np.add.at(sums, which, x)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some], pa.int64()), pa.array(list(sums[some]), pa.list_(pa.int64()))],
                                         names=["cluster", "n", "sums"])
    return run


def _assign(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = Walk(centroids)
        for batch in batches:
            if batch.num_rows:
                which, distance = walk.nearest(_matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(which, pa.int32()), pa.array(distance, pa.int64())],
                                                 names=["vec_id", "cluster", "distance"])
    return run


def starting(vectors: DataFrame, k: int) -> np.ndarray:
    """The k vectors whose ``1:<vec_id>`` has the smallest SHA-256."""
    rows = (vectors.filter("vec_id IS NOT NULL").withColumn("h", F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")).cast("binary"), 256))
            .orderBy("h", "v").limit(k).collect())
    return np.array([r["v"] for r in rows], np.int64)


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: floors of the means; empty ones stay."""
    part = vectors.select("v").mapInArrow(_sums(centroids), "cluster int, n long, sums array<long>")
    total = (part.select("cluster", "n", F.posexplode("sums").alias("dim", "s")).groupBy("cluster", "dim")
             .agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect())
    new = centroids.copy()
    for r in total:
        new[r["cluster"], r["dim"]] = r["s"] // r["n"]
    return new


def clusters(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of
    every vector of (vec_id, v)."""
    spark = vectors.sparkSession
    vectors = staged(vectors, "vectors")
    centroids = starting(vectors, k)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
    placed = staged(vectors.mapInArrow(_assign(centroids), "vec_id long, cluster int, distance long"), "clusters")
    inertia = {r["cluster"]: r["s"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}       # k rows
    about = [(c, s, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in inertia.items()]
    facts = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return (placed.join(F.broadcast(facts), "cluster")                                                                    # k rows
            .select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"))
