"""Linear hinge-loss models by dual coordinate descent, with calibrated scores."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dual_coordinate_descent(rows: Sequence[tuple[object, np.ndarray]], y: np.ndarray, dim: int, c: float = 1.0,
                            epochs: int = 25, seed: int = 5, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights (the last one is the bias) of min |w|^2 / 2 + C sum max(0, 1 - y w.x).

    ``rows`` are (index, values) pairs: an index array for sparse rows, a slice
    for dense ones.  One dual variable is updated at a time, in a new random
    order each epoch, until no projected gradient exceeds 1e-3.  ``weight``
    multiplies C row by row.
    """
    w = np.zeros(dim + 1)
    alpha = np.zeros(len(rows))
    norm = np.array([float(v @ v) + 1.0 for _, v in rows])
    bound = np.full(len(rows), c) if weight is None else c * weight
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            g = y[i] * (float(w[:-1][at] @ v) + w[-1]) - 1.0
            a = alpha[i]
            pg = min(g, 0.0) if a <= 0 else max(g, 0.0) if a >= bound[i] else g
            if abs(pg) < 1e-12:
                continue
            worst = max(worst, abs(pg))
            alpha[i] = min(max(a - g / norm[i], 0.0), bound[i])
            step = (alpha[i] - a) * y[i]
            w[:-1][at] += step * v
            w[-1] += step
        if worst < 1e-3:
            break
    return w


def platt(margins: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """(a, b) of the sigmoid 1 / (1 + exp(-(a m + b))) by Newton steps on smoothed labels."""
    pos, neg = int((y > 0).sum()), int((y <= 0).sum())
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -35, 35)))
        d, h = p - t, np.maximum(p * (1 - p), 1e-9)
        g = np.array([d @ margins + 1e-3 * (a - 1), d.sum()])
        m = np.array([[h @ (margins * margins) + 1e-3, h @ margins], [h @ margins, h.sum() + 1e-9]])
        s = np.linalg.solve(m, g)
        a, b = a - np.clip(s[0], -2, 2), b - np.clip(s[1], -2, 2)
        if np.abs(s).max() < 1e-7:
            break
    return float(max(a, 1e-3)), float(b)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, per_class: int) -> DataFrame:
    """(text, y) of at most ``per_class`` documents of either label.

    Rows whose crc32(doc_id) leaves ``held_out`` modulo ``folds`` never take
    part.  The sample is the smallest hashes of doc_id, the same in every run,
    and is the only thing that the model is fitted on; as it has a fixed
    bound, its ids may be broadcast to the documents.
    """
    seen = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
            .filter(f"y IN (0, 1) AND doc_id IS NOT NULL AND crc32(cast(doc_id AS string)) % {folds} <> {held_out}")
            .groupBy("doc_id").agg(F.max("y").alias("y")))
    order = [F.xxhash64(F.lit(label), "doc_id"), F.col("doc_id")]
    ids = seen.filter("y = 1").orderBy(*order).limit(per_class).unionByName(seen.filter("y = 0").orderBy(*order).limit(per_class))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(ids), "doc_id").select("doc_id", "text", "y")


def held_out_column(folds: int, held_out: int):
    return F.coalesce(F.expr(f"crc32(cast(cast(doc_id AS long) AS string)) % {folds} = {held_out}"), F.lit(False))
