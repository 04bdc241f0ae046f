"""Quality classifier: naive Bayes support vectors over word-shape n-grams.

Each word is reduced to its shape (kinds of its first and last two bytes, case,
length class, whether it repeats the word before it) and to a coarser one.  The
indicators, hashed to ``DIM`` features, are the 1- to 3-grams of shapes that
occur in the text, the 1-grams that make up at least an 8th or half of it, its
length class and its share of distinct words.
Indicators are scaled by the class log-count ratios of the training sample and
a hinge-loss linear model is fitted on them by dual coordinate descent.

Scores depend on the text alone.  A null text is an empty text; it has only the
length feature.  Without two classes to learn from, every score is the
smoothed share of label 1.  Other columns are neither read nor changed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagefold.llm.linear import dual_coordinate_descent, held_out_column, labelled_sample, platt
from pagefold.llm.textvec import mix, row_words

DIM = 1 << 18
PER_CLASS = 2500           # documented bound of the training sample: so many documents of either label
THRESHOLD = 0.3

_KIND = np.zeros(256, np.uint64)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 4
_rest = [i for i in range(128) if _KIND[i] == 0]
_KIND[_rest] = np.arange(5, 5 + len(_rest))
_U = np.uint64


def feature_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """Per row the sorted distinct feature numbers."""
    for lo, hi, w, h in row_words(column, fold=False):
        n = w.ends - w.starts
        if len(n):
            lower = np.concatenate([[0], np.cumsum((_KIND[w.raw] == 1) | (_KIND[w.raw] == 4))])
            upper = np.concatenate([[0], np.cumsum(_KIND[w.raw] == 2)])
            case = (lower[w.ends] > lower[w.starts]).astype(np.uint64) + 2 * np.minimum(upper[w.ends] - upper[w.starts], 2).astype(np.uint64)
            same = np.zeros(len(n), np.uint64)
            same[1:] = h[1:] == h[:-1]
            size = np.searchsorted(np.array([2, 3, 6, 11, 31]), n, "right").astype(np.uint64)
            shape = np.zeros(len(n), np.uint64)
            for part in (_KIND[w.raw[w.starts]], _KIND[w.raw[np.maximum(w.ends - 2, w.starts)]], _KIND[w.raw[w.ends - 1]], case, size, same):
                shape = shape * _U(131) + part
            one = mix(shape + _U(1))
            kind = np.array([0, 0, 1, 2, 0] + [3] * len(_rest), np.uint64)
            first, last = kind[_KIND[w.raw[w.starts]].astype(np.int64)], kind[_KIND[w.raw[w.ends - 1]].astype(np.int64)]
            coarse = (((first * _U(4) + last) * _U(16) + case) * _U(2) + same + _U(1 << 20))
            grams = [one, mix(one[:-1] * _U(3) + one[1:]), mix(one[:-2] * _U(5) + one[1:-1] * _U(3) + one[2:])]
            grams = [(g % _U(DIM - 64)).astype(np.int64) for g in grams]
            both = np.stack([one, mix(coarse)])
        for r in range(hi - lo):
            a, b = int(w.first[r]), int(w.first[r + 1])
            if b == a:
                yield np.array([DIM - 1], np.int64)
                continue
            distinct = len(np.unique(h[a:b])) / (b - a)
            about = [DIM - 2 - min(int(np.log2(b - a)), 20), DIM - 30 - int(distinct * 10)]
            parts = [grams[0][a:b], grams[1][a:max(a, b - 1)], grams[2][a:max(a, b - 2)], about]
            for g in both:
                gram, n = np.unique(g[a:b], return_counts=True)
                for j, share in enumerate((0, 8, 2)):
                    often = gram[n * share >= b - a] if share else gram
                    parts.append((mix(often + _U(j + 1)) % _U(DIM - 64)).astype(np.int64))
            yield np.unique(np.concatenate(parts))


@dataclass
class Model:
    weights: np.ndarray        # ratio * weight of each feature
    squares: np.ndarray        # ratio ** 2, for the length of a scaled row
    bias: float
    a: float
    b: float

    def score(self, column: pa.Array) -> np.ndarray:
        out = np.empty(len(column))
        for i, f in enumerate(feature_sets(column)):
            out[i] = self.weights[f].sum() / np.sqrt(max(self.squares[f].sum(), 1e-12)) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.a * out + self.b, -35, 35)))

    def column(self, text: Column) -> Column:
        @F.arrow_udf("double")
        def quality(t: pa.Array) -> pa.Array:
            return pa.array(self.score(t))
        return quality(F.coalesce(text.cast("string"), F.lit("")))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [f.astype(np.int32) for f in feature_sets(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int32())), batch.column(2)], names=["doc_id", "f", "y"])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, folds: int = 5, held_out: int = 0) -> Model:
    """Fit on a bounded sample of labelled documents (`labelled_sample`); the
    score is calibrated on margins from five-fold cross-fitting."""
    sample = labelled_sample(docs, labels, "quality", folds, held_out, per_class).mapInArrow(_features, "doc_id long, f array<int>, y int").toArrow()
    sets = sorted(zip(sample["doc_id"].to_pylist(), sample["y"].to_pylist(), sample["f"].to_numpy()), key=lambda x: x[:2])
    y = np.array([1 if s[1] else -1 for s in sets])
    rows = [np.asarray(s[2], np.int64) for s in sets]
    if len(set(y.tolist())) < 2:
        share = (int((y > 0).sum()) + 1) / (len(y) + 2)
        return Model(np.zeros(DIM), np.zeros(DIM), 0.0, 1.0, float(np.log(share / (1 - share))))
    folds_ = np.arange(len(y)) % 5
    margins = np.zeros(len(y))
    for k in range(5):                          # margins of documents that their model has not seen
        w, ratio = _train(rows, y, folds_ != k)
        for i in np.flatnonzero(folds_ == k):
            margins[i] = _margin(w, ratio, rows[i])
    a, b = platt(margins, y)
    w, ratio = _train(rows, y, np.ones(len(y), bool))
    return Model(ratio * w[:-1], ratio * ratio, float(w[-1]), a, b)


def _train(rows: list[np.ndarray], y: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weights, log-count ratios) from the rows in use."""
    count = {s: np.ones(DIM) for s in (-1, 1)}
    for i in np.flatnonzero(use):
        count[y[i]][rows[i]] += 1
    ratio = np.log(count[1] / count[1].sum()) - np.log(count[-1] / count[-1].sum())
    ratio[(count[1] == 1) & (count[-1] == 1)] = 0.0        # features that the sample lacks say nothing
    x = [(f, v / np.sqrt(max(float(v @ v), 1e-12))) for f in (rows[i] for i in np.flatnonzero(use)) for v in (ratio[f],)]
    return dual_coordinate_descent(x, y[use], DIM), ratio


def _margin(w: np.ndarray, ratio: np.ndarray, f: np.ndarray) -> float:
    v = ratio[f]
    return float(w[:-1][f] @ v) / np.sqrt(max(float(v @ v), 1e-12)) + float(w[-1])


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    model = fit(docs, labels)
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out_column(5, 0).alias("held_out"), model.column(F.col("text")).alias("score"))
            .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, all columns unchanged."""
    return docs.filter(fit(docs, labels).column(F.col("text")) >= threshold)
