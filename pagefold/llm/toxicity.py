"""Toxicity by a subsequence string kernel, Nystrom landmarks and a linear SVM.

Words (and runs of single characters, read as one word, so that "i d i o t"
counts) are compared by the gap-weighted kernel over subsequences of three
characters inside five: each occurrence adds ``DECAY`` per skipped character, so
an inserted character or a gap weakens a match and does not break it.  Letters
are folded, look-alike digits read as letters, other signs left out, and words
have edge marks.

Training reads a bounded sample of labelled documents.  The words of clean
documents are negative, but for those that at least ``ODDS`` times as many toxic
documents have: a clean document may quote an insult or be labelled wrongly.  Of
a toxic document at least one word is toxic, and its likeliest words are chosen
anew in each round (first by log-count ratios of the subsequences, then by the
last model).  Words are mapped to the Nystrom features of ``LANDMARKS`` words, and
a hinge-loss model is fitted by dual coordinate descent.  As the kernel is an inner product of subsequence
counts, the fitted model folds into one weight per subsequence, which scores
whole texts exactly at a few additions per character.

The score of a text is the calibrated margin of its worst word.  Null and empty
texts have the margin of a word without subsequences.  Without two classes to
learn from, every score is the smoothed share of label 1.  Only the text is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagefold.llm.linear import dual_coordinate_descent, held_out_column, labelled_sample, platt
from pagefold.llm.textvec import Words, mix, slices, span_hashes, text_bytes

PER_CLASS = 1500           # documented bound of the training sample: so many documents of either label
LANDMARKS = 512
NEGATIVES = 2000           # words of clean documents that each round adds
DECAY = 0.6
SPAN = 5
THRESHOLD = 0.7
ROUNDS = 3
WORST = 5                  # words of a toxic document that may be taken as positive
ODDS = 30                  # a word of clean documents is positive only if so many times as many toxic ones have it

_CLASSES = 32              # 1-26 letters, 27-29 bytes of other letters, 30 digits, 31 a word's edge, 0 left out
_EDGE = 31
_CLASS = np.zeros(256, np.int32)
_CLASS[48:58] = 30
_CLASS[97:123] = _CLASS[65:91] = np.arange(1, 27)
for _sign, _letter in zip(b"013457@$", b"oieastas"):     # fixed values: look-alike signs
    _CLASS[_sign] = _letter - 96
_CLASS[128:192] = 27 + np.arange(64) % 3
_CLASS[192:] = 0                                         # lead bytes carry little
_CLASS[[32, 9, 10, 11, 12, 13]] = 0
_STEPS = [(d1, d2, DECAY ** (d2 - 2)) for d2 in range(2, SPAN) for d1 in range(1, d2)]
_DIM = _CLASSES ** 3


class Units:
    """The words of a slice of rows as one array of character classes, each
    word between edge marks; ``start`` per word, ``first`` word per row."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        w = Words(raw, offsets)
        n = len(w.starts)
        size = w.ends - w.starts
        single = (size == 1) | ((size == 2) & (raw[w.starts] >= 192)) if n else np.zeros(0, bool)
        head = np.zeros(n, bool)
        head[w.first[:-1][w.first[:-1] < n]] = True
        joined = np.zeros(n, bool)
        joined[1:] = single[1:] & single[:-1] & ~head[1:]
        unit = np.cumsum(~joined) - 1
        self.n = int(unit[-1]) + 1 if n else 0
        self.first = np.concatenate([unit, [self.n]])[w.first]
        inside = np.zeros(len(raw) + 1, np.int32)
        inside[w.starts] += 1
        word = np.cumsum(inside[:-1]) - 1
        code = _CLASS[raw]
        kept = np.flatnonzero(code)
        of = unit[word[kept]] if n else np.zeros(0, np.int64)
        self.codes = np.full(len(kept) + 2 * self.n, _EDGE, np.int32)
        self.codes[np.arange(len(kept)) + 2 * of + 1] = code[kept]
        self.size = np.bincount(of, minlength=self.n) + 2
        self.start = np.concatenate([[0], np.cumsum(self.size)])[:-1].astype(np.int64)
        self.unit = np.repeat(np.arange(self.n), self.size)
        self.words = w
        self.joined = joined

    def triples(self) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """(valid, subsequence number, weight) by the gaps; ``valid`` says where
        the subsequence that begins there stays inside its word (three equal
        characters say nothing)."""
        c, u = self.codes, self.unit
        for d1, d2, weight in _STEPS:
            n = max(0, len(c) - d2)
            inside = (u[:n] == u[d2:d2 + n]) & ((c[:n] != c[d2:d2 + n]) | (c[:n] != c[d1:d1 + n]))
            yield inside, (c[:n] * _CLASSES + c[d1:d1 + n]) * _CLASSES + c[d2:d2 + n], weight

    def norms(self) -> np.ndarray:
        """Length of each word's subsequence vector (one coordinate an occurrence)."""
        total = np.zeros(self.n)
        for _, d2, weight in _STEPS:
            total += np.maximum(self.size - d2, 0) * weight * weight
        return np.sqrt(np.maximum(total, 1e-9))

    def scores(self, v: np.ndarray) -> np.ndarray:
        """Normalised inner product of each word with subsequence weights."""
        if not self.n:
            return np.zeros(0)
        at = np.zeros(len(self.codes), np.float32)
        for valid, number, weight in self.triples():
            at[:len(valid)] += np.where(valid, v[number], 0) * np.float32(weight)
        return np.add.reduceat(at, self.start, dtype=np.float64) / self.norms()

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, subsequence, normalised weight) of all occurrences."""
        norm = self.norms()
        u, f, w = [], [], []
        for valid, number, weight in self.triples():
            at = np.flatnonzero(valid)
            u.append(self.unit[at].astype(np.int32))
            f.append(number[at])
            w.append((weight / norm[self.unit[at]]).astype(np.float32))
        return np.concatenate(u), np.concatenate(f), np.concatenate(w)


def row_margins(column: pa.Array, v: np.ndarray, bias: float) -> np.ndarray:
    """The largest margin of any word of each row."""
    raw, off = text_bytes(column)
    out = np.full(len(off) - 1, bias)
    for lo, hi in slices(off):
        units = Units(raw[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
        s = units.scores(v)
        some = np.flatnonzero(np.diff(units.first) > 0)
        if len(some):
            out[lo + some] = np.maximum.reduceat(s, units.first[some]) + bias
    return out


@dataclass
class Model:
    v: np.ndarray
    bias: float
    a: float
    b: float

    def score(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * row_margins(column, self.v, self.bias) + self.b, -35, 35)))

    def column(self, text: Column) -> Column:
        @F.arrow_udf("double")
        def toxicity(t: pa.Array) -> pa.Array:
            return pa.array(self.score(t))
        return toxicity(F.coalesce(text.cast("string"), F.lit("")))


def span_mix(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """One number for a word and what stands before it."""
    return mix(before + word.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class _Sample:
    """Distinct words of the sample's documents and where they occur."""

    def __init__(self, texts: list[str], y: np.ndarray):
        self.y = y
        column = pa.array(texts, pa.large_string())
        raw, off = text_bytes(column)
        doc, key, before, chars = [], [], [], []
        for lo, hi in slices(off):
            u = Units(raw[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
            h = span_hashes(u.codes.astype(np.uint8), u.start, u.start + u.size)
            # what stands before a word tells copies of one sentence from new uses of the word
            p = np.concatenate([[np.uint64(0)], h[:-1]]) if u.n else h
            doc.append(np.repeat(np.arange(lo, hi), np.diff(u.first)))
            key.append(h)
            before.append(p)
            chars.append((u.codes.astype(np.uint8), u.size))
        doc, key, before = np.concatenate(doc), np.concatenate(key), np.concatenate(before)
        codes, size = np.concatenate([c for c, _ in chars]), np.concatenate([s for _, s in chars])
        start = np.cumsum(size) - size
        distinct, first, word = np.unique(key, return_index=True, return_inverse=True)
        use = np.unique(doc * len(distinct) + word)
        self.doc, self.word = use // max(1, len(distinct)), use % max(1, len(distinct))
        _, new = np.unique(span_mix(before, word) * np.uint64(2) + (y[doc] > 0), return_index=True)
        contexts, label = word[new], y[doc[new]]
        self.contexts = {s: np.bincount(contexts[label == s], minlength=len(distinct)) for s in (-1, 1)}
        self.codes, self.start, self.size = codes, start[first], size[first]
        self.units = _units(codes, self.start, self.size)
        self.n = len(distinct)

    def counts(self, uses: np.ndarray) -> np.ndarray:
        """Weight of every subsequence over all words, each counted ``uses`` times."""
        out = np.zeros(_DIM)
        share = uses / self.units.norms()
        for valid, number, weight in self.units.triples():
            at = np.flatnonzero(valid)
            out += np.bincount(number[at], share[self.units.unit[at]] * weight, minlength=_DIM)
        return out

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return _units(self.codes, self.start[words], self.size[words]).entries()

    def disturbed(self, words: np.ndarray, times: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """Codes and sizes of the words, each ``times`` over with a letter inserted."""
        out, size = [], []
        for w in words:
            c = self.codes[self.start[w]:self.start[w] + self.size[w]]
            if len(c) < 6:                      # three letters and less say little once disturbed
                continue
            for at in rng.choice(np.arange(2, len(c) - 1), min(times, len(c) - 3), replace=False):
                out.append(np.insert(c, at, rng.integers(1, 27)))
                size.append(len(c) + 1)
        return np.concatenate([*out, np.zeros(0, np.uint8)]).astype(np.uint8), np.array(size, np.int64)


def _columns(entries: tuple[np.ndarray, np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """The words' vectors as columns, one row per subsequence."""
    u, f, w = entries
    out = np.zeros((_DIM, n), np.float32)
    np.add.at(out, (f, u), w)
    return out


def _kernel(entries: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, landmarks: np.ndarray) -> np.ndarray:
    """Kernel of words, given by their entries, with landmark vectors (columns)."""
    u, f, w = entries
    out = np.zeros((n, landmarks.shape[1]), np.float32)
    step = 1 << 13
    for k in range(0, len(u), step):
        order = np.argsort(u[k:k + step], kind="stable")
        uu = u[k:k + step][order]
        rows = landmarks[f[k:k + step][order]] * w[k:k + step][order, None]
        first = np.flatnonzero(np.concatenate([[True], uu[1:] != uu[:-1]]))
        out[uu[first]] += np.add.reduceat(rows, first, axis=0)
    return out


def _units(codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> Units:
    """Words given as spans of ``codes``."""
    at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    u = Units.__new__(Units)
    u.codes, u.size, u.n = codes[at].astype(np.int32), size, len(size)
    u.unit = np.repeat(np.arange(len(size)), size)
    u.start = np.cumsum(size) - size
    return u


def _fit_words(s: _Sample, docs: np.ndarray) -> tuple[np.ndarray, float]:
    """Subsequence weights and bias from the documents in ``docs`` (a mask)."""
    on = docs[s.doc]
    doc, word = s.doc[on], s.word[on]
    bad = s.y[doc] > 0
    having = {1: np.bincount(word[bad], minlength=s.n), -1: np.bincount(word[~bad], minlength=s.n)}
    count = {k: s.counts(s.contexts[k] * (having[k] > 0)) + 0.5 for k in (-1, 1)}
    barred = (having[-1] > 0) & (having[1] < ODDS * having[-1])
    v = np.log(count[1] / count[1].sum()) - np.log(count[-1] / count[-1].sum())
    score, bias = s.units.scores(v), 0.0
    clean = np.flatnonzero(barred)
    rng = np.random.default_rng(11)
    neg = rng.choice(clean, min(len(clean), NEGATIVES), replace=False) if len(clean) else clean
    spread = np.log1p(s.contexts[1])
    for step in range(ROUNDS):
        # a toxic document's likeliest words that are not those of clean documents; beyond
        # the first, only words that toxic documents use in several places
        score = np.where(barred, -np.inf, score + spread)
        order = np.lexsort((-score[word[bad]], doc[bad]))
        d, wd = doc[bad][order], word[bad][order]
        nth = np.arange(len(d)) - np.searchsorted(d, d)
        top = wd[np.isfinite(score[wd]) & ((nth == 0) | (nth < WORST) & (s.contexts[1][wd] > 2))]
        pos, uses = np.unique(top, return_counts=True)
        if not len(pos) or not len(clean):
            break
        # clean words that now look worst join the negatives for good
        now = s.units.scores(v)
        hard = clean[np.argsort(-now[clean], kind="stable")[:NEGATIVES]]
        neg = np.union1d(neg, hard)
        often = pos[np.argsort(-(uses + 1e-3 * s.contexts[1][pos]), kind="stable")]
        marks = np.concatenate([often[:LANDMARKS // 2], hard[:LANDMARKS - min(len(often), LANDMARKS // 2)]])
        landmarks = _columns(s.of(marks), len(marks))
        values, vecs = np.linalg.eigh(landmarks.T @ landmarks)
        half = vecs * (1 / np.sqrt(np.maximum(values, 1e-4)))
        codes, size = s.disturbed(often[:LANDMARKS], 2, rng)
        extra = _units(codes, np.cumsum(size) - size, size).entries()
        words = np.concatenate([pos, neg])
        z = np.concatenate([_kernel(s.of(words), len(words), landmarks), _kernel(extra, len(size), landmarks)]) @ half
        y = np.concatenate([np.ones(len(pos)), -np.ones(len(neg)), np.ones(len(size))])
        weight = np.concatenate([np.minimum(uses, s.contexts[1][pos]).clip(1, 10), np.ones(len(neg) + len(size))])
        wt = dual_coordinate_descent([(slice(None), r) for r in z], y, z.shape[1], c=2.0, epochs=15, weight=weight)
        v = (landmarks @ (half @ wt[:-1])).astype(np.float32)
        bias = float(wt[-1])
        score = s.units.scores(v)
    return v.astype(np.float32), bias


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, folds: int = 3, held_out: int = 1) -> Model:
    """Fit on a bounded sample of labelled documents; the score is calibrated
    on documents that the words' model had not seen (two-fold)."""
    sample = labelled_sample(docs, labels, "toxic", folds, held_out, per_class).toArrow()
    rows = sorted(zip(sample["doc_id"].to_pylist(), sample["y"].to_pylist(), sample["text"].to_pylist()))
    y = np.array([1 if r[1] else -1 for r in rows])
    if len(set(y.tolist())) < 2:
        share = (int((y > 0).sum()) + 1) / (len(y) + 2)
        return Model(np.zeros(_DIM, np.float32), 0.0, 1.0, float(np.log(share / (1 - share))))
    s = _Sample([r[2] for r in rows], y)
    half = np.arange(len(y)) % 2 == 0
    margins = np.zeros(len(y))
    texts = pa.array([r[2] for r in rows], pa.large_string())
    for part in (half, ~half):
        v, bias = _fit_words(s, part if len(set(y[part].tolist())) == 2 else np.ones(len(y), bool))
        margins[~part] = row_margins(texts.filter(pa.array(~part)), v, bias)
    a, b = platt(margins, y)
    v, bias = _fit_words(s, np.ones(len(y), bool))
    return Model(v, bias, a, b)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    model = fit(docs, labels)
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out_column(3, 1).alias("held_out"), model.column(F.col("text")).alias("score"))
            .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")))
