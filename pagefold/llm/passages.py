"""Substring dedup: passages repeated across documents, by collinear chaining.

Seeds are 5-word k-mers: of every ``WINDOW`` that follow each other the one of the
smallest hash, so that equal stretches of text have equal seeds and a passage with
an edit every eight words has one between any two edits.  They are dealt by hash into
buckets of packed arrays; in its bucket each seed's occurrences are matched with
those in the smallest doc_id (a star: linear in the occurrences): with the first
one there, and the n-th of a document with the n-th.  As the seeds of one passage can
have their smallest doc_id in different documents that hold parts of it, every
run of ``RUNS`` words whose seeds all recur is matched in the same way, if it begins
with the smallest of ``RUN_WINDOW`` k-mers or lies at an end of a stretch of words that
recur: a run of 50 words has its whole in the document it is matched with.  For two documents the matches are chained in order, with a cost
per skipped word, by a Fenwick tree of prefix maxima; chains are cut out best first.

Only chains that can be a passage meet the texts: a passage of ``MIN_WORDS`` words
has ``MIN_SEEDS`` seeds or more over ``MIN_SPAN`` words, unless its edits leave no
seed in both ``(MIN_WORDS - MIN_SPAN) / 2`` words at its ends; document pairs without
that many are dropped before they are chained.  A chain is extended at both ends as long as
words agree, over small edits, and aligned by a bit-parallel edit distance over words;
passages of at least ``MIN_WORDS`` words that agree in ``IDENTITY`` of them are returned.

Rows without doc_id are left out; null and short texts have no passages; of rows
that share a doc_id each text is read, and none is compared with another.
Passages inside one document are not looked for.  Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefold.llm.graph import staged
from pagefold.llm.textvec import row_words, shingle_positions

K = 5                      # words of a seed
WINDOW = 3                 # k-mers of which one is a seed
RUNS = (24, 50)            # words of longer runs that are matched as a whole
RUN_WINDOW = 8             # k-mers of which one begins runs
BUCKETS, BUCKET_WORDS = 1024, 1 << 21   # buckets of seeds, more of them for more words than this in each
CHUNK_WORDS = 1 << 21      # words whose seeds a task packs together
GAP = 0.02                 # cost of a skipped word on either side; a seed is worth 1
MIN_CHAIN = 1.5            # worth of a chain that is aligned
MARGIN = 48                # words beyond a chain that are read to extend it
HOP, AGREE = 4, 4          # words that an extension may skip, and that must agree beyond
MIN_WORDS, IDENTITY = 50, 0.75
THIN = 10                  # words between the matches on one diagonal that are chained
MIN_CHAIN_MATCHES = 2      # matches of a chain, thinned (see `thinned`)
MIN_SEEDS, MIN_SPAN = 3, 30             # what a document pair, and a chain, must share to be aligned
SIZES = (K, *RUNS)
_U = np.uint64


def _planes(x: np.ndarray) -> bytes:
    """The bytes of ``x`` by significance, so that the high ones, which hardly vary, compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _unplanes(parts: pa.ChunkedArray, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.concatenate([np.ascontiguousarray(np.frombuffer(x.as_py(), np.uint8).reshape(size, -1).T).view(dtype).ravel() for x in parts])


_PACKED = "bucket int, size int, keys binary, docs binary, at binary"


def _packed(parts: list[tuple], size: int, buckets: int) -> pa.RecordBatch:
    """One row a bucket of (key, doc_id, position) arrays; a key is its bucket and 32 bits."""
    key, doc, at = (np.concatenate(c) for c in zip(*parts))
    bucket = ((key >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    key, doc, at, bucket = key[order].astype(np.uint32), doc[order], at[order], bucket[order]
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = [*first[1:].tolist(), len(bucket)]
    spans = list(zip(first.tolist(), ends))
    return pa.RecordBatch.from_arrays([
        pa.array(bucket[first]), pa.array(np.full(len(first), size, np.int32)), *(pa.array([_planes(c[x:y]) for x, y in spans], pa.binary()) for c in (key, doc, at))],
        names=["bucket", "size", "keys", "docs", "at"])


def _least(key: np.ndarray, row: np.ndarray, window: int) -> np.ndarray:
    """Which keys are the smallest of some ``window`` keys that follow each other in a row."""
    chosen = np.zeros(len(key), bool)
    n = len(key) - window + 1
    if n > 0:
        at, least = np.arange(n), key[:n].copy()
        for i in range(1, window):
            lower = key[i:i + n] < least
            at[lower] = np.flatnonzero(lower) + i
            least[lower] = key[i:i + n][lower]
        chosen[at[row[:n] == row[window - 1:]]] = True
    return chosen


def _seed_places(first: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, position, whether runs begin there too) of the seeds of a slice of
    rows of ``MIN_WORDS`` words or more; ``first`` is each row's first word in ``h``."""
    counts = np.diff(first)
    kmers = shingle_positions(h, K)
    row = np.repeat(np.arange(len(counts)), counts)[:len(kmers)]
    at = np.arange(len(kmers)) - first[row]
    inside = (at + K <= counts[row]) & (counts[row] >= MIN_WORDS)
    kmers, row, at = kmers[inside], row[inside], at[inside]
    chosen = _least(kmers, row, WINDOW)
    return kmers[chosen], row[chosen], at[chosen].astype(np.int32), _least(kmers, row, RUN_WINDOW)[chosen]


def _seeds(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for lo, hi, w, h in row_words(batch.column(1)):
                key, row, at, _ = _seed_places(w.first, h)
                if len(key):
                    held.append((key, ids[lo:hi][row], at))
                words += len(h)
                if words >= CHUNK_WORDS and held:
                    yield _packed(held, K, buckets)
                    held, words = [], 0
        if held:
            yield _packed(held, K, buckets)
    return run


def _runs(buckets: int):
    """Keys of the runs of words in which every seed recurs (column ``seeds``: the positions of those that do)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words = {n: [] for n in RUNS}, 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for lo, hi, w, h in row_words(batch.column(1)):
                _, seed_row, seed_at, begins = _seed_places(w.first, h)
                seed = w.first[seed_row] + seed_at
                again = batch.column(2).slice(lo, hi - lo)
                row = np.repeat(np.arange(hi - lo), again.value_lengths().to_numpy())
                at = again.flatten().to_numpy()
                fits = at + K <= w.counts[row]              # rows that share a doc_id have each other's positions
                alone = np.zeros(len(h) + 1, np.int64)
                alone[1 + seed] = 1
                alone[1 + w.first[row[fits]] + at[fits]] = 0
                alone = np.cumsum(alone)                        # seeds that do not recur, up to each word
                sampled = np.zeros(len(h) + 1, bool)
                sampled[seed[begins]] = True
                for n in RUNS:
                    seeds = n - K + 1
                    start = np.flatnonzero(alone[seeds:] == alone[:max(0, len(alone) - seeds)])
                    of = np.searchsorted(w.first, start, "right") - 1
                    inside = (start + n <= w.first[of + 1]) & (w.counts[of] >= MIN_WORDS)
                    start, of = start[inside], of[inside]
                    # starts near a stretch's ends, which words beside it may hide by up to WINDOW, and sampled ones between
                    jump = np.flatnonzero(np.diff(start, prepend=-2, append=-2) != 1)
                    number = np.arange(len(start))
                    place = np.searchsorted(jump, number, "right")
                    near = (number - jump[place - 1] < WINDOW) | (jump[place] - number <= WINDOW) if len(start) else number > 0
                    take = sampled[start] | near
                    start, of = start[take], of[take]
                    if len(start):
                        held[n].append((shingle_positions(h, n)[start], ids[lo:hi][of], (start - w.first[of]).astype(np.int32)))
                words += len(h)
                if words >= CHUNK_WORDS:
                    yield from (_packed(parts, n, buckets) for n, parts in held.items() if parts)
                    held, words = {n: [] for n in RUNS}, 0
        yield from (_packed(parts, n, buckets) for n, parts in held.items() if parts)
    return run


def _meet(table: pa.Table) -> pa.Table:
    """Matches (a, b, place) of one bucket; a place is the positions in b and a (up to 2**29 and 2**32
    words) and the number of the matched size: every occurrence with the first in the smallest doc_id, and the n-th of a document with the n-th there.
    Of seeds, the occurrences in the smallest doc_id come too, matched with themselves."""
    key, doc, at = _unplanes(table["keys"], np.uint32), _unplanes(table["docs"], np.int64), _unplanes(table["at"], np.int32)
    ordered = np.sort(key)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if len(again):
        some = again[np.minimum(np.searchsorted(again, key), len(again) - 1)] == key
        key, doc, at = key[some], doc[some], at[some]
    else:
        key, doc, at = key[:0], doc[:0], at[:0]
    order = np.lexsort((at, doc, key))
    key, doc, at = key[order], doc[order], at[order]
    n = np.arange(len(key))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    own = new.copy()
    own[1:] |= doc[1:] != doc[:-1]
    first = np.maximum.accumulate(np.where(new, n, 0))              # the key's first occurrence in its smallest doc_id
    nth = n - np.maximum.accumulate(np.where(own, n, 0))
    hub = doc == doc[first]
    group = np.cumsum(new) - 1
    copies = np.bincount(group[hub], minlength=group[-1] + 1 if len(group) else 0)[group] if len(group) else n
    other = first + np.minimum(nth, copies - 1)
    b = np.flatnonzero(~hub)
    c = b[other[b] != first[b]]
    size = table["size"][0].as_py()
    shared = np.zeros(len(new), bool)
    if size == K and len(group):
        shared = hub & (np.bincount(group[~hub], minlength=group[-1] + 1) > 0)[group]
    s = np.flatnonzero(shared)
    left, right = np.concatenate([b, c, s]), np.concatenate([first[b], other[c], s])
    place = at[left].astype(np.int64) << 34 | at[right].astype(np.int64) << 2 | SIZES.index(size)
    order = np.lexsort((place, doc[right], doc[left]))              # neighbours compress
    return pa.table({"a": pa.array(doc[right][order]), "b": pa.array(doc[left][order]), "place": pa.array(place[order])})


def chains(at_b: np.ndarray, at_a: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
    """(worth, matches in order) of collinear chains, disjoint in b, best first.

    A chain's worth is its seeds less ``GAP`` for every word between them on
    either side.  That cost splits into a part of each match, so the best
    predecessor of a match is a prefix maximum over the other document's positions.
    All chains come from one pass: they are followed back from the best end not yet
    taken to where a better chain has been.
    """
    left = np.lexsort((at_a, at_b))
    if len(left) < 2:
        return
    b, a = at_b[left], at_a[left]
    db, da = np.diff(b), np.diff(a)
    if db.min() > 0 and da.min() > 0 and GAP * (db + da).max() < 1:      # one chain: every link pays
        worth = len(left) - GAP * float(db.sum() + da.sum())
        if worth >= MIN_CHAIN:
            yield worth, left
        return
    rank = (np.unique(a, return_inverse=True)[1] + 1).tolist()
    size = max(rank)
    tree_best, tree_at = [0.0] * (size + 1), [-1] * (size + 1)
    worth, back = [0.0] * len(left), [-1] * len(left)
    total = (GAP * (b + a)).tolist()
    waiting: list[int] = []
    here = -1
    for i, (bi, ri) in enumerate(zip(b.tolist(), rank)):
        if bi != here:                           # matches at one position do not follow each other
            for j in waiting:
                value, x = worth[j] + total[j], rank[j]
                while x <= size:
                    if tree_at[x] < 0 or tree_best[x] < value:
                        tree_best[x], tree_at[x] = value, j
                    x += x & -x
            waiting, here = [], bi
        best, x, j = 0.0, ri - 1, -1
        while x > 0:
            if tree_at[x] >= 0 and (j < 0 or tree_best[x] > best):
                best, j = tree_best[x], tree_at[x]
            x -= x & -x
        gain = best - total[i] if j >= 0 else 0.0
        worth[i], back[i] = 1.0 + (gain if gain > 0 else 0.0), j if gain > 0 else -1
        waiting.append(i)
    taken = np.zeros(len(left), bool)
    for end in np.argsort(-np.array(worth), kind="stable").tolist():
        if worth[end] < MIN_CHAIN:
            return
        path, i = [], end
        while i >= 0 and not taken[i]:
            path.append(i)
            i = back[i]
        if len(path) < 2:
            continue
        path = np.array(path[::-1])
        own = len(path) - GAP * float(b[end] - b[path[0]] + a[end] - a[path[0]])
        if own >= MIN_CHAIN:
            yield own, left[path]
            # what lies inside the chain's span of b belongs to it; the same span of a may have a later copy in b
            taken[np.searchsorted(b, b[path[0]]):np.searchsorted(b, b[end], "right")] = True


def spelled(at_b: np.ndarray, at_a: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The matches of seeds: of longer runs one in ``THIN`` words of theirs, and the last."""
    parts = [(at_b, at_a)]
    for n in np.unique(size[size > K]):
        of = size == n
        for step in (*range(THIN, n - K, THIN), n - K):
            parts.append((at_b[of] + step, at_a[of] + step))
    both = np.unique(np.concatenate([b.astype(np.int64) << 32 | a for b, a in parts]))
    return both >> 32, both & 0xFFFFFFFF


def thinned(at_b: np.ndarray, at_a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of matches on one diagonal that lie closer than ``THIN`` words, the first, one
    in ``THIN`` words, and the last."""
    both = np.sort((at_b - at_a).astype(np.int64) << 32 | at_b)
    b = both & 0xFFFFFFFF
    a = b - (both >> 32)
    new = np.ones(len(b), bool)
    new[1:] = (np.diff(b) > THIN) | (np.diff(b) != np.diff(a))
    step = b - b[np.maximum.accumulate(np.where(new, np.arange(len(b)), 0))]
    keep = new | np.append(new[1:], True)
    keep[1:] |= step[1:] // THIN != step[:-1] // THIN
    return b[keep], a[keep]


def _chain_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        places, offsets = batch.column(2).flatten().to_numpy(), np.asarray(batch.column(2).offsets)
        pb, pa_, size = (places >> 34).astype(np.int32), (places >> 2 & 0xFFFFFFFF).astype(np.int32), np.array(SIZES)[places & 3]
        base = offsets[0]
        for r, (a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            x, y = offsets[r] - base, offsets[r + 1] - base
            at_b, at_a = thinned(*spelled(pb[x:y], pa_[x:y], size[x:y]))
            for _, path in chains(at_b, at_a):
                m, n = at_b[path], at_a[path]
                if len(path) < MIN_CHAIN_MATCHES or min(m[-1] - m[0], n[-1] - n[0]) + K < MIN_SPAN:
                    continue
                out.append((a, b, int(m[0]), int(m[-1]) + K, int(n[0]), int(n[-1]) + K))
        cols = list(zip(*out)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:2]] + [pa.array(c, pa.int32()) for c in cols[2:]],
                                         names=["a", "b", "from_b", "to_b", "from_a", "to_a"])


def word_edits(x: list[int], y: list[int]) -> int:
    """Edit distance of two word sequences, one machine-word-parallel column a word."""
    if not x or not y:
        return max(len(x), len(y))
    where: dict[int, int] = {}
    for i, w in enumerate(x):
        where[w] = where.get(w, 0) | 1 << i
    full, top = (1 << len(x)) - 1, len(x) - 1
    up, down, score = full, 0, len(x)
    for w in y:
        match = where.get(w, 0)
        zero = (((match & up) + up) ^ up) | match | down
        plus, minus = down | full & ~(zero | up), zero & up
        score += (plus >> top & 1) - (minus >> top & 1)
        plus = plus << 1 | 1
        up, down = (minus << 1 | ~(zero | plus)) & full, zero & plus & full
    return score


def extension(x: np.ndarray, y: np.ndarray, miss: int = 2) -> tuple[int, int]:
    """How far to go on in both word sequences: along words that agree (+1) or
    not (-``miss``), and over up to ``HOP`` words where both go on alike beyond."""
    i = j = 0
    while True:
        n = min(len(x) - i, len(y) - j)
        if n:
            total = np.cumsum(np.where(x[i:i + n] == y[j:j + n], 1, -miss))
            best = int(np.argmax(total))
            if total[best] > 0:
                i, j = i + best + 1, j + best + 1
        hops = sorted(((p + q, p, q) for p in range(HOP + 1) for q in range(HOP + 1) if p + q))
        for _, p, q in hops:
            u, v = x[i + p:i + p + AGREE], y[j + q:j + q + AGREE]
            if len(u) == len(v) == AGREE and (u == v).all():
                i, j = i + p, j + q
                break
        else:
            return i, j


class _Reader:
    """Word hashes of the last text; joins deliver a document's rows together."""

    def __init__(self):
        self.text, self.words = None, np.zeros(0, np.int64)

    def window(self, text: pa.StringScalar, lo: int, hi: int) -> np.ndarray:
        t = text.as_py() or ""
        if t != self.text:
            parts = [h for _, _, _, h in row_words(pa.array([t]))]
            self.text, self.words = t, np.concatenate([*parts, np.zeros(0, np.uint64)]).view(np.int64)
        return self.words[max(0, lo - MARGIN):hi + MARGIN]


def _window_b(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        read = _Reader()
        lo, hi = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        words = [read.window(t, x, y) for t, x, y in zip(batch.column(6), lo, hi)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(words, pa.list_(pa.int64()))],
                                         names=["a", "b", "from_b", "to_b", "from_a", "to_a", "words_b"])


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        read, out = _Reader(), []
        rows = zip(*(batch.column(i).to_pylist() for i in range(6)), batch.column(6), batch.column(7))
        for a, b, from_b, to_b, from_a, to_a, words_b, text_a in rows:
            wb, wa = words_b.values.to_numpy(), read.window(text_a, from_a, to_a)
            ob, oa = max(0, from_b - MARGIN), max(0, from_a - MARGIN)
            sb, eb, sa, ea = from_b - ob, to_b - ob, from_a - oa, to_a - oa
            before, after = extension(wb[:sb][::-1], wa[:sa][::-1]), extension(wb[eb:], wa[ea:])
            sb, sa, eb, ea = sb - before[0], sa - before[1], eb + after[0], ea + after[1]
            if min(eb - sb, ea - sa) < MIN_WORDS:           # a few words short: an edit near an end may hide the last ones
                before, after = extension(wb[:sb][::-1], wa[:sa][::-1], 1), extension(wb[eb:], wa[ea:], 1)
                sb, sa, eb, ea = sb - before[0], sa - before[1], eb + after[0], ea + after[1]
            size = max(eb - sb, ea - sa)
            if min(eb - sb, ea - sa) < MIN_WORDS:
                continue
            edits = word_edits(wb[sb:eb].tolist(), wa[sa:ea].tolist())
            if size - edits >= IDENTITY * size:
                out.append((b, sb + ob, eb + ob, a, sa + oa, ea + oa, edits))
        cols = list(zip(*out)) or [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i in (0, 3) else pa.int32()) for i, c in enumerate(cols)],
                                         names=["doc_id", "start_word", "end_word", "first_doc_id", "first_start", "first_end", "edits"])


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, start_word, end_word, first_doc_id, first_start, first_end, edits:
    a passage of words [start, end) that an earlier document (smaller doc_id) has too."""
    base = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
            .filter("doc_id IS NOT NULL"))
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(BUCKETS, size // (6 * BUCKET_WORDS))
    columns = "a long, b long, place long"
    pos, at = F.shiftright("place", 34), F.shiftright("place", 2).bitwiseAND(F.lit(0xFFFFFFFF))
    words = F.element_at(F.array(*map(F.lit, SIZES)), F.col("place").bitwiseAND(F.lit(3)).cast("int") + 1)
    matches = staged(base.mapInArrow(_seeds(buckets), _PACKED).groupBy("bucket").applyInArrow(_meet, columns), "matches")
    recurring = (matches.groupBy(F.col("b").alias("doc_id")).agg(F.collect_set(pos.cast("int")).alias("seeds"))
                 .filter(f"size(seeds) >= {MIN_SEEDS}"))
    runs = (base.join(recurring, "doc_id").select("doc_id", "text", "seeds").mapInArrow(_runs(buckets), _PACKED)
            .groupBy("bucket", "size").applyInArrow(_meet, columns))
    met = matches.filter("a <> b").unionByName(runs)
    span = lambda c: F.max(c + words) - F.min(c)
    pairs = (met.groupBy("a", "b").agg(F.collect_set("place").alias("m"), F.least(span(pos), span(at)).alias("span"), F.max(words).alias("longest"))
             .filter(f"span >= {MIN_SPAN} AND (size(m) >= {MIN_SEEDS} OR longest > {K})").select("a", "b", "m"))
    found = staged(pairs.mapInArrow(_chain_rows, "a long, b long, from_b int, to_b int, from_a int, to_a int"), "chains")
    cols = ["a", "b", "from_b", "to_b", "from_a", "to_a"]
    left = (found.join(base.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").select(*cols, "text_b")
            .mapInArrow(_window_b, "a long, b long, from_b int, to_b int, from_a int, to_a int, words_b array<long>"))
    return (left.join(base.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").select(*cols, "words_b", "text_a")
            .mapInArrow(_align, "doc_id long, start_word int, end_word int, first_doc_id long, first_start int, first_end int, edits int"))
