"""MinHash near-dedup with odd sketches.

1. Every text becomes its set of distinct 5-word shingles, a MinHash signature
   of ``PERMS`` samples, band keys over ``ROWS`` samples each, and an *odd
   sketch*: the samples folded into a parity bitmap, so that the XOR of two
   bitmaps has about as many ones as the signatures have differing samples.
2. Texts with equal sets collapse to one representative (the smallest doc_id).
3. In each band bucket every representative is paired with the bucket's
   smallest one only (a star, linear in the bucket); the sketch estimate drops
   hopeless pairs and the rest are confirmed on the full shingle sets.
4. Buckets that still hold more than one component are finished exactly: the
   members outside the bucket's main component meet all members of other
   components, in pairs of small blocks, sketch first, full sets after.  Pairs
   inside one component are not looked at and no pair of a group becomes a row.
5. Components of the confirmed links, smallest doc_id first.

Null or word-less texts have an empty set and link with nothing.  Rows that
share a doc_id are one document, linked through each of its texts; the result
has one row per input row all the same.  A row without doc_id links with
nothing, has a null component and is kept.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefold.llm.graph import across, components, staged
from pagefold.llm.textvec import MinHasher, band_keys, mix, set_hash, shingle_sets

PERMS = 128                # MinHash samples
ROWS = 4                   # samples in a band: a pair at 0.75 is missed with probability 5e-6
SKETCH_WORDS = 8           # odd sketch of 512 bits
THRESHOLD = 75             # percent
BLOCK = 64                 # documents in a block of the final comparison, on average
SLACK = 0.20               # sketch estimates below threshold - SLACK are dropped (over 5 sigma)


def odd_sketch(sig: np.ndarray, words: int = SKETCH_WORDS) -> np.ndarray:
    """Parity bitmap of the samples (position and value), as signed longs."""
    bits = words * 64
    at = mix(sig.astype(np.uint64) + (np.arange(1, len(sig) + 1, dtype=np.uint64) << np.uint64(32))) % np.uint64(bits)
    odd = np.bincount(at.astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def max_ones(threshold: float, perms: int = PERMS, words: int = SKETCH_WORDS) -> int:
    """Largest XOR population count of two sketches whose similarity estimate
    is still at least ``threshold``: with d = 2 * perms * (1 - J) toggled bits
    of n, the expected count is n / 2 * (1 - exp(-2 d / n))."""
    n = 64 * words
    d = 2 * perms * (1 - threshold)
    return int(n / 2 * (1 - np.exp(-2 * d / n)))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = MinHasher(PERMS)
    for batch in batches:
        ids = batch.column(0)
        n, sets, keys, sketches = [], [], [], []
        for s in shingle_sets(batch.column(1)):
            sig = hasher.signature(s)
            n.append(len(s))
            sets.append(set_hash(s))
            keys.append(band_keys(sig, ROWS) if len(s) else np.zeros(0, np.int64))
            sketches.append(odd_sketch(sig) if len(s) else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(n, pa.int64()), pa.array(sets, pa.int64()), _lists(keys), _lists(sketches)],
            names=["doc_id", "n_shingles", "set_hash", "bands", "sketch"])


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_hash, bands, sketch of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _signatures, "doc_id long, n_shingles long, set_hash long, bands array<long>, sketch array<long>")


def _confirm(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, np.ndarray] | None = None
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            keep = []
            left = batch.column(2)
            for i, sb in enumerate(shingle_sets(batch.column(3))):
                key = a[i].as_py()
                if last is None or last[0] != key:           # pairs come grouped by their first text
                    last = (key, next(shingle_sets(left.slice(i, 1))))
                sa = last[1]
                both = len(np.intersect1d(sa, sb, assume_unique=True))
                keep.append(100 * both >= threshold * (len(sa) + len(sb) - both) and both > 0)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["a", "b"])
    return run


def confirm(pairs: DataFrame, texts: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full shingle sets are similar enough.

    ``texts`` (doc_id, text) is shuffled by doc_id once; both joins are plain
    equi-joins that adaptive execution can split at a hot hub.
    """
    with_b = pairs.select("a", "b").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    full = with_b.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return full.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(threshold), "a long, b long")


def _hopeful(threshold: int) -> str:
    """SQL: the sizes allow the threshold, and so does the odd sketch estimate."""
    ones = " + ".join(f"bit_count(sketch_a[{i}] ^ sketch_b[{i}])" for i in range(SKETCH_WORDS))
    return (f"100 * least(n_a, n_b) >= {threshold} * greatest(n_a, n_b) "
            f"AND {ones} <= {max_ones(threshold / 100 - SLACK)}")


def _plausible(pairs: DataFrame, about: DataFrame, threshold: int) -> DataFrame:
    side = lambda c: about.select(*(F.col(x).alias(y) for x, y in (("doc_id", c), ("n_shingles", f"n_{c}"), ("sketch", f"sketch_{c}"))))
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(_hopeful(threshold)).select("a", "b")


def _block_links(threshold: int):
    """Links between the outsiders and the other members of one pair of blocks."""
    def run(table: pa.Table) -> pa.Table:
        left = np.asarray(table["outside"].to_numpy(zero_copy_only=False), bool)
        ids, comp = table["id"].to_numpy(), table["component"].to_numpy()
        sketch = table["sketch"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1).view(np.uint64)
        n = table["n_shingles"].to_numpy()
        i, j = np.flatnonzero(left), np.flatnonzero(~left)
        ones = np.zeros((len(i), len(j)), np.int64)
        for w in range(sketch.shape[1]):
            ones += np.bitwise_count(sketch[i, w][:, None] ^ sketch[j, w][None, :])
        hope = (ones <= max_ones(threshold / 100 - SLACK)) & (comp[i][:, None] != comp[j][None, :])
        hope &= 100 * np.minimum(n[i][:, None], n[j][None, :]) >= threshold * np.maximum(n[i][:, None], n[j][None, :])
        p, q = np.nonzero(hope)
        p, q = i[p], j[q]
        found = np.zeros(0, np.int64)
        if len(p):
            used = np.unique(np.concatenate([p, q]))
            text = table["text"].combine_chunks().take(pa.array(used))
            bits, size = _bitsets(list(shingle_sets(text)))
            at = np.zeros(len(ids), np.int64)
            at[used] = np.arange(len(used))
            p2, q2 = at[p], at[q]
            both = np.concatenate([np.bitwise_count(bits[p2[k:k + 2048]] & bits[q2[k:k + 2048]]).sum(axis=1, dtype=np.int64) for k in range(0, len(p2), 2048)])
            found = np.flatnonzero((100 * both >= threshold * (size[p2] + size[q2] - both)) & (both > 0))
            # one link for each pair of components is enough
            _, first = np.unique(np.stack([comp[p[found]], comp[q[found]]]), axis=1, return_index=True) if len(found) else (None, found)
            found = found[first]
        return pa.table({"a": pa.array(ids[p[found]] if len(found) else [], pa.int64()), "b": pa.array(ids[q[found]] if len(found) else [], pa.int64())})
    return run


def _bitsets(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of 64-bit words, a bit for each shingle that two sets or more have."""
    size = np.array([len(s) for s in sets], np.int64)
    _, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(n > 1) - 1
    row = np.repeat(np.arange(len(sets)), size)
    keep = (n > 1)[at]
    width = -(-max(1, int((n > 1).sum())) // 64) * 64
    has = np.zeros((len(sets), width), bool)
    has[row[keep], number[at[keep]]] = True
    return np.packbits(has, axis=1, bitorder="little").view(np.uint64), size


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sig = staged(signatures(texts), "signatures")
    # One row per set: the smallest doc_id (equal sets have equal bands and sketches).
    reps = staged(sig.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_hash", "n_shingles")
                  .agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "sets")
    keyed = reps.select(F.explode("bands").alias("key"), "doc_id")
    about = reps.select("doc_id", "n_shingles", "sketch")

    heads = staged(keyed.groupBy("key").agg(F.min("doc_id").alias("a"), F.count("*").alias("n")).filter("n > 1"), "heads")
    member = staged(keyed.join(heads.select("key", "a"), "key"), "members")         # buckets with two texts or more
    stars = staged(_plausible(member.filter("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct(), about, threshold), "stars")
    links = staged(confirm(stars, texts, threshold), "links")
    comp = components(spark, links)

    payload = about.join(texts, "doc_id").withColumnRenamed("doc_id", "id")
    more = staged(across(member.select("key", F.col("doc_id").alias("id")), comp, payload, _block_links(threshold), BLOCK), "links")
    if not more.isEmpty():
        comp = components(spark, links.unionByName(more))

    reach = reps.select("set_hash", "n_shingles", F.col("doc_id").alias("node")).join(comp, "node", "left").select(
        "set_hash", "n_shingles", F.coalesce("component", "node").alias("component"))
    return (sig.select("doc_id", "n_shingles", "set_hash").join(reach, ["set_hash", "n_shingles"], "left")
            .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def keep_one(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` without those that have a near duplicate of smaller doc_id in
    their group, all columns unchanged.  Rows that share a doc_id are one
    document and stay or go together; rows without doc_id stay."""
    gone = (near_duplicates(docs, threshold).filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__id"))
            .agg(F.max("kept").alias("stays")).filter("NOT stays").select("__id"))
    return docs.join(gone, F.col("__id") == F.col("doc_id").cast("long"), "left_anti")
