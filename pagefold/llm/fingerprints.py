"""Document fingerprints by MinHash, their likeness, and near pairs by bands.

A fingerprint is the MinHash signature of the text's distinct 5-word shingles
(A-Z folded to lower case), ``PERMS`` components in hexadecimal: 16 bits of each
32-bit minimum after mixing (the minima of long texts are small numbers, whose high
bits are all alike).
Texts without words have the fingerprint of the empty set.  The likeness of
two fingerprints is the share of equal components, an estimate of the Jaccard
similarity of the shingle sets; equal fingerprints have likeness 1, that of
an empty set and another is 0.

`edited_fingerprints` compares every document with its edited text: the last
floor(n / 2) of its n code points replaced by the first as many (or all) of the
next document by ascending (doc_id, text), the first one after the last.  A null
text is empty; a null doc_id sorts first; repeated rows follow each other.  A
single document is its own next one.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefold.llm.graph import across, components, staged
from pagefold.llm.neardup import BLOCK, _block_links, _signatures, confirm
from pagefold.llm.textvec import MinHasher, mix, shingle_sets

PERMS = 128
SLICE_ROWS = 256           # rows whose texts and edited texts are held as Python strings


def fingerprints(texts: pa.Array, hasher: MinHasher) -> list[np.ndarray]:
    return [(mix(hasher.signature(s).astype(np.uint64)) & np.uint64(0xFFFF)).astype("<u2") if len(s) else np.zeros(hasher.k, "<u2") for s in shingle_sets(texts)]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order within a chunk; its last row is the head of the next
    chunk, repeated, and yields nothing itself."""
    hasher = MinHasher(PERMS)
    held: tuple | None = None                           # (chunk, doc_id, text, fingerprint, is_next)
    for batch in (b.slice(i, SLICE_ROWS) for b in batches for i in range(0, b.num_rows, SLICE_ROWS)):
        rows = []
        col = [batch.column(i) for i in range(4)]
        texts = col[2].to_pylist()
        for chunk, doc, text, is_next, fp in zip(col[0].to_pylist(), col[1].to_pylist(), texts, col[3].to_pylist(), fingerprints(col[2], hasher)):
            if held is not None and held[0] == chunk and not held[4]:
                rows.append((*held[1:4], text, fp))
            held = (chunk, doc, text, fp, is_next)
        changed = [edited(r[1], r[3]) for r in rows]
        again = fingerprints(pa.array(changed, pa.large_string()), hasher)
        yield pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in rows], pa.int64()), pa.array([len(r[1]) for r in rows], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
            pa.array([r[2].tobytes().hex() for r in rows], pa.string()), pa.array([e.tobytes().hex() for e in again], pa.string()),
            pa.array([likeness(r[2], e) for r, e in zip(rows, again)], pa.float64()), pa.array([likeness(r[2], r[4]) for r in rows], pa.float64())],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def edited_fingerprints(docs: DataFrame, chunks: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next of every row.

    The order of all documents is cut into ``chunks`` of about equal rows (as
    many as shuffle partitions, if not given) at quantiles of doc_id; a chunk is
    sorted in its own task, and each gets a copy of the next one's first row.
    Only the quantiles and the chunks' first ids pass through the driver.
    """
    spark = docs.sparkSession
    parts = chunks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    cuts = base.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 100 * parts).alias("q")).first()["q"] or []
    cuts = sorted(set(cuts)) if parts > 1 else []
    bounds = np.array(cuts, np.int64)

    @F.arrow_udf("int")
    def chunk(ids: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(bounds, ids.to_numpy(zero_copy_only=False), "left"), pa.int32())

    placed = base.withColumn("chunk", chunk(F.coalesce("doc_id", F.lit(-(1 << 63)))))
    heads = sorted(((r["chunk"], r["id"]) for r in placed.groupBy("chunk").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("some"), F.col("doc_id").alias("id"))).alias("m"))
                    .select("chunk", "m.id").collect()), key=lambda h: h[0])            # one row for each chunk
    before = [(heads[i - 1][0], heads[i][0], heads[i][1]) for i in range(len(heads))]    # the first head follows the last chunk
    moved = spark.createDataFrame(before, "to int, chunk int, head long")
    heirs = (placed.join(F.broadcast(moved), (placed["chunk"] == moved["chunk"]) & placed["doc_id"].eqNullSafe(moved["head"]))
             .select(F.col("to").alias("chunk"), "doc_id", "text", F.lit(True).alias("is_next")))
    every = placed.select("chunk", "doc_id", "text", F.lit(False).alias("is_next")).unionByName(heirs)
    return (every.repartitionById(max(1, len(cuts) + 1), F.col("chunk")).sortWithinPartitions("chunk", "is_next", F.asc_nulls_first("doc_id"), "text")
            .mapInArrow(_compare, schema))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with their text, as it is confirmed, beside what ``neardup`` computes of it."""
    for batch in batches:
        for sig in _signatures(iter([batch])):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(sig.column(c) for c in ("n_shingles", "bands", "sketch"))],
                                             names=["doc_id", "text", "n_shingles", "bands", "sketch"])


def near_links(docs: DataFrame, threshold: int = 75) -> DataFrame:
    """(a, b), a < b: links of every document to the smallest doc_id of each of
    its band buckets, confirmed on the full shingle sets (at least ``threshold``
    percent Jaccard), and, where a bucket then still holds several components,
    links between those.  A spanning set, not all pairs."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter("doc_id IS NOT NULL")
    sig = staged(texts.mapInArrow(_signed, "doc_id long, text string, n_shingles long, bands array<long>, sketch array<long>").filter("n_shingles > 0"), "signatures")
    keyed = sig.select(F.explode("bands").alias("key"), "doc_id").distinct()
    heads = keyed.groupBy("key").agg(F.min("doc_id").alias("a"), F.count("*").alias("n")).filter("n > 1")
    member = staged(keyed.join(heads.select("key", "a"), "key"), "bands")
    pairs = member.filter("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct()
    links = staged(confirm(pairs, texts, threshold).distinct(), "links")
    payload = sig.select(F.col("doc_id").alias("id"), "text", "n_shingles", "sketch")
    more = across(member.select("key", F.col("doc_id").alias("id")), components(docs.sparkSession, links), payload, _block_links(threshold), BLOCK)
    return links.unionByName(more).distinct()
