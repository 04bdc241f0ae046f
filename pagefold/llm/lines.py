"""Line dedup by a segment-partition edit join.

Two lines are near when their edit distance over UTF-8 bytes is at most
``EDITS``.  A line of n bytes is cut into EDITS + 1 even segments; a line that is
near it must contain one of them unchanged, at a place that the segment's number
and the two lengths bound.  So each line files its segments under (length,
number, content), and looks up the substrings that could match lines of its own
length or up to EDITS bytes shorter.  In each bucket every line is paired with
one line that filed a segment there (linear in the bucket); pairs are verified by
a banded bit-parallel edit distance, many at a time; buckets that then still hold
several classes are finished in small blocks (`graph.across`).  Classes are the
components of near lines, and the first line by (doc_id, line number) is kept.

Lines end at line feeds.  Empty lines are not lines and are never removed; lines
shorter than ``MIN_BYTES`` are duplicates only if equal.  A null text has no
lines; a null doc_id sorts first; rows that repeat doc_id and text share their
fate.  Equal lines are told by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefold.llm.graph import across, components, staged
from pagefold.llm.textvec import Rolling, mix, slices, text_bytes

EDITS = 2
MIN_BYTES = 24
BLOCK = 64                 # lines in a block of the final comparison, on average

_U = np.uint64


def line_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, line number, start, end) of all non-empty lines."""
    n = len(off) - 1
    feeds = np.flatnonzero(raw == 10)
    first = np.arange(n) + np.searchsorted(feeds, off[:-1])
    total = n + len(feeds)
    at_row = np.zeros(total, bool)
    at_row[first] = True
    start = np.zeros(total, np.int64)
    start[at_row], start[~at_row] = off[:-1], feeds + 1
    last = np.zeros(total, bool)
    last[np.append(first[1:], total)[:n] - 1] = True
    end = np.zeros(total, np.int64)
    end[last], end[~last] = off[1:], feeds
    row = np.cumsum(at_row) - 1
    number = np.arange(total) - first[row] if n else np.zeros(0, np.int64)
    some = end > start
    return row[some], number[some], start[some], end[some]


def _segment(length: np.ndarray, i: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, size) of segment i of k in lines of the given length."""
    base, plain = length // k, k - length % k
    return i * base + np.maximum(0, i - plain), base + (i >= plain)


def join_keys(roll: Rolling, start: np.ndarray, n: np.ndarray, edits: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(which lines, their keys, whether the key files a segment) in turn."""
    k = edits + 1

    def key(at: np.ndarray, size: np.ndarray, length: np.ndarray, i: int) -> np.ndarray:
        return mix(roll.spans(at, at + size) + length.astype(np.uint64) * _U(0x9E3779B97F4A7C15) + _U(i))

    for shorter in range(edits + 1):
        length = n - shorter
        for i in range(k):
            p, size = _segment(length, i, k)
            if shorter == 0:
                yield np.arange(len(n)), key(start + p, size, length, i), True
            # seen from either end, the edits before and after the segment bound its move
            low, high = max(-i, shorter - (edits - i)), min(i, shorter + (edits - i))
            for move in range(low, high + 1):
                if shorter == 0 and move == 0:
                    continue
                ok = np.flatnonzero((length >= MIN_BYTES) & (p + move >= 0) & (p + move + size <= n))
                yield ok, key(start[ok] + p[ok] + move, size[ok], length[ok], i), False


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, off = text_bytes(batch.column(2))
        for lo, hi in slices(off):
            part = raw[off[lo]:off[hi]]
            row, number, start, end = line_spans(part, off[lo:hi + 1] - off[lo])
            h = Rolling(part).spans(start, end).view(np.int64)
            at = pa.array(row + lo)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(number.astype(np.int32)), pa.array(h)],
                                             names=["doc_id", "row", "line_no", "line"])


def _keys(edits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_bytes(batch.column(0))
            for lo, hi in slices(off):
                part = raw[off[lo]:off[hi]]
                _, _, start, end = line_spans(part, off[lo:hi + 1] - off[lo])
                roll = Rolling(part)
                h, first = np.unique(roll.spans(start, end), return_index=True)
                long = (end - start)[first] >= MIN_BYTES
                h, start, n = h[long].view(np.int64), start[first][long], (end - start)[first][long]
                for at, key, files in join_keys(roll, start, n, edits):
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(at), not files)), pa.array(h[at])],
                                                     names=["key", "probe", "line"])
    return run


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, probe, line): pairs of each bucket's first filed line
    with its other lines.  Only the bucket's first line is held."""
    held: tuple[int, int, bool] | None = None
    for batch in batches:
        key, probe, line = (np.asarray(batch.column(i).to_numpy(zero_copy_only=False)) for i in range(3))
        if not len(key):
            continue
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        new[0] = held is None or held[0] != key[0]
        first = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        hub = line[np.maximum(first, 0)]
        filed = ~probe.astype(bool)[np.maximum(first, 0)]
        if not new[0]:
            run = first < 0
            hub[run], filed[run] = held[1], held[2]
        held = (int(key[-1]), int(hub[-1]), bool(filed[-1]))
        out = np.flatnonzero(filed & (hub != line))
        yield pa.RecordBatch.from_arrays([pa.array(key[out]), pa.array(hub[out]), pa.array(line[out])], names=["key", "a", "b"])


def within_edits(left: list[bytes], right: list[bytes], edits: int = EDITS) -> np.ndarray:
    """Whether the edit distance of each pair is at most ``edits``.

    Bit-parallel over a band of 2 edits + 1 diagonals: bit b of a word stands for
    row j + b - edits of column j, so the band moves down with the columns; one
    numpy operation advances all pairs.  Pairs are taken in groups of bounded
    bytes, by growing length.
    """
    n = np.array([len(x) for x in left], np.int64)
    m = np.array([len(x) for x in right], np.int64)
    out = np.zeros(len(n), bool)
    near = np.flatnonzero(np.abs(n - m) <= edits)
    near = near[np.argsort(m[near], kind="stable")]
    lo = 0
    while lo < len(near):
        hi = lo + 1
        while hi < len(near) and (hi - lo + 1) * (int(m[near[hi]]) + 1) <= 1 << 22:
            hi += 1
        at = near[lo:hi]
        out[at] = _band([left[i] for i in at], [right[i] for i in at], n[at], m[at], edits) <= edits
        lo = hi
    return out


def _band(left: list[bytes], right: list[bytes], n: np.ndarray, m: np.ndarray, edits: int) -> np.ndarray:
    width = 2 * edits + 1
    full = (1 << width) - 1
    size = int(m.max()) + width
    a = np.zeros((len(left), size + edits), np.int16)       # 0: beside the text
    b = np.full((len(right), int(m.max())), -1, np.int16)
    for i, (x, y) in enumerate(zip(left, right)):
        a[i, edits:edits + len(x)] = np.frombuffer(x, np.uint8).astype(np.int16) + 1
        b[i, :len(y)] = np.frombuffer(y, np.uint8).astype(np.int16) + 1
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    vp = np.full(len(left), full & ~((1 << (edits + 1)) - 1), np.int32)    # below the diagonal: +1 a row
    vn = np.full(len(left), (1 << (edits + 1)) - 1, np.int32)              # above it: -1 a row
    score = np.zeros(len(left), np.int64)
    result = np.full(len(left), edits + 1, np.int64)
    done = 0                                                # pairs come by growing m
    while done < len(m) and m[done] == 0:
        result[done] = n[done]
        done += 1
    for j in range(b.shape[0]):
        x = np.zeros(len(left) - done, np.int32)
        for bit in range(width):                            # row j + bit - edits of the left text
            x |= (a[j + bit, done:] == b[j, done:]).astype(np.int32) << bit
        p, q = (vp[done:] >> 1) | (1 << (width - 1)), vn[done:] >> 1
        d0 = ((((x & p) + p) ^ p) | x | q) & full
        hp, hn = (q | ~(d0 | p)) & full, d0 & p
        hp = ((hp << 1) | 1) & full
        vp[done:], vn[done:] = ((hn << 1) | ~(d0 | hp)) & full, d0 & hp
        score[done:] += 1 - ((d0 >> edits) & 1)
        end = int(np.searchsorted(m, j + 1, "right"))
        for i in range(done, end):                          # from row m down or up to row n
            s = int(score[i])
            for r in range(int(n[i] - m[i])):
                s += (int(vp[i]) >> (edits + 1 + r) & 1) - (int(vn[i]) >> (edits + 1 + r) & 1)
            for r in range(int(m[i] - n[i])):
                s -= (int(vp[i]) >> (edits - r) & 1) - (int(vn[i]) >> (edits - r) & 1)
            result[i] = s
        done = end
        if done == len(m):
            break
    return result


def _verify(edits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = within_edits(batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).cast(pa.binary()).to_pylist(), edits)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(ok)) for i in range(2)], names=["a", "b"])
    return run


def _block_links(edits: int):
    def run(table: pa.Table) -> pa.Table:
        out = np.asarray(table["outside"].to_numpy(zero_copy_only=False), bool)
        ids, comp = table["id"].to_numpy(), table["component"].to_numpy()
        text = table["text"].combine_chunks().cast(pa.binary()).to_pylist()
        n = np.array([len(t) for t in text])
        i, j = np.flatnonzero(out), np.flatnonzero(~out)
        p, q = np.nonzero((comp[i][:, None] != comp[j][None, :]) & (np.abs(n[i][:, None] - n[j][None, :]) <= edits))
        p, q = i[p], j[q]
        ok = within_edits([text[x] for x in p], [text[x] for x in q], edits)
        return pa.table({"a": pa.array(ids[p[ok]], pa.int64()), "b": pa.array(ids[q[ok]], pa.int64())})
    return run


def _base(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))


def line_classes(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """doc_id, row, line_no, class_doc_id, class_line_no, kept of every line of
    every row; ``row`` is the text's hash."""
    spark = docs.sparkSession
    base = _base(docs)
    lines = staged(base.mapInArrow(_lines, "doc_id long, row long, line_no int, line long"), "lines")
    first = staged(lines.groupBy("line").agg(F.min(F.struct("doc_id", "line_no", "row")).alias("f")), "first")

    keyed = base.select("text").mapInArrow(_keys(edits), "key long, probe boolean, line long")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stars = staged(keyed.repartition(parts, "key").sortWithinPartitions("key", "probe", "line")
                   .mapInArrow(_stars, "key long, a long, b long").distinct(), "stars")
    member = stars.select("key", F.col("a").alias("id")).unionByName(stars.select("key", F.col("b").alias("id"))).distinct()

    wanted = (member.select(F.col("id").alias("line")).distinct().join(first, "line")
              .groupBy(F.col("f.doc_id").alias("of"), F.col("f.row").alias("of_row")).agg(F.collect_list(F.struct("line", F.col("f.line_no").alias("no"))).alias("wanted")))
    texts = staged(base.join(wanted, F.col("of").eqNullSafe(F.col("doc_id")) & (F.col("of_row") == F.col("row")))
                   .select("doc_id", "row", "wanted", F.split("text", "\n").alias("parts")).select("parts", F.explode("wanted").alias("w"))
                   .select(F.col("w.line").alias("id"), F.expr("parts[w.no]").alias("text")).dropDuplicates(["id"]), "texts")
    pairs = stars.select("a", "b").distinct()
    side = lambda c: texts.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}"))
    links = staged(pairs.join(side("a"), "a").join(side("b"), "b").filter(f"abs(octet_length(text_a) - octet_length(text_b)) <= {edits}")
                   .select("a", "b", "text_a", "text_b").mapInArrow(_verify(edits), "a long, b long"), "links")
    comp = components(spark, links)
    more = staged(across(member, comp, texts, _block_links(edits), BLOCK), "links")
    if not more.isEmpty():
        comp = components(spark, links.unionByName(more))

    classes = first.join(comp, F.col("line") == F.col("node"), "left").select("line", "f", F.coalesce("component", "line").alias("class"))
    heads = classes.groupBy("class").agg(F.min("f").alias("head"))
    return (lines.join(classes.join(heads, "class").select("line", "head"), "line")
            .select("doc_id", "row", "line_no", F.col("head.doc_id").alias("class_doc_id"), F.col("head.line_no").alias("class_line_no"),
                    (F.col("head.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("head.line_no") == F.col("line_no")) & (F.col("head.row") == F.col("row"))).alias("kept")))


def dedup_lines(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """``docs`` without repeated lines; ``n_chars``, if there is such a column,
    follows the text.  Documents that lose all their lines are removed; the
    others, also those without any line, stay."""
    gone = (line_classes(docs, edits).filter("NOT kept").groupBy(F.col("doc_id").alias("__id"), F.col("row").alias("__row"))
            .agg(F.collect_set("line_no").alias("__gone")))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.join(gone, F.col("__id").eqNullSafe(F.col("doc_id").cast("long")) & (F.col("__row") == F.xxhash64(text)), "left")
    out = out.withColumn("__text", F.expr("CASE WHEN __gone IS NULL THEN text ELSE array_join(filter(split(text, '\\n'), (x, i) -> NOT array_contains(__gone, i)), '\\n') END"))
    out = out.filter("__gone IS NULL OR replace(__text, '\\n', '') <> ''")
    new = {"text": F.col("__text"), "n_chars": F.when(F.col("__gone").isNull(), F.col("n_chars")).otherwise(F.length("__text")).cast(docs.schema["n_chars"].dataType)
           if "n_chars" in docs.columns else None}
    return out.select(*((new[c] if new.get(c) is not None else F.col(c)).alias(c) for c in docs.columns))
