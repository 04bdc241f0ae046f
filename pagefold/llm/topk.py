"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Candidates are dealt into blocks of about ``BLOCK`` rows by the hash of their
id, queries into blocks of about ``QUERIES``; every pair of blocks is one
group.  Inside it each dimension is a list sorted by component.  A query reads
all lists in step, from the end where its own component makes the product
largest.  What a candidate has shown so far plus the lists' last values for
what it has not is an upper bound of its score; the exact scores of the best
candidates seen so far give the lower bound of rank k.  Reading stops when few
outsiders (or none) can still reach that bound; their scores are resolved
exactly.  A block's k best meet those of other blocks in a window by query.

Vectors that are null, or hold null or non-finite components, take no part; of a
vec_id given more than once every row counts, and none meets another of them;
vectors meet those of their own length only.  Equal scores rank by smaller vec_id.  Fewer than k
candidates give fewer rows; an empty table gives none.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagefold.llm.graph import staged

BLOCK, QUERIES = 4096, 256
MARGIN = 0.3               # how far below the k-th best an unread row is before bounds are compared
FEW = 0.5                  # share of a block that is resolved without further reading


def integer_vectors(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v) with v = floor(scale * component) of every usable vector."""
    usable = "vec_id IS NOT NULL AND embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
    return (embeddings.filter(usable)
            .select(F.col("vec_id").cast("long").alias("vec_id"), F.expr(f"transform(embedding, x -> floor({scale}D * cast(x AS double)))").alias("v")))


class Lists:
    """A block of vectors as one sorted list per dimension."""

    def __init__(self, x: np.ndarray):
        order = np.argsort(x, axis=0, kind="stable")
        self.x = x
        self.ids = np.ascontiguousarray(order.T)
        self.rows = np.take_along_axis(x, order, 0).astype(np.float64)
        self.values = np.ascontiguousarray(self.rows.T)

    def last(self, q: np.ndarray, upto: int) -> float:
        """Upper bound of the score of a row not met among the first ``upto`` of any list."""
        up, down = self.rows[-upto], self.rows[upto - 1]
        return float(np.where(q > 0, up * q, down * q).sum())

    def upper(self, q: np.ndarray, upto: int) -> np.ndarray:
        """Upper bounds of all rows after reading ``upto`` entries of each list:
        what was read, and the list's last value for what was not."""
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        read = [(self.ids[up, -upto:], (self.values[up, -upto:] - self.values[up, -upto, None]) * q[up, None]),
                (self.ids[down, :upto], (self.values[down, :upto] - self.values[down, upto - 1, None]) * q[down, None])]
        return sum(np.bincount(ids.ravel(), gain.ravel(), minlength=len(self.x)) for ids, gain in read) + self.last(q, upto)

    def floor(self, q: np.ndarray, upper: np.ndarray, k: int) -> float:
        """A lower bound of the k-th best score: k of the 2k most promising rows reach it."""
        best = np.argpartition(upper, len(upper) - 2 * k)[-2 * k:]
        return float(np.partition(self.x[best] @ q, k)[k])

    def candidates(self, q: np.ndarray, k: int) -> np.ndarray:
        """Rows among which are the k best, and all that tie with them."""
        n = len(self.x)
        if n <= 8 * k:
            return np.arange(n)
        upto = max(2 * k, n // 32)
        low = self.floor(q, self.upper(q, upto), k)
        while upto < n:
            # read on until a row never met is well below the k-th best
            while upto < n and self.last(q, upto) > low * MARGIN:
                upto = min(n, upto + n // 16)
            upper = self.upper(q, upto)
            low = max(low, self.floor(q, upper, k))
            can = np.flatnonzero(upper >= low - 0.5)
            if len(can) <= max(4 * k, FEW * n):
                return can
            upto = min(n, upto + n // 8)
        return np.arange(n)


def _block_pair(k: int):
    def run(table: pa.Table) -> pa.Table:
        query = np.asarray(table["query"].to_numpy(zero_copy_only=False), bool)
        ids = table["vec_id"].to_numpy()
        flat = table["v"].combine_chunks()
        m = flat.flatten().to_numpy().reshape(len(ids), -1)
        by_id = np.argsort(ids[~query], kind="stable")          # ties go to the smaller id
        x, xid = m[~query][by_id], ids[~query][by_id]
        out: list[tuple[np.ndarray, ...]] = []
        lists = Lists(x)
        for q, qid in zip(m[query], ids[query]):
            own = int(np.searchsorted(xid, qid, "right") - np.searchsorted(xid, qid))
            can = lists.candidates(q, k + own) if len(x) else np.zeros(0, np.int64)
            can = can[xid[can] != qid]
            score = x[can] @ q
            top = np.lexsort((xid[can], -score))[:k]
            out.append((np.full(len(top), qid), xid[can][top], score[top]))
        cols = [np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out) if out else ((), (), ()))]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.int64())})
    return run


def top_k(vectors: DataFrame, queries: str, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other vectors for every vector
    of (vec_id, v) that satisfies the condition ``queries``."""
    vectors = staged(vectors, "vectors")
    n = vectors.agg(F.count("*").alias("n"), F.count_if(F.expr(queries)).alias("q")).first()
    blocks, parts = max(1, math.ceil(n["n"] / BLOCK)), max(1, math.ceil(n["q"] / QUERIES))
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    own = lambda m, seed: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(m)).cast("int")
    x = vectors.select(own(blocks, 1).alias("block"), each(parts).alias("part"), F.size("v").alias("d"), "vec_id", "v", F.lit(False).alias("query"))
    q = vectors.filter(queries).select(each(blocks).alias("block"), own(parts, 2).alias("part"), F.size("v").alias("d"), "vec_id", "v", F.lit(True).alias("query"))
    near = (x.unionByName(q).groupBy("block", "part", "d")
            .applyInArrow(_block_pair(k), "query_id long, vec_id long, score long"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).filter(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")
