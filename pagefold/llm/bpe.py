"""Byte-level BPE: encoding by corpus-level merge replay, and decoding.

Each text is split by the tokenizer's pattern.  The distinct pieces that a task
has not met before are encoded together: their bytes lie in one array, an
inverted index maps each merge rank to the positions of the pairs that it
would join, and the ranks are replayed from the lowest on; a merge touches its
two neighbours only, whose new pairs are filed under their own rank.  As pieces
are independent and always joined at their lowest rank first, leftmost first,
the ids equal those of encoding every piece alone.

Null texts are empty; empty texts have no tokens.  Memory: one Arrow batch, and
the pieces kept, of at most ``KEPT_BYTES`` (forgotten and learned again when full).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEPT_BYTES = 192 << 20     # pieces and their ids kept in a Python worker, as Python objects
DECODE_IDS = 1 << 20       # ids that are decoded together


def default_vocabulary() -> tuple[str, str]:
    """(path, pattern) of the public multilingual byte-level vocabulary."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


class Codec:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = {r: t for t, r in self.ranks.items()}
        top = max(self.tokens) + 1
        self.blob = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(top)), np.uint8)     # all tokens' bytes
        self.sizes = np.array([len(self.tokens.get(i, b"")) for i in range(top)], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.split = regex.compile(pattern).findall
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        two = np.full(65536, -1, np.int64)
        for t, r in self.ranks.items():
            if len(t) == 2:
                two[t[0] * 256 + t[1]] = r
        self.two = two
        self.pairs: dict[int, int] = {}           # left << 20 | right -> rank
        self.kept: dict[str, bytes] = {}
        self.kept_bytes = 0

    def _rank(self, pair: int) -> int:
        """The rank of a pair of tokens (left << 20 | right), -1 if they do not join."""
        r = self.pairs[pair] = self.ranks.get(self.tokens[pair >> 20] + self.tokens[pair & 0xFFFFF], -1)
        return r

    def replay(self, pieces: list[bytes]) -> list[list[int]]:
        """Token ids of each piece: all merges of all pieces in rank order."""
        flat = b"".join(pieces)
        n = len(flat)
        size = np.array([len(p) for p in pieces], np.int64)
        ends = np.cumsum(size)
        raw = np.frombuffer(flat, np.uint8).astype(np.int64)
        tok = np.array(self.single)[raw].tolist()
        # neighbours; a piece's ends have none (-1, which reads the spare last entry)
        nxt, prv = np.arange(1, n + 2), np.arange(-1, n)
        some = size > 0
        nxt[ends[some] - 1] = -1
        prv[(ends - size)[some]] = -1
        nxt, prv = nxt.tolist(), prv.tolist()
        # the inverted index: rank -> positions of the left token
        index: dict[int, list[int]] = {}
        if n > 1:
            rank = self.two[raw[:-1] * 256 + raw[1:]]
            rank[ends[(ends < n) & some] - 1] = -1
            at = np.flatnonzero(rank >= 0)
            order = np.argsort(rank[at], kind="stable")
            at, by = at[order], rank[at][order]
            cut = np.flatnonzero(np.diff(by, prepend=-1))
            bounds = [*cut[1:].tolist(), len(by)]
            at = at.tolist()
            index = {r: at[x:y] for r, x, y in zip(by[cut].tolist(), cut.tolist(), bounds)}
        heap = list(index)
        heapq.heapify(heap)
        known, unknown, push = self.pairs.get, self._rank, heapq.heappush
        while heap:
            r = heapq.heappop(heap)
            places = index.pop(r, None)
            if places is None:
                continue
            places.sort()
            for done, p in enumerate(places):
                q = nxt[p]
                left = tok[p]
                if q < 0 or left < 0:
                    continue
                pair = left << 20 | tok[q]
                have = known(pair)
                if (unknown(pair) if have is None else have) != r:
                    continue
                tok[p] = r
                tok[q] = -1
                after = nxt[p] = nxt[q]
                lower = False
                if after >= 0:
                    prv[after] = p
                    pair = r << 20 | tok[after]
                    new = known(pair)
                    if new is None:
                        new = unknown(pair)
                    if new >= 0:
                        if new in index:
                            index[new].append(p)
                        else:
                            index[new] = [p]
                            push(heap, new)
                            lower = new <= r
                before = prv[p]
                if before >= 0:
                    pair = tok[before] << 20 | r
                    new = known(pair)
                    if new is None:
                        new = unknown(pair)
                    if new >= 0:
                        if new in index:
                            index[new].append(before)
                        else:
                            index[new] = [before]
                            push(heap, new)
                            lower = lower or new <= r
                if lower:
                    # a rank that must come before this one's other places
                    index[r] = places[done + 1:] + index.get(r, [])
                    push(heap, r)
                    break
        out, lo = [], 0
        for e in ends.tolist():
            out.append([t for t in tok[lo:e] if t >= 0])
            lo = e
        return out

    def learn(self, pieces: Iterable[str]) -> None:
        new = [p for p in pieces if p not in self.kept]
        if not new:
            return
        for p, ids in zip(new, self.replay([p.encode() for p in new])):
            ids = np.array(ids, "<u4").tobytes()
            self.kept[p] = ids
            self.kept_bytes += len(p) + len(ids) + 230

    def encode_bytes(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        step, lo = 1 << 18, 0
        while lo < len(texts):
            hi, chars = lo, 0
            while hi < len(texts) and (hi == lo or chars + len(texts[hi]) <= step):
                chars += len(texts[hi])
                hi += 1
            if self.kept_bytes > KEPT_BYTES:
                self.kept.clear()
                self.kept_bytes = 0
            split = [self.split(t) for t in texts[lo:hi]]
            self.learn(set().union(*split))
            for s in split:
                yield b"".join(map(self.kept.__getitem__, s))
            lo = hi

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return self.decode_all(ids)[0].tobytes()

    def decode_all(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all ids in order, the byte offset of each id and of the end)."""
        size = self.sizes[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(ends[-1]) + np.repeat(self.starts[ids] - ends[:-1], size)
        return self.blob[at], ends


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec for each vocabulary in a Python worker; workers serve many tasks."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode(text: Column, path: str | None = None, pattern: str | None = None) -> Column:
    """array<int> of token ids."""
    p, x = default_vocabulary()
    path, pattern = path or p, pattern or x

    @F.arrow_udf("array<int>")
    def ids(t: pa.Array) -> pa.Array:
        parts = [np.frombuffer(b, "<i4") for b in codec(path, pattern).encode_bytes(t.to_pylist())]
        offsets = np.concatenate([[0], np.cumsum([len(a) for a in parts])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*parts, np.zeros(0, np.int32)]).astype(np.int32)))
    return ids(F.coalesce(text.cast("string"), F.lit("")))


def decode(ids: Column, path: str | None = None, pattern: str | None = None) -> Column:
    """The bytes of an array of token ids (null: empty)."""
    p, x = default_vocabulary()
    path, pattern = path or p, pattern or x

    @F.arrow_udf("binary")
    def back(a: pa.Array) -> pa.Array:
        c = codec(path, pattern)
        return pa.array([c.decode_bytes(np.asarray(v, np.int64)) if v is not None else b"" for v in a.to_pylist()], pa.binary())
    return back(ids)


def encoding_digests(docs: DataFrame, path: str | None = None, pattern: str | None = None, tokens: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and the token ids, if asked
    for) of every row: the ids are digested where they are made, and decoded
    there and then."""
    p, x = default_vocabulary()
    path, pattern = path or p, pattern or x
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", tokens array<int>" * tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            ids, ids_sha, text_sha, n, held = [], [], [], [], 0

            def decode() -> None:
                """Digests of the decoded texts of ``ids`` not decoded yet, in one go."""
                new = ids[len(text_sha):]
                data, at = c.decode_all(np.concatenate(new)) if new else (None, None)
                first = 0
                for one in new:
                    text_sha.append(hashlib.sha256(data[at[first]:at[first + len(one)]]).hexdigest())
                    first += len(one)

            for b in c.encode_bytes([t or "" for t in batch.column(1).to_pylist()]):
                n.append(len(b) // 4)
                ids_sha.append(hashlib.sha256(b).hexdigest())
                ids.append(np.frombuffer(b, "<i4"))
                held += n[-1]
                if held >= DECODE_IDS:
                    decode()
                    held = 0
                    if not tokens:
                        ids = [None] * len(ids)          # digested
            decode()
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            if tokens:
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]).astype(np.int32))))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "tokens"][:len(cols)])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(run, schema))
