"""Vectorised views of Arrow text columns: words, rolling word hashes, shingles.

Everything works on the UTF-8 bytes of many rows at once, so tasks spend
their time in numpy and not in per-word Python.  A word is a maximal run of
bytes other than space and \\x09-\\x0D; A-Z are folded to lower case on request.
Null texts are read as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20      # rows are handled in slices of about this many bytes
SHINGLE_WORDS = 5

_U = np.uint64
_M1, _M2 = _U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)

_rng = np.random.default_rng(20240607)
_TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_FOLDED = _TABLE.copy()
_FOLDED[65:91] = _TABLE[97:123]
_LANES = _rng.integers(1, 1 << 63, SHINGLE_WORDS + 1, dtype=np.uint64) | _U(1)

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

_powers: dict[int, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    h = h ^ (h >> _U(33))
    h = h * _M1
    h ^= h >> _U(33)
    h *= _M2
    h ^= h >> _U(33)
    return h


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        p = np.empty(size, np.uint64)
        p[0] = 1
        done = 1
        while done < size:                      # doubling: p[k:2k] = p[:k] * base**k
            step = min(done, size - done)
            p[done:done + step] = p[:step] * _U(pow(base, done, 1 << 64))
            done += step
        if size <= 4 * SLICE_BYTES:             # one huge text must not pin its tables
            _powers[base] = p
        return p
    return have


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; nulls are empty."""
    arr = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, np.int64)[arr.offset:arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most about ``limit`` bytes (a longer row stands alone)."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


class Words:
    """Words of a slice of rows: byte ``starts``/``ends`` and ``first`` (the
    index of each row's first word, one entry more than rows)."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.raw, self.offsets = raw, offsets
        word = ~SPACE[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        start, end = word.copy(), word.copy()
        if len(raw):
            start[1:] &= ~word[:-1] | edge[1:-1]
            end[:-1] &= ~word[1:] | edge[1:-1]
        self.starts = np.flatnonzero(start)
        self.ends = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, fold: bool = True) -> np.ndarray:
        """A 64-bit hash per word from one running sum over the bytes."""
        return span_hashes(self.raw, self.starts, self.ends, fold)


class Rolling:
    """64-bit content hashes of any byte spans of ``raw``, from one running sum."""

    def __init__(self, raw: np.ndarray, fold: bool = False):
        n = len(raw)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum((_FOLDED if fold else _TABLE)[raw] * _power(_BASE, max(n, 1))[:n], out=self.total[1:])
        self.inverse = _power(_BASE_INV, n + 1)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.total[ends] - self.total[starts]) * self.inverse[starts]
        return mix(h + (ends - starts).astype(np.uint64) * _LANES[SHINGLE_WORDS])


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """64-bit content hash of every byte span [start, end)."""
    return Rolling(raw, fold).spans(starts, ends)


def row_words(column: pa.Array, fold: bool = True) -> Iterator[tuple[int, int, Words, np.ndarray]]:
    """Slices of a text column: (first row, end row, words, word hashes)."""
    raw, off = text_bytes(column)
    for lo, hi in slices(off):
        w = Words(raw[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
        yield lo, hi, w, w.hashes(fold)


def shingle_positions(h: np.ndarray, k: int = SHINGLE_WORDS) -> np.ndarray:
    """Hash of the k words from each position on (the last k-1 are cut off)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    s = np.zeros(n, np.uint64)
    for j in range(k):
        s += h[j:j + n] * _U(pow(int(_LANES[0]), j + 1, 1 << 64))
    return mix(s)


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """Per row the sorted distinct hashes of its 5-word shingles; a row of 1-4
    words has one (its whole sequence), an empty row none."""
    for lo, hi, w, h in row_words(column):
        s = shingle_positions(h)
        for r in range(hi - lo):
            a, b = int(w.first[r]), int(w.first[r + 1])
            if b - a >= SHINGLE_WORDS:
                yield np.unique(s[a:b - SHINGLE_WORDS + 1])
            elif b > a:
                yield mix(np.array([int(sum(int(x) * pow(int(_LANES[1]), j + 1, 1 << 64) for j, x in enumerate(h[a:b]))
                                        + (b - a) * 0x51ED27) & 0xFFFFFFFFFFFFFFFF], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


class MinHasher:
    """Multiply-add permutations of the 32-bit universe, drawn from a seed."""

    def __init__(self, k: int = 128, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.k = k
        self.a = (rng.integers(0, 1 << 32, k, dtype=np.uint32) | np.uint32(1))[:, None]
        self.b = rng.integers(0, 1 << 32, k, dtype=np.uint32)[:, None]

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """k minima; the empty set has the all-ones signature."""
        out = np.full(self.k, 0xFFFFFFFF, np.uint32)
        x = (shingles >> _U(32)).astype(np.uint32)
        for i in range(0, len(x), 1024):
            np.minimum(out, (self.a * x[i:i + 1024] + self.b).min(axis=1), out=out)
        return out


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """One signed 64-bit key for each band of ``rows`` components."""
    m = sig.reshape(-1, rows).astype(np.uint64)
    h = np.arange(1, len(m) + 1, dtype=np.uint64) * _LANES[2]
    for j in range(rows):
        h = mix(h + m[:, j] * _LANES[j % SHINGLE_WORDS] + _U(j))
    return h.view(np.int64)


def set_hash(shingles: np.ndarray) -> int:
    """Order-free 64-bit hash of a set, signed."""
    with np.errstate(over="ignore"):
        return int(mix(shingles + _U(0x2545F491)).sum(dtype=np.uint64).astype(np.int64)) if len(shingles) else 0
