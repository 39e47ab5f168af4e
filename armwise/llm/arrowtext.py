"""Word hashes and byte counts of Arrow string arrays, by whole-array NumPy work in bounded slices."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from armwise.llm.common import BLANKS

#: Bytes of text that one slice holds, unless a single text is longer.
SLICE = 1 << 20
U = np.uint64
_STEP = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[ord(c) for c in BLANKS]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * U(_STEP))
_BASE = 0xD1342543DE82EF95
_UNBASE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, b in enumerate((_BASE, _UNBASE)):
            p = np.full(max(n, SLICE), b, np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p)
    return _powers[0], _powers[1]


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches as they come; between them the pool gives its free memory back, which a reused worker would else keep."""
    for b in batches:
        yield b
        del b
        pa.default_memory_pool().release_unused()


@dataclass
class Slice:
    """Rows lo to hi of an array: their bytes and, a row, where its bytes start and end."""

    lo: int
    hi: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE) -> Iterator[Slice]:
    """The rows in order; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # an empty table may keep its chunks
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    n = len(column)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    offs = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    starts, ends = offs[:-1], offs[1:].copy()
    if column.null_count:
        null = np.asarray(column.is_null())
        ends[null] = starts[null]
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        a, b = offs[lo], offs[hi]
        yield Slice(lo, hi, data[a:b], starts[lo:hi] - a, ends[lo:hi] - a)
        lo = hi


@dataclass
class Words:
    """The words of a slice: byte spans, and first[r]:first[r + 1] are those of row r."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def find_words(s: Slice) -> Words:
    n = len(s.data)
    inside = np.zeros(n + 1, bool)
    np.logical_not(_IS_BLANK[s.data], out=inside[:n])
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    cut = s.starts[s.starts < n]
    opens[cut] = inside[cut]
    closes[:n] &= ~inside[1:]
    cut = s.ends[s.ends > s.starts] - 1
    closes[cut] = inside[cut]
    starts, ends = np.flatnonzero(opens[:n]), np.flatnonzero(closes[:n]) + 1
    return Words(starts, ends, np.append(np.searchsorted(starts, s.starts), len(starts)))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, in order and apart; lower: A-Z count as a-z. Work is cut into bounded parts."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + SLICE)))
        a, b = int(starts[i]), int(ends[i:j].max())
        part = data[a:b]
        p, q = _grown(len(part) + 1)
        codes = _BYTE_CODE[_LOWER[part] if lower else part]
        codes *= p[: len(part)]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(codes, out=total[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = mix((total[e] - total[s]) * q[s] + (e - s).astype(np.uint64) * U(_STEP))
        i = j
    return out


def shingles(hashes: np.ndarray, n: int = 5) -> np.ndarray:
    """The sorted distinct hashes of one text's n-word windows; a shorter text is one window; without words, none."""
    w = len(hashes)
    if not w:
        return hashes
    k = min(n, w)
    z = hashes[: w - k + 1].copy()
    for j in range(1, k):
        z *= U(_BASE)
        z += hashes[j : w - k + 1 + j]
    z = np.sort(mix(z + U(k)))
    return z[np.append(True, z[1:] != z[:-1])]


def counts_between(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many flags are set in each span."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[ends] - total[starts]
