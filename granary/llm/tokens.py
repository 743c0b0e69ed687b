"""Vectorised words, hashes and windows over the bytes of a whole Arrow column of texts.

All functions work on UTF-8 bytes of many documents at once and never cut a document. Words are runs of bytes outside
a set of separators; as all separators are ASCII, byte runs and character runs agree. A word's hash is a polynomial
over table values of its bytes modulo 2**64, finished by a mixing step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
#: space and \x09 to \x0D
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
NEWLINE = np.zeros(256, bool)
NEWLINE[10] = True
CHUNK_BYTES = 1 << 18
TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = np.asarray(x, U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below at least n."""
    size = max(1 << 19, 1 << (max(n, 1) - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        out = []
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(size, b, U64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=U64))
        _powers[size] = (out[0], out[1])
    return _powers[size]


@dataclass
class Texts:
    """Bytes of consecutive documents; document i is data[offsets[i]:offsets[i + 1]]."""

    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1


def texts_of(column: pa.Array | pa.ChunkedArray) -> Texts:
    """A string column's bytes; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return Texts(data[offsets[0] : offsets[-1]], offsets - offsets[0])


def pieces(batch: pa.RecordBatch | pa.Table, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch | pa.Table]:
    """Slices of whole rows with about `limit` bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
    if not len(sizes):
        return
    ends = np.cumsum(sizes.astype(np.int64))
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """c with c[e] - c[s] = hash of data[s:e] times BASE**s."""
    c = np.zeros(len(data) + 1, U64)
    np.cumsum(TABLE[data] * powers(len(data) + 1)[0][: len(data)], out=c[1:])
    return c


def span_hash(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((c[end] - c[start]) * powers(len(c))[1][start] + end.astype(U64) - start.astype(U64))


@dataclass
class Runs:
    """Maximal runs of non-separators: document, bytes [start, end), hash; first[i] is document i's first run."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def runs(texts: Texts, separator: np.ndarray = BLANK, sums: np.ndarray | None = None) -> Runs:
    data, offsets = texts.data, texts.offsets
    solid = ~separator[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begin, finish = solid.copy(), solid.copy()
    if len(data):
        begin[1:] &= ~solid[:-1] | edge[1:-1]
        finish[:-1] &= ~solid[1:] | edge[1:-1]
    start, end = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(texts.n), np.diff(first))
    c = prefix_sums(data) if sums is None else sums
    return Runs(doc, start, end, span_hash(c, start, end), first)


def window_hash(values: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all `size` consecutive values, across documents too; see `within`."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    h = np.zeros(n, U64)
    for j in range(size):
        h *= U64(BASE)
        h += values[j : j + n]
    return mix(h)


def within(doc: np.ndarray, size: int) -> np.ndarray:
    """Which windows of `size` consecutive items lie in one document."""
    n = len(doc) - size + 1
    return doc[:n] == doc[size - 1 :] if n > 0 else np.zeros(0, bool)


def cover(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n items lie in a window of `size` items that begins at one of `starts`."""
    d = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(np.minimum(starts + size, n), minlength=n + 1)[: n + 1]
    return np.cumsum(d)[:n] > 0


def ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... count[0] numbers, then those of start[1], and so on."""
    if not len(count):
        return np.zeros(0, np.int64)
    ends = np.cumsum(count)
    return np.arange(ends[-1]) + np.repeat(start - (ends - count), count)


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """Minima of all windows of `size` consecutive values."""
    have, out = 1, values
    while have * 2 <= size:
        out = np.minimum(out[:-have], out[have:]) if len(out) > have else out[:0]
        have *= 2
    rest = size - have
    if rest:
        out = np.minimum(out[:-rest], out[rest:]) if len(out) > rest else out[:0]
    return out
