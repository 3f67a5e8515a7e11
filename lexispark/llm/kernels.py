"""Vectorised kernels over the UTF-8 buffers of Arrow string columns.

All work on a slice of rows: a byte buffer and row offsets.  Rows without a
text count as empty.

Words are hashed one by one (XXH3, 64 bits), and runs of words by mixing at
every step, so that regular texts don't collide.  ``Prefix`` has 64-bit
polynomial hashes of any byte range, which regular texts can make collide: it
only serves to bring together what is compared byte by byte afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text that one kernel call takes at once, unless one row is longer.
SLICE_BYTES = 1 << 20

_P = 0x9E3779B97F4A7C15 | 1
_PI = pow(_P, -1, 1 << 64)
_VALUE = np.random.default_rng(20240229).integers(1, (1 << 63) - 1, 256, dtype=np.int64).view(U64)
_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    got = _tables.get(base)
    if got is None or len(got) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        got = np.empty(size, dtype=U64)
        got[0] = 1
        k, q = 1, base
        while k < size:
            np.multiply(got[:k], U64(q), out=got[k : 2 * k])
            k, q = 2 * k, q * q % (1 << 64)
        if size <= 8 << 20:
            _tables[base] = got
    return got[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit hash (in place)."""
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


class Prefix:
    """Prefix hashes of a buffer; ``of(starts, ends)`` gives mixed range hashes."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        self.h = np.zeros(n + 1, dtype=U64)
        np.cumsum(_VALUE[buf] * _powers(_P, n), out=self.h[1:])
        self.inverse = _powers(_PI, n + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = self.h[ends] - self.h[starts]
        out *= self.inverse[starts]
        out += (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93)
        return mix(out)

    def windows(self, k: int) -> np.ndarray:
        """Hash of every range of ``k`` bytes."""
        out = self.h[k:] - self.h[:-k]
        out *= self.inverse[: len(out)]
        return mix(out)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_string() if pa.types.is_string(column.type) else pa.large_binary())
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch with at most ``most`` bytes of text, or one row each."""
    buf, off = buffers(batch.column(batch.schema.get_field_index(column)))
    k, n = 0, len(off) - 1
    while k < n:
        e = max(k + 1, int(np.searchsorted(off, off[k] + most, side="right")) - 1)
        yield batch.slice(k, e - k), buf[off[k] : off[e]], off[k : e + 1] - off[k]
        k = e


def word_hashes(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A hash of each word of all rows, in order; ``bytes.split`` cuts at the same blanks as ``word_spans``."""
    raw, o = buf.tobytes(), off.tolist()
    found: list[bytes] = []
    for a, b in zip(o[:-1], o[1:]):
        found += raw[a:b].split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), dtype=U64, count=len(found))


def chained(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` hashes in a row."""
    out = mix(h[: max(0, len(h) - n + 1)].copy())
    for k in range(1, n):
        out *= U64(0x9E3779B97F4A7C15)
        out += h[k : len(out) + k]
        mix(out)
    return out


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows; index of each row's first word, and the total."""
    n = len(buf)
    inside = ~SPACE[buf]
    edge = np.zeros(n + 1, dtype=bool)
    edge[off] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def row_of(first: np.ndarray) -> np.ndarray:
    """Row of each word, from the index of each row's first word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def pack(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def segments(keys: np.ndarray) -> np.ndarray:
    """Index of the first element of each run of equal keys, and the length."""
    if not len(keys):
        return np.zeros(1, dtype=np.int64)
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, one after another."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
