"""Array kernels over the UTF-8 bytes of Arrow text columns.

A word is a maximal run of bytes outside ``\\x20 \\x09-\\x0D``. Spans are hashed by a
polynomial over the bytes modulo 2**64 whose prefix sums give any span in constant time,
followed by a 64-bit finaliser.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on an array of uint64; the input is left as it is."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


GOLD = U(0x9E3779B97F4A7C15)
STEPS = np.arange(1 << 12, dtype=np.uint64) * GOLD
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * GOLD)
BASE = 0x5851F42D4C957F2D
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64 for i up to n."""
    while len(_powers[0]) <= n:
        for i, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            known = _powers[i]
            _powers[i] = np.concatenate([known, known * U(pow(base, len(known), 1 << 64))])
    return _powers[0], _powers[1]


def prefix(buf: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial, one longer than buf."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(BYTE[buf] * powers(len(buf))[0][: len(buf)], out=out[1:])
    return out


def spans(pre: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash for each span [start, end)."""
    return mix((pre[ends] - pre[starts]) * powers(len(pre))[1][starts])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the n+1 offsets of its rows from 0; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    size = np.int64 if wide else np.int32
    offs = np.frombuffer(offs, size, len(column) + 1, column.offset * np.dtype(size).itemsize).astype(np.int64)
    first = int(offs[0]) if len(offs) else 0
    buf = np.frombuffer(data, np.uint8, int(offs[-1]) - first, first) if data is not None else np.zeros(0, np.uint8)
    return buf, offs - first


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row ranges of a batch with about `limit` bytes of text each (or one longer row): part, bytes, offsets."""
    at = batch.schema.get_field_index(column)
    buf, offs = utf8(batch.column(at))
    n, i = batch.num_rows, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i), buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def words(buf: np.ndarray, offs: np.ndarray, space: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~space.take(buf)
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    cut = offs[:-1][offs[:-1] < len(buf)]
    before[cut] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[cut[cut > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offs[1:], starts, "right")


def bounds(rows: np.ndarray, n: int) -> np.ndarray:
    """n+1 offsets of the rows 0..n-1 in a sorted array of row numbers."""
    return np.searchsorted(rows, np.arange(n + 1))


def ints(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(column)).to_numpy(zero_copy_only=False)
