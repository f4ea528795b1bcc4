"""Array primitives over batches of text, used inside ``mapInArrow`` tasks.

A batch's string column is read as one byte array plus row offsets, cut into chunks of whole
rows of about ``CHUNK_BYTES`` so that a task holds a bounded number of intermediate arrays (a single
longer row is a chunk of its own).  Words, hashes of any byte range and hashes of word runs are then
computed for all rows of a chunk at once.

Null texts count as empty everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

#: bytes that separate words: space and the control characters 0x09 to 0x0D
IS_SEP = np.zeros(256, bool)
IS_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: A-Z to a-z, every other byte unchanged (so UTF-8 sequences stay intact)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _byte_codes() -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising mix of 64-bit values (multiply, xor-shift), as a new array."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


_CODES = _byte_codes()


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        up = np.full(size, _BASE, np.uint64)
        down = np.full(size, _BASE_INV, np.uint64)
        up[0] = down[0] = 1
        _powers = np.cumprod(up), np.cumprod(down)
    return _powers


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; null rows are empty."""
    if col.null_count:
        col = col.fill_null("")
    if pa.types.is_null(col.type):
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    buffers = col.buffers()
    if len(col) == 0 or buffers[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if buffers[2] is None else np.frombuffer(buffers[2], np.uint8)
    return data, offsets


def chunks(col: pa.Array, budget: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows lo..hi as (lo, hi, bytes, offsets from 0), whole rows, about ``budget`` bytes each."""
    data, offsets = column_bytes(col)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + budget, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that do not cross a row border: (starts, ends, first run of each row + total)."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    full = offsets[:-1] < offsets[1:]
    heads, tails = offsets[:-1][full], offsets[1:][full] - 1
    first[heads] = inside[heads]
    last[tails] = inside[tails]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all rows: (starts, ends, first word of each row + total)."""
    return runs(~IS_SEP[data], offsets)


class RangeHash:
    """64-bit hashes of arbitrary byte ranges in constant time each, from one running sum."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = _power_tables(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_CODES[data] * self.up[: len(data)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((self.sums[ends] - self.sums[starts]) * self.down[starts])


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every lower-cased word, first word of each row + total)."""
    starts, ends, first = words(data, offsets)
    return RangeHash(LOWER[data])(starts, ends), first


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive values (windows may cross rows: the caller picks)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out += hashes[j : j + n] * np.uint64((0xA24BAED4963EE407 * (2 * j + 1) + 0x9FB21C651E98DF25 * j) & (2**64 - 1) | 1)
    return mix64(out)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``width``-word shingles of every row, sorted within the row: (values, row offsets).

    A row with fewer words has the whole sequence as its one shingle; a row without words has none.
    """
    hashes, first = word_hashes(data, offsets)
    windows = window_hashes(hashes, width)
    parts, sizes = [], np.zeros(len(first), np.int64)
    for r in range(len(first) - 1):
        a, b = int(first[r]), int(first[r + 1])
        if b - a >= width:
            own = np.sort(windows[a : b - width + 1])
            if len(own) > 1:
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif b > a:
            own = window_hashes(hashes[a:b], b - a) ^ np.uint64(b - a)
        else:
            continue
        parts.append(own)
        sizes[r + 1] = len(own)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.cumsum(sizes)


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from flat values and row offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))
