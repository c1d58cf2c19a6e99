"""Helpers over Arrow text columns: UTF-8 buffers, bounded slices of rows, word bounds and hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
BASE = np.uint64(0x9E3779B97F4A7C15)
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = np.int64 if str(column.type).startswith("large") else np.int32
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return bytes_[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(bounds: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``limit`` bytes; a longer row is a run of its own."""
    first, rows = 0, len(bounds) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1)
        yield first, min(last, rows)
        first = min(last, rows)


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    values = (values ^ (values >> np.uint64(30))) * MIX[0]
    values = (values ^ (values >> np.uint64(27))) * MIX[1]
    return values ^ (values >> np.uint64(31))


def grams(units: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of ``length`` units, by joining runs of doubled lengths."""
    if len(units) < length:
        return np.zeros(0, np.uint64)
    done, total, run, bit = None, 0, units.astype(np.uint64), 1
    while True:
        if length & bit:
            done = run if done is None else done[: len(done) - bit] * _power(bit) + run[total:]
            total += bit
        if bit * 2 > length:
            break
        run = run[: len(run) - bit] * _power(bit) + run[bit:]
        bit *= 2
    return mix(done)


def _power(exponent: int) -> np.uint64:
    return np.uint64(pow(int(BASE), exponent, 1 << 64))


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of all runs without ASCII white space; a run ends at its row's end."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~SPACES[data]
    first = np.zeros(n, bool)
    first[bounds[:-1][bounds[:-1] < n]] = True
    before = np.concatenate(([False], inside[:-1]))
    starts = np.flatnonzero(inside & (~before | first))
    after = np.concatenate((inside[1:], [False]))
    next_first = np.concatenate((first[1:], [True]))
    ends = np.flatnonzero(inside & (~after | next_first)) + 1
    return starts, ends, np.searchsorted(bounds, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words: differences of a running polynomial sum, scaled to the word's start."""
    n = len(data)
    if n == 0 or len(starts) == 0:
        return np.zeros(len(starts), np.uint64)
    powers, inverse = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] ^ (ends - starts).astype(np.uint64))


_TABLE: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _TABLE or len(_TABLE[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        odd, inverse = int(MIX[0]), pow(int(MIX[0]), -1, 1 << 64)
        _TABLE[:] = [_geometric(odd, size), _geometric(inverse, size)]
    return _TABLE[0], _TABLE[1]


def _geometric(ratio: int, size: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < size:
        out = np.concatenate((out, out * np.uint64(pow(ratio, len(out), 1 << 64))))
    return out[:size]
