"""Runs of bytes of one class in a block of texts, and the runs as an Arrow column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def fold(data: np.ndarray) -> np.ndarray:
    """A to Z in lower case, every other byte as it is."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def runs(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of all maximal runs of marked bytes; a run ends at its row's end."""
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    before, after = np.concatenate(([False], inside[:-1])), np.concatenate((inside[1:], [False]))
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(bounds, starts, "right") - 1


def pieces(data: np.ndarray, inside: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.LargeBinaryArray:
    """The runs as a column: the marked bytes are, one after the other, just the runs."""
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
