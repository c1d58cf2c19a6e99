"""Suffix-array dedup: interval expansion on a Burrows-Wheeler transform, bounded by the least length."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import Units, with_duplicates

LENGTH = 50
GRAM = 20
BLOCK_BYTES = 1 << 20


def _split(data: np.ndarray, bounds: np.ndarray) -> tuple:
    return data, np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds)), None, None


UNITS = Units(_split, LENGTH, GRAM)


def suffix_array(symbols: np.ndarray, longest: int) -> np.ndarray:
    """Sorted suffixes of texts that each end with symbol 0; equal ones stay in order of place.

    Ranks of doubled prefix lengths; what follows a text's end does not count.
    """
    n = len(symbols)
    place = np.arange(n)
    ends = np.flatnonzero(symbols == 0)
    left = ends[np.searchsorted(ends, place)] - place  # symbols before the text's end
    # the first ranks are of as many symbols as fit a number
    key, size = symbols.astype(np.int64), PACKED
    for k in range(1, size):
        after = np.zeros(n, np.int64)
        after[: n - k] = np.where(left[: n - k] > k, symbols[k:], 0)
        key = key * 257 + after
    rank = _ranks(key)
    while size <= longest and rank.max() < n - 1:
        after = np.zeros(n, np.int64)
        after[: n - size] = np.where(left[: n - size] > size, rank[size:] + 1, 0)
        rank = _ranks(rank * (int(rank.max()) + 2) + after)
        size *= 2
    return np.argsort(rank * n + place)


#: Symbols (of 257) that fit 63 bits.
PACKED = 7


def _ranks(key: np.ndarray) -> np.ndarray:
    """Dense ranks of numbers; equal ones share theirs."""
    order = np.argsort(key)
    ordered = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(np.concatenate(([0], (ordered[1:] != ordered[:-1]).astype(np.int64))))
    return rank


def prefix_groups(symbols: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each place in suffix order the number of its group of equal prefixes of ``length``.

    Breadth-first backward extension: the intervals of all strings of one length are extended
    to the left by every symbol at once. The first suffix of an extended interval gets the
    length as its common-prefix value, so values come in increasing order; the expansion
    stops at the wanted length. Text ends are never extended over.
    """
    n = len(symbols)
    before = symbols[order - 1]  # the transform; the first text's first place sees the last text's end
    follow = np.argsort(before, kind="stable")  # the inverse of the backward step
    first = symbols[order]
    change = np.ones(n, bool)
    change[1:] = (first[1:] != first[:-1]) | (first[1:] == 0)
    fresh = change
    for _ in range(1, length):
        interval = np.cumsum(fresh, dtype=np.int32)[follow]
        fresh = change.copy()
        fresh[1:] |= interval[1:] != interval[:-1]
        if fresh.all():
            break
    return np.cumsum(fresh) - 1


def repeated_windows(phrases: list[bytes], ids: list[int]) -> list[list[tuple[int, int]]]:
    """For each phrase the runs of windows that a phrase of a smaller id holds too."""
    joined = b"\0".join(phrases) + b"\0"
    symbols = np.frombuffer(joined, np.uint8).astype(np.uint16) + np.uint16(1)
    sizes = np.array([len(p) for p in phrases])
    ends = np.cumsum(sizes + 1) - 1
    symbols[ends] = 0
    order = suffix_array(symbols, int(sizes.max()) + 1)
    group = prefix_groups(symbols, order, LENGTH)
    owner = np.repeat(np.array(ids, np.int64), sizes + 1)
    least = np.minimum.reduceat(owner[order], np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))))
    repeated = np.zeros(len(symbols), bool)
    repeated[order] = owner[order] > least[group]
    # windows end within their phrase; the runs of a phrase are cut by its end symbol
    place = np.arange(len(symbols))
    repeated &= ends[np.searchsorted(ends, place)] - place >= LENGTH
    edge = np.diff(np.concatenate(([0], repeated.astype(np.int8), [0])))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    phrase = np.searchsorted(ends, starts)
    begin = (ends - sizes)[phrase]
    out: list[list[tuple[int, int]]] = [[] for _ in phrases]
    for i, a, b in zip(phrase.tolist(), (starts - begin).tolist(), (stops - begin).tolist()):
        out[i].append((a, b))
    return out


def expand(anchors: list[int], phrases: list[bytes], ids: list[int]) -> list[list[tuple[int, int]] | None]:
    """Transforms over whole anchor groups, about ``BLOCK_BYTES`` at a time; a lone phrase has no match."""
    out: list[list[tuple[int, int]] | None] = [None] * len(phrases)
    block: list[int] = []
    size, first = 0, 0
    while first < len(anchors):
        last = first
        while last < len(anchors) and anchors[last] == anchors[first]:
            last += 1
        if last - first > 1:
            block += range(first, last)
            size += sum(len(phrases[i]) + 1 for i in range(first, last))
        if block and (size >= BLOCK_BYTES or last == len(anchors)):
            for i, runs in zip(block, repeated_windows([phrases[i] for i in block], [ids[i] for i in block])):
                out[i] = runs
            block, size = [], 0
        first = last
    if block:
        for i, runs in zip(block, repeated_windows([phrases[i] for i in block], [ids[i] for i in block])):
            out[i] = runs
    return out


def remove_repeats(documents: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, spans, kept``: byte spans of 50 bytes and more that a smaller id has too, and the rest.

    Matches lie within one text; judged on the input. ``kept`` may break characters of more
    than one byte, as the spans are bytes. Other cases as for words: equal texts keep the
    smallest id's, rows of one id or without id are no reference for each other, a null is
    empty, no rows give no rows, other columns are not looked at.
    """

    def keep(raw: bytes, marks: np.ndarray | None) -> bytes:
        return raw if marks is None else np.frombuffer(raw, np.uint8)[~marks].tobytes()

    return with_duplicates(documents, UNITS, expand, len, keep).withColumnRenamed("n_units", "n_bytes")


def report(documents: DataFrame) -> DataFrame:
    """Counts of all and of removed bytes and of spans, and a digest of the kept bytes."""
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return remove_repeats(documents).select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
