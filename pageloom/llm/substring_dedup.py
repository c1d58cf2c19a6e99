"""Substring dedup by relative Lempel-Ziv parsing against indexed blocks of reference phrases."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import Units, with_duplicates
from .text import word_hashes, words

WINDOW = 13
GRAM = 7


def _split(data: np.ndarray, bounds: np.ndarray) -> tuple:
    starts, ends, row = words(data, bounds)
    return word_hashes(data, starts, ends), row, starts, ends


class ReferenceBlock:
    """Phrases of smaller ids, indexed by the places where a factor of ``least`` words can start."""

    def __init__(self, least: int):
        self.least = least
        self.phrases: list[list[bytes]] = []
        self.starts: dict[tuple[bytes, ...], tuple[int, int]] = {}

    def add(self, phrase: list[bytes]) -> None:
        for at in range(len(phrase) - self.least + 1):
            self.starts.setdefault(tuple(phrase[at : at + self.least]), (len(self.phrases), at))
        self.phrases.append(phrase)

    def factors(self, phrase: list[bytes]) -> Iterator[tuple[int, int]]:
        """Greedy factors of at least ``least`` words as (start, end).

        A factor is stretched as far as its reference goes. The next one may start inside it:
        the windows across its end are looked up too, so none is lost at a boundary.
        """
        at = 0
        while at + self.least <= len(phrase):
            found = self.starts.get(tuple(phrase[at : at + self.least]))
            if found is None:
                at += 1
                continue
            reference, place = self.phrases[found[0]], found[1]
            end, other = at + self.least, place + self.least
            while end < len(phrase) and other < len(reference) and phrase[end] == reference[other]:
                end, other = end + 1, other + 1
            yield at, end
            at = end - self.least + 1


def factorise(anchors: list[int], phrases: list[bytes], ids: list[int]) -> list[list[tuple[int, int]] | None]:
    """For each phrase its runs of windows inside factors of phrases of smaller ids."""
    out: list[list[tuple[int, int]] | None] = [None] * len(phrases)
    first = 0
    while first < len(anchors):
        last = first
        while last < len(anchors) and anchors[last] == anchors[first]:
            last += 1
        if last - first > 1:
            block, waiting = ReferenceBlock(WINDOW), []
            for i in sorted(range(first, last), key=ids.__getitem__):
                if waiting and ids[waiting[0][0]] < ids[i]:
                    for _, phrase in waiting:
                        block.add(phrase)
                    waiting = []
                phrase = phrases[i].split()
                out[i] = [(a, b - WINDOW + 1) for a, b in block.factors(phrase)]
                waiting.append((i, phrase))
        first = last
    return out


UNITS = Units(_split, WINDOW, GRAM)


def remove_repeats(documents: DataFrame) -> DataFrame:
    """``doc_id, n_words, spans, kept``: word spans of at least 13 words that a smaller id has too, and the rest.

    A window of 13 words goes if it also starts in a row of a smaller id; judged on the input.
    ``kept`` is the remaining words joined by one space. Equal texts: all but those of the
    smallest id lose their windows. Rows of one id are no reference for each other, nor are
    rows without id, which come after all others. A null or empty text has no words; no rows
    give no rows; other columns are not looked at.
    """

    def keep(raw: bytes, marks: np.ndarray | None) -> bytes:
        found = raw.split()
        return b" ".join(found if marks is None else [w for w, m in zip(found, marks.tolist()) if not m])

    done = with_duplicates(documents, UNITS, factorise, lambda raw: len(raw.split()), keep)
    return done.withColumnRenamed("n_units", "n_words")


def report(documents: DataFrame) -> DataFrame:
    """Counts of all and of removed words, and a digest of the kept ones."""
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return remove_repeats(documents).select("doc_id", "n_words", n_removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
