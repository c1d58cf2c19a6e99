"""Quality rules as a short-circuit cascade ordered by rejection per cost."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import grams, slices, utf8, word_hashes, words

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123)]] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
MARKS = np.zeros(256, bool)
MARKS[list(b"!|")] = True
SAMPLE_ROWS = 2000


class Texts:
    """The texts of one slice; counts are made once, on first use, for the base columns and all rules."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds, self.n = data, bounds, len(bounds) - 1
        self.starts, self.ends, self.row = words(data, bounds)
        self.n_words = np.bincount(self.row, minlength=self.n)

    def per_row(self, table: np.ndarray) -> np.ndarray:
        """How many bytes of the table each text has."""
        total = np.concatenate(([0], np.cumsum(table[self.data])))
        return total[self.bounds[1:]] - total[self.bounds[:-1]]

    @cached_property
    def word_chars(self) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum((self.data & 0xC0) != 0x80)))
        return np.bincount(self.row, weights=total[self.ends] - total[self.starts], minlength=self.n).astype(np.int64)

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self.per_row(SYMBOLS)

    @cached_property
    def _lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Lines with a word that equal an earlier line of their text, and all lines with a word (1 for a text of one line)."""
        dup, lines = np.zeros(self.n, np.int64), np.ones(self.n, np.int64)
        raw = self.data.tobytes()
        for i in range(self.n):
            parts = raw[self.bounds[i] : self.bounds[i + 1]].split(b"\n")
            if len(parts) > 1:
                parts = [x for x in parts if x.split()]
                dup[i], lines[i] = len(parts) - len(set(parts)), len(parts)
        return dup, lines

    @property
    def dup_lines(self) -> np.ndarray:
        return self._lines[0]

    @property
    def lines(self) -> np.ndarray:
        return self._lines[1]

    def with_base(self) -> Texts:
        """The counts that every text needs are made, whatever the rules."""
        _ = self.word_chars, self.n_symbols, self._lines
        return self

    def repeat_words(self) -> np.ndarray:
        """Words in 3-word windows that occur twice or more in their text."""
        if len(self.row) < 3:
            return np.zeros(self.n, np.int64)
        same = self.row[2:] == self.row[:-2]
        codes = grams(word_hashes(self.data, self.starts, self.ends), 3) ^ (self.row[2:].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        at = np.flatnonzero(same)
        order = at[np.argsort(codes[at], kind="stable")]
        ranked = codes[order]
        twin = np.zeros(len(ranked), bool)
        if len(ranked) > 1:
            equal = ranked[1:] == ranked[:-1]
            twin[1:] |= equal
            twin[:-1] |= equal
        hit = np.zeros(len(self.row), bool)
        for k in range(3):
            hit[order[twin] + k] = True
        return np.bincount(self.row[hit], minlength=self.n)


@dataclass(frozen=True)
class Rule:
    """A name and what says, for the texts of a slice, which ones it rejects."""

    name: str
    rejects: Callable[[Texts | Some], np.ndarray]


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


RULES = (
    Rule("symbols", lambda t: _share(t.n_symbols, t.n_words) > 0.1),
    Rule("upper_case", lambda t: _share(t.per_row(UPPER), t.per_row(LETTERS)) > 0.6),
    Rule("marks", lambda t: _share(t.per_row(MARKS), t.n_words) > 0.2),
    Rule("word_length", lambda t: (lambda mean: (mean < 2) | (mean > 20))(_share(t.word_chars, t.n_words))),
    Rule("dup_lines", lambda t: _share(t.dup_lines, t.lines) > 0.5),
)


def order_rules(documents: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Rule names by rejections per second on a random sample of about ``sample_rows`` documents.

    Each document is drawn or not where it is read, so only the rules' sums are shuffled.

    The sample settles only the order, and so the speed; every rule has the last word on
    every document that no other rule rejects.
    """
    wanted = {r.name: r for r in rules}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = utf8(batch.column("text"))
            for a, b in slices(bounds):
                texts = Texts(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]).with_base()
                seconds, rejected = [], []
                for rule in wanted.values():
                    began = time.thread_time()
                    rejected.append(int(rule.rejects(texts).sum()))
                    seconds.append(time.thread_time() - began)
                n = len(wanted)
                yield pa.RecordBatch.from_arrays([pa.array(list(wanted)), pa.array(rejected), pa.array(seconds), pa.array([b - a] * n)], ["rule", "rejected", "seconds", "rows"])

    n = documents.count()
    sample = documents.select("text").where(F.rand(7) < F.lit(min(1.0, sample_rows / max(n, 1))))
    seen = sample.mapInArrow(measure, "rule string, rejected long, seconds double, rows long").groupBy("rule").agg(F.sum("rejected").alias("rejected"), F.sum("seconds").alias("seconds")).collect()
    gain = {r["rule"]: (r["rejected"] + 0.5) / (r["seconds"] + 1e-9) for r in seen}
    return sorted(wanted, key=lambda name: (-gain.get(name, 0.0), name))


def cascade(documents: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, ``kept`` and ``rules_run`` per document.

    A document that the base test rejects runs no rule; any other runs the rules in order
    until one rejects it. A null text has no words and fails; a null id is kept; repeated
    rows are judged one by one; no rows give no rows; other columns are not looked at.
    """
    order = order_rules(documents, rules, sample_rows)
    by_name = {r.name: r for r in rules}

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = utf8(batch.column("text"))
            for a, b in slices(bounds):
                texts = Texts(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
                repeats = texts.repeat_words()
                failed = (texts.n_words < 50) | (100 * repeats > 50 * texts.n_words)
                alive, ran = ~failed, np.zeros(texts.n, np.int32)
                for name in order:
                    at = np.flatnonzero(alive)
                    if not len(at):
                        break
                    ran[at] += 1
                    alive[at[by_name[name].rejects(Some(texts, at))]] = False
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), *(pa.array(x.astype(np.int64)) for x in (texts.n_words, texts.word_chars, texts.n_symbols, texts.dup_lines, repeats)), pa.array(failed), pa.array(alive), pa.array(ran)],
                    ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rules_run"],
                )

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rules_run int"
    return documents.select("doc_id", "text").mapInArrow(judge, schema)


class Some:
    """Some texts of a slice: their counts are those made before, and only their bytes are looked at again."""

    def __init__(self, texts: Texts, rows: np.ndarray):
        self.n_words, self.word_chars, self.n_symbols = texts.n_words[rows], texts.word_chars[rows], texts.n_symbols[rows]
        self.dup_lines, self.lines = texts.dup_lines[rows], texts.lines[rows]
        self._texts, self._rows = texts, rows

    def per_row(self, table: np.ndarray) -> np.ndarray:
        data, bounds = self._bytes
        total = np.concatenate(([0], np.cumsum(table[data])))
        return total[bounds[1:]] - total[bounds[:-1]]

    @cached_property
    def _bytes(self) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.diff(self._texts.bounds)
        keep = np.zeros(self._texts.n, bool)
        keep[self._rows] = True
        return self._texts.data[np.repeat(keep, sizes)], np.concatenate(([0], np.cumsum(sizes[self._rows])))
