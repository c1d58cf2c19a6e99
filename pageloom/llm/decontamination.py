"""Benchmark decontamination with a generalised suffix automaton of the test items."""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import slices, utf8

#: Words of a lower-cased text.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
#: Lower-cases A-Z and blanks every ASCII character that is neither a letter nor a digit.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
FOUND = "doc_id long, text string, n_words long, n_hit long, hits array<int>, items array<string>"


def fold(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


class SuffixAutomaton:
    """All substrings of the items' words, with the items that hold each window.

    A window is ``window`` consecutive words of an item, or the whole of a shorter item.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.names = [name for name, _ in items]
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        coded = [[self.ids.setdefault(w, len(self.ids) + 1) for w in words] for _, words in items]
        for sequence in coded:
            last = 0
            for symbol in sequence:
                last = self._extend(last, symbol)
        self.anchor = self._anchors()
        self.owners: dict[int, set[int]] = {}
        self.short: dict[int, list[int]] = {}
        for item, sequence in enumerate(coded):
            state = 0
            for at, symbol in enumerate(sequence):
                state = self.next[state][symbol]
                if at + 1 >= window:
                    self.owners.setdefault(self.anchor[state], set()).add(item)
            if 0 < len(sequence) < window:
                self.short.setdefault(state, []).append(item)
        self.least = min([window, *(len(s) for s in coded if s)])
        self.short_above = self._short_above()
        self.pairs = self._pairs(coded)

    def _extend(self, last: int, symbol: int) -> int:
        step = self.next[last].get(symbol)
        if step is not None:
            return step if self.size[step] == self.size[last] + 1 else self._clone(last, symbol, step)
        new = len(self.next)
        self.next.append({})
        self.size.append(self.size[last] + 1)
        self.link.append(0)
        at = last
        while at != -1 and symbol not in self.next[at]:
            self.next[at][symbol] = new
            at = self.link[at]
        if at != -1:
            step = self.next[at][symbol]
            self.link[new] = step if self.size[step] == self.size[at] + 1 else self._clone(at, symbol, step)
        return new

    def _clone(self, at: int, symbol: int, step: int) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[step]))
        self.size.append(self.size[at] + 1)
        self.link.append(self.link[step])
        self.link[step] = copy
        while at != -1 and self.next[at].get(symbol) == step:
            self.next[at][symbol] = copy
            at = self.link[at]
        return copy

    def _anchors(self) -> list[int]:
        """For each state the one of its suffixes of ``window`` words (0: none)."""
        anchor = [0] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.size.__getitem__):
            if self.size[state] >= self.window:
                above = self.link[state]
                anchor[state] = anchor[above] if self.size[above] >= self.window else state
        return anchor

    def _short_above(self) -> list[int]:
        """For each state the nearest one on its suffix path, itself included, that is a whole short item."""
        out = [0] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.size.__getitem__):
            out[state] = state if state in self.short else out[self.link[state]]
        return out

    def _pairs(self, coded: list[list[int]]) -> tuple[np.ndarray, np.uint64]:
        """A table of the neighbouring word pairs, by hash: it may say yes too often, never no."""
        pairs = [np.array(s[:-1], np.uint64) * np.uint64(len(self.ids) + 1) + np.array(s[1:], np.uint64) for s in coded if len(s) > 1]
        codes = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.uint64)
        bits = max(10, int(len(codes) * 16).bit_length())
        table = np.zeros(1 << bits, bool)
        shift = np.uint64(64 - bits)
        table[(codes * np.uint64(0x9E3779B97F4A7C15)) >> shift] = True
        return table, shift

    def regions(self, ids: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
        """Stretches of the words, within one document, in which a window can lie."""
        if self.least == 1:
            good = ids > 0
            need = 1
        else:
            table, shift = self.pairs
            codes = ids[:-1].astype(np.uint64) * np.uint64(len(self.ids) + 1) + ids[1:].astype(np.uint64)
            good = table[(codes * np.uint64(0x9E3779B97F4A7C15)) >> shift] & (ids[:-1] > 0) & (ids[1:] > 0)
            cut = bounds[1:-1] - 1
            good[cut[(cut >= 0) & (cut < len(good))]] = False
            need = self.least - 1
        edge = np.diff(np.concatenate(([0], good.astype(np.int8), [0])))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        keep = end - begin >= need
        for a, b in zip(begin[keep].tolist(), end[keep].tolist()):
            if need == 1 and self.least == 1:
                for x, y in _within(a, b, bounds):
                    yield x, y
            else:
                yield a, b + 1

    def stream(self, ids: list[int], base: int, marks: np.ndarray) -> set[int]:
        """Follow the longest match word by word; mark the words of windows, give the items."""
        follow, link, size, window = self.next, self.link, self.size, self.window
        state = length = 0
        items: set[int] = set()
        for at, symbol in enumerate(ids):
            while state and symbol not in follow[state]:
                state = link[state]
                length = size[state]
            if symbol in follow[state]:
                state = follow[state][symbol]
                length += 1
            else:
                length = 0
            if length >= window:
                marks[base + at - window + 1 : base + at + 1] = True
                items |= self.owners[self.anchor[state]]
            above = self.short_above[state] if length else 0
            while above:
                if length >= size[above]:
                    marks[base + at - size[above] + 1 : base + at + 1] = True
                    items.update(self.short[above])
                above = self.short_above[link[above]]
        return items


def _within(a: int, b: int, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """The stretch ``a..b`` cut at the documents' bounds."""
    inner = bounds[(bounds > a) & (bounds < b)].tolist()
    yield from zip([a, *inner], [*inner, b])


def runs(marks: np.ndarray) -> np.ndarray:
    """Start and end of each run of marked places, one after the other."""
    edge = np.diff(np.concatenate(([0], marks.astype(np.int8), [0])))
    return np.column_stack((np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))).ravel()


def scan(automaton: SuffixAutomaton, rows: list[bytes]) -> tuple[list[int], list[list[int]], list[list[str]]]:
    """Word counts, hit word runs and hit items of folded texts."""
    counts, parts = [], []
    get = automaton.ids.get
    for row in rows:
        found = row.split()
        counts.append(len(found))
        parts.append(np.fromiter(map(get, found, repeat(0)), np.int64, len(found)))
    bounds = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    marks = np.zeros(len(ids), bool)
    items: dict[int, set[int]] = {}
    for a, b in automaton.regions(ids, bounds) if len(ids) else ():
        if got := automaton.stream(ids[a:b].tolist(), a, marks):
            items.setdefault(int(np.searchsorted(bounds, a, "right")) - 1, set()).update(got)
    hits = [runs(marks[bounds[i] : bounds[i + 1]]).tolist() if i in items else [] for i in range(len(rows))]
    return counts, hits, [sorted({automaton.names[x] for x in items[i]}) if i in items else [] for i in range(len(rows))]


def _automaton(held: tuple, window: int) -> SuffixAutomaton:
    """The automaton of a broadcast pass, built once in each worker."""
    token, items = held
    if _BUILT.get("key") != (token, window):
        _BUILT.update(key=(token, window), made=SuffixAutomaton([(name, fold(text)) for name, text in items.value], window))
    return _BUILT["made"]


_BUILT: dict = {}


def item_passes(benchmark: DataFrame, pass_bytes: int) -> list[tuple]:
    """The test items broadcast in passes of about ``pass_bytes`` each, so that a broadcast has a bound."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), F.coalesce("text", F.lit("")).alias("words"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()[0]
    n = max(1, math.ceil(total / pass_bytes))
    parts = ([(r[0], r[1]) for r in items.where(F.pmod(F.xxhash64("name", "words"), F.lit(n)) == p).collect()] for p in range(n))
    return [(uuid.uuid4().hex, benchmark.sparkSession.sparkContext.broadcast(part)) for part in parts]


def matches(documents: DataFrame, passes: list[tuple], window: int = 10, keep_text: bool = True) -> DataFrame:
    """``doc_id, text, n_words, n_hit, hits, items``: runs of hit words (start, end, start, ...) and the items hit.

    One narrow scan of the documents for each pass of items; each further pass adds to the
    two columns. Nulls: a null text has no words, a null id is kept as it is, an item without
    id counts under the empty id, items without words have no window. Repeated documents are
    scanned as often as they occur; items of one id count once. No rows give no rows.
    """
    found = documents.select("doc_id", "text", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<int>").alias("hits"), F.array().cast("array<string>").alias("items"))
    for number, held in enumerate(passes):
        with_text = keep_text or number + 1 < len(passes)

        def step(batches: Iterator[pa.RecordBatch], held=held, with_text=with_text) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(held, window)
            for batch in batches:
                data, bounds = utf8(batch.column("text"))
                for a, b in slices(bounds):
                    rows = [data[bounds[i] : bounds[i + 1]].tobytes().translate(FOLD) for i in range(a, b)]
                    counts, hits, names = scan(automaton, rows)
                    part = batch.slice(a, b - a)
                    old_hits, old_names = part.column("hits").to_pylist(), part.column("items").to_pylist()
                    hits = [_joined(x or [], y) for x, y in zip(old_hits, hits)]
                    names = [sorted({*(x or []), *y}) for x, y in zip(old_names, names)]
                    n_hit = [sum(h[1::2]) - sum(h[::2]) for h in hits]
                    text = part.column("text") if with_text else pa.nulls(b - a, pa.string())
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id"), text, pa.array(counts, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(names, pa.list_(pa.string()))],
                        ["doc_id", "text", "n_words", "n_hit", "hits", "items"],
                    )

        found = found.mapInArrow(step, FOUND)
    return found


def _joined(one: list[int], two: list[int]) -> list[int]:
    """The union of two lists of runs."""
    if not one or not two:
        return one or two
    out: list[int] = []
    for a, b in sorted([*zip(one[::2], one[1::2]), *zip(two[::2], two[1::2])]):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def cut(text: str, hits: list[int]) -> str:
    """The text without the words of the runs and what lies between them; a line end closes the gap."""
    places = [m.span() for m in WORD.finditer(text.translate(LOWER))]
    out, done = [], 0
    for a, b in zip(hits[::2], hits[1::2]):
        out.append(text[done : places[a][0]].rstrip(" "))
        done = places[b - 1][1]
    return "\n".join([*out, text[done:].lstrip(" ")]).strip()


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5, pass_bytes: int = 16 << 20) -> DataFrame:
    """``doc_id, text, n_words, n_hit, items, removed``: matched runs cut out of the texts.

    Every run of words in windows of test items is cut; a document with more than
    ``max_coverage`` of its words in such runs is marked ``removed``. Cutting is repeated as
    long as the remaining words form a window anew. Other cases as in :func:`matches`.
    """
    helds = item_passes(benchmark, pass_bytes)
    found = matches(documents, helds, window)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            hit = {i: h for i, h in enumerate(batch.column("hits").to_pylist()) if h}
            if hit:
                values = texts.to_pylist()
                for i, spans in hit.items():
                    while spans:
                        values[i] = cut(values[i], spans)
                        spans = []
                        for held in helds:
                            spans = _joined(spans, scan(_automaton(held, window), [values[i].encode().translate(FOLD)])[1][0])
                texts = pa.array(values, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts, *(batch.column(c) for c in ("n_words", "n_hit", "items"))], ["doc_id", "text", "n_words", "n_hit", "items"])

    cleaned = found.mapInArrow(clean, "doc_id long, text string, n_words long, n_hit long, items array<string>")
    return cleaned.withColumn("removed", F.col("n_hit") > F.lit(max_coverage) * F.col("n_words"))


def report(documents: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Per document the counts of words, hit words and hit items, and a digest of the items."""
    found = matches(documents, item_passes(benchmark, 16 << 20), window, keep_text=False)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def keep_clean(documents: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5, pass_bytes: int = 16 << 20) -> DataFrame:
    """The documents, all columns kept, with matched runs cut out of ``text`` (and ``n_chars`` set anew).

    Documents with more than ``max_coverage`` of their words in matched runs go. Null and empty texts
    match nothing and stay; null ids stay; repeated rows fare alike; no rows give no rows; without
    items every document stays as it is; other columns are not looked at, whatever their names.
    """
    helds = item_passes(benchmark, pass_bytes)
    names = documents.columns
    place, size = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def hits_of(rows: list[bytes]) -> tuple[list[int], list[list[int]]]:
        counts, hits = [], [[] for _ in rows]
        for held in helds:
            counts, found, _ = scan(_automaton(held, window), rows)
            hits = [_joined(x, y) for x, y in zip(hits, found)]
        return counts, hits

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            data, bounds = utf8(whole.column(place))
            for a, b in slices(bounds):
                batch = whole.slice(a, b - a)
                counts, hits = hits_of([data[bounds[i] : bounds[i + 1]].tobytes().translate(FOLD) for i in range(a, b)])
                if any(hits):
                    values = batch.column(place).to_pylist()
                    keep = [sum(h[1::2]) - sum(h[::2]) <= max_coverage * n for n, h in zip(counts, hits)]
                    changed = {i for i, h in enumerate(hits) if h and keep[i]}
                    for i in changed:
                        spans = hits[i]
                        while spans:
                            values[i] = cut(values[i], spans)
                            spans = hits_of([values[i].encode().translate(FOLD)])[1][0]
                    columns = list(batch.columns)
                    columns[place] = pa.array(values, columns[place].type)
                    if size is not None:
                        old = columns[size].to_pylist()
                        columns[size] = pa.array([len(values[i]) if i in changed else n for i, n in enumerate(old)], columns[size].type)
                    batch = pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep))
                yield batch

    return documents.mapInArrow(clean, documents.schema)
