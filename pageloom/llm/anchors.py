"""Finding where documents share runs of units (words or bytes), through content-chosen anchors.

Every window of ``length`` units picks one of its short grams, the one of the least hash, as
its anchor. Equal windows pick equal grams, so only documents with a common anchor can share
a window. The windows of one anchor lie side by side; together they are its phrase.

The rows are dealt to chunks by a hash. That one exchange of the texts is read three times;
between the readings go packed messages:

1. Each chunk sends its anchors' hashes to their buckets, each hash once; a bucket answers
   which ones another chunk has too. What two rows of a chunk share, the chunk knows itself.
2. Each chunk sends the phrases of shared anchors to blocks by anchor, equal phrases once, for
   their smallest id; a block compares them and answers which windows a smaller id holds.
   Copies of larger ids in the chunk are known to be duplicates; that passes through.
3. Each chunk applies the answers to its texts.

So an anchor or a phrase that a third of all rows hold is one entry for each chunk. Chunks and
buckets follow the length of the texts, not the partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dealing import dealt
from .text import grams, slices, utf8

#: The id under which rows without an id take part: they come last and share nothing among themselves.
NO_ID = (1 << 63) - 1
LOW = np.uint64(63)


@dataclass(frozen=True)
class Units:
    """How texts are cut into units.

    ``split`` gives, for the bytes and row bounds of a slice, one number for each unit, the row
    of each unit, and where the units begin and end (None: each byte is a unit). ``length`` units are a window, ``gram``
    units an anchor.
    """

    split: Callable[[np.ndarray, np.ndarray], tuple]
    length: int
    gram: int


@dataclass
class Phrases:
    """The phrases of a slice: anchor hash, row, first window, number of windows."""

    anchor: np.ndarray
    row: np.ndarray
    first: np.ndarray
    windows: np.ndarray


CHUNK = 1 << 19


def phrases_of(units: np.ndarray, row: np.ndarray, length: int, gram: int) -> Phrases:
    """Group the windows of each row by the anchor they pick, a stretch of units at a time."""
    parts = []
    for start in range(0, max(len(units) - length + 1, 1), CHUNK):
        stop = min(start + CHUNK + length - 1, len(units))
        part = _phrases(units[start:stop], row[start:stop], length, gram)
        part.first += start
        parts.append(part)
    return Phrases(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("anchor", "row", "first", "windows")))


def _phrases(units: np.ndarray, row: np.ndarray, length: int, gram: int) -> Phrases:
    n = len(units) - length + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return Phrases(none.astype(np.uint64), none, none.copy(), none)
    reach = length - gram + 1  # grams to choose from, 64 at most
    hashes = grams(units, gram)
    places = np.arange(len(hashes), dtype=np.uint64)
    best = (hashes & ~LOW) | (places & LOW)
    span = 1
    while span * 2 <= reach:
        best = np.minimum(best[: len(best) - span], best[span:])
        span *= 2
    if span < reach:
        best = np.minimum(best[: len(best) - (reach - span)], best[reach - span :])
    best = best[:n]
    starts = np.arange(n, dtype=np.int64)
    spot = starts + (((best & LOW).astype(np.int64) - starts) & 63)
    whole = row[:n] == row[length - 1 :]
    change = np.ones(n, bool)
    change[1:] = (spot[1:] != spot[:-1]) | (row[1:n] != row[: n - 1]) | ~whole[:-1]
    first = np.flatnonzero(change & whole)
    ends = np.flatnonzero(np.concatenate(((change | ~whole)[1:], [True])) & whole) + 1
    return Phrases(hashes[spot[first]] >> np.uint64(6), row[first], first, ends - first)


def _pack(values: np.ndarray, kind: type) -> bytes:
    return np.ascontiguousarray(values, kind).tobytes()


#: Bytes of text of a chunk of rows, which a Python worker holds, and of a block or bucket of anchors.
CHUNK_BYTES = 4 << 20
BLOCK_BYTES = 16 << 20
ASKED = "bucket int, chunk int, codes binary"
TOLD = "chunk int, bucket int, codes binary"
#: Bytes of an anchor's hash that travel beside its bucket; a false match costs a comparison.
CODE_BYTES = 5


def _codes(anchor: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and rest of anchor hashes."""
    return (anchor % np.uint64(buckets)).astype(np.int64), (anchor // np.uint64(buckets)) & np.uint64((1 << 8 * CODE_BYTES) - 1)


def _planes(values: np.ndarray) -> bytes:
    """Sorted codes, byte place by byte place: the leading ones repeat, and so compress."""
    return values.view(np.uint8).reshape(-1, 8)[:, :CODE_BYTES].T.tobytes()


def _values(packed: bytes) -> np.ndarray:
    n = len(packed) // CODE_BYTES
    out = np.zeros((n, 8), np.uint8)
    out[:, :CODE_BYTES] = np.frombuffer(packed, np.uint8).reshape(CODE_BYTES, n).T
    return out.reshape(-1).view(np.uint64)


class Chunk:
    """The rows of a chunk, cut into units a slice at a time."""

    def __init__(self, table: pa.Table, units: Units):
        self.units, self.ids = units, table["id"].to_numpy()
        self.data, self.bounds = utf8(table["text"])

    def slices(self) -> Iterator[tuple]:
        """First row, bytes, row of each unit, unit bounds, and phrases of each slice."""
        for a, b in slices(self.bounds):
            part, at = self.data[self.bounds[a] : self.bounds[b]], self.bounds[a : b + 1] - self.bounds[a]
            numbers, row, begin, end = self.units.split(part, at)
            yield a, part, row, begin, end, phrases_of(numbers, row, self.units.length, self.units.gram)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """The different anchors, sorted, and whether rows of two ids have them."""
        parts = [(found.anchor, self.ids[found.row + a]) for a, *_, found in self.slices()]
        hashes, owner = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        order = np.argsort(hashes, kind="stable")
        hashes, owner = hashes[order], owner[order]
        head = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1]))) if len(hashes) else np.zeros(0, np.int64)
        if not len(head):
            return hashes, np.zeros(0, bool)
        return hashes[head], np.minimum.reduceat(owner, head) != np.maximum.reduceat(owner, head)


def shared_anchors(chunks: DataFrame, units: Units, buckets: int) -> DataFrame:
    """For each chunk the packed codes of its anchors that another chunk has too."""

    def ask(table: pa.Table) -> pa.Table:
        bucket, code = _codes(Chunk(table, units).anchors()[0], buckets)
        order = np.lexsort((code, bucket))
        bucket, code = bucket[order], code[order]
        cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
        chunk = table["chunk"][0].as_py()
        return pa.table({
            "bucket": pa.array(bucket[cut].tolist(), pa.int32()), "chunk": pa.array([chunk] * len(cut), pa.int32()),
            "codes": pa.array([_planes(code[a:b]) for a, b in zip(cut, np.append(cut[1:], len(code)))], pa.binary()),
        })

    def tell(table: pa.Table) -> pa.Table:
        parts = [np.unique(_values(x)) for x in table["codes"].to_pylist()]
        every, count = np.unique(np.concatenate(parts), return_counts=True)
        many = every[count > 1]
        answers = [part[np.isin(part, many, assume_unique=True)] for part in parts]
        return pa.table({"chunk": table["chunk"].cast(pa.int32()), "bucket": table["bucket"].cast(pa.int32()), "codes": pa.array([_planes(x) for x in answers], pa.binary())})

    return chunks.groupBy("chunk").applyInArrow(ask, ASKED).groupBy("bucket").applyInArrow(tell, TOLD)


# a message of phrases: of one chunk for one block; or, with known set, runs that only pass through
PHRASES = "block int, chunk int, known boolean, ids binary, digests binary, anchors binary, firsts binary, sizes binary, phrases binary"
RUNS = "chunk int, ids binary, digests binary, firsts binary, sizes binary"


def duplicate_windows(chunks: DataFrame, units: Units, parts: int, compare: Callable) -> DataFrame:
    """For each chunk packed runs of windows (id, digest, first, number) that also start in a row of a smaller id.

    ``compare`` gets the distinct phrases of a block, sorted by anchor, with the smallest id of
    each, and marks each one's windows that a phrase of a smaller id holds.
    """

    def send(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _messages([], 0)
        held = Chunk(table, units)
        digest = table["digest"].to_numpy()
        anchors, twin = held.anchors()
        bucket, code = _codes(anchors, parts)
        known = [(np.uint64(b) << np.uint64(8 * CODE_BYTES)) | _values(c) for b, c in zip(told["bucket"].to_pylist(), told["codes"].to_pylist())]
        elsewhere = np.isin((bucket.astype(np.uint64) << np.uint64(8 * CODE_BYTES)) | code, np.concatenate(known)) if known else np.zeros(len(anchors), bool)
        wanted = anchors[twin | elsewhere]
        cells: dict[tuple[int, bytes], list[tuple[int, int, int, int]]] = {}
        for a, part, row, begin, end, found in held.slices():
            raw = part.tobytes()
            base = np.searchsorted(row, np.arange(int(row[-1]) + 2)) if len(row) else None
            for j in np.flatnonzero(np.isin(found.anchor, wanted)).tolist():
                first, many, i = int(found.first[j]), int(found.windows[j]), int(found.row[j])
                last = first + many + units.length - 2
                phrase = raw[first : last + 1] if begin is None else raw[begin[first] : end[last]]
                cells.setdefault((int(found.anchor[j]), phrase), []).append((int(held.ids[a + i]), int(digest[a + i]), first - int(base[i]), many))
        return _messages_of(cells, table["chunk"][0].as_py(), parts)

    def resolve(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        entries: list[tuple] = []  # anchor, phrase, id, digest, first, windows, chunk
        for r in rows:
            if not r["known"]:
                sizes = np.frombuffer(r["sizes"], np.uint32).reshape(2, -1)
                ends = np.cumsum(sizes[1]).tolist()
                pieces = [r["phrases"][a:b] for a, b in zip([0, *ends], ends)]
                columns = (np.frombuffer(r[c], k).tolist() for c, k in (("anchors", np.int64), ("ids", np.int64), ("digests", np.int64), ("firsts", np.uint32)))
                anchor, ids, digests, firsts = columns
                entries += zip(anchor, pieces, ids, digests, firsts, sizes[0].tolist(), [r["chunk"]] * len(pieces))
        entries.sort(key=lambda e: e[:3])
        heads = [i for i in range(len(entries)) if i == 0 or entries[i][:2] != entries[i - 1][:2]]
        marks = compare([entries[i][0] for i in heads], [entries[i][1] for i in heads], [entries[i][2] for i in heads])
        runs: dict[int, list[tuple]] = {}
        for n, i in enumerate(heads):
            for e in entries[i : heads[n + 1] if n + 1 < len(heads) else len(entries)]:
                whole = [(0, e[5])] if e[2] > entries[i][2] else marks[n]
                for a, b in whole or ():
                    runs.setdefault(e[6], []).append((e[2], e[3], e[4] + a, b - a))
        out = [(r["chunk"], r["ids"], r["digests"], r["firsts"], r["sizes"]) for r in rows if r["known"]]
        for chunk, found in runs.items():
            ids, digests, firsts, sizes = zip(*found)
            out.append((chunk, _pack(np.array(ids), np.int64), _pack(np.array(digests), np.int64), _pack(np.array(firsts), np.uint32), _pack(np.array(sizes), np.uint32)))
        kinds = (pa.int32(), *[pa.binary()] * 4)
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("chunk", "ids", "digests", "firsts", "sizes"), list(zip(*out)) or [[]] * 5, kinds)})

    told = shared_anchors(chunks, units, parts)
    sent = chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(send, PHRASES)
    return sent.groupBy("block").applyInArrow(resolve, RUNS)


def _messages_of(cells: dict, chunk: int, blocks: int) -> pa.Table:
    """The phrases of a chunk by block, each for its smallest id, and what is known of its other copies."""
    known: list[tuple] = []
    by_block: dict[int, list[tuple]] = {}
    for (anchor, phrase), places in cells.items():
        least = min(p[0] for p in places)
        for id_, digest, first, many in places:
            if id_ > least:
                known.append((id_, digest, 0, first, many, b""))
            else:
                by_block.setdefault(anchor % blocks, []).append((id_, digest, anchor, first, many, phrase))
    rows = [(block, False, found) for block, found in by_block.items()]
    return _messages(rows + ([(chunk % blocks, True, known)] if known else []), chunk)


def _messages(rows: list[tuple], chunk: int) -> pa.Table:
    out = []
    for block, known, found in rows:
        ids, digests, anchors, firsts, many, phrases = zip(*found)
        sizes = [many] if known else [many, list(map(len, phrases))]
        out.append((
            block, chunk, known, _pack(np.array(ids), np.int64), _pack(np.array(digests), np.int64), b"" if known else _pack(np.array(anchors), np.int64),
            _pack(np.array(firsts), np.uint32), _pack(np.array(sizes), np.uint32), b"".join(phrases),
        ))
    kinds = (pa.int32(), pa.int32(), pa.bool_(), *[pa.binary()] * 6)
    names = ("block", "chunk", "known", "ids", "digests", "anchors", "firsts", "sizes", "phrases")
    return pa.table({n: pa.array(c, k) for n, c, k in zip(names, list(zip(*out)) or [[]] * 9, kinds)})


def keyed(documents: DataFrame) -> DataFrame:
    """``id, digest, text``: ids without nulls, and a digest that keeps rows of one id and other text apart."""
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("digest"), "text")


def with_duplicates(documents: DataFrame, units: Units, compare: Callable, count: Callable, keep: Callable) -> DataFrame:
    """``doc_id, n_units, spans, kept``: every row with its unit spans that windows of smaller ids cover, and the rest.

    ``count`` gives a text's (bytes) number of units, ``keep`` the text without the marked ones.
    """
    pieces, parts = dealt(documents, CHUNK_BYTES, BLOCK_BYTES)
    chunk = F.pmod(F.xxhash64("id", "text"), F.lit(pieces)).cast("int")
    chunks = keyed(documents).select("id", "digest", "text", chunk.alias("chunk"))

    def apply(table: pa.Table, told: pa.Table) -> pa.Table:
        runs: dict[tuple[int, int], list[np.ndarray]] = {}
        if told.num_rows:
            ids, digests = (np.concatenate([np.frombuffer(x, np.int64) for x in told[c].to_pylist()]) for c in ("ids", "digests"))
            pairs = np.column_stack([np.concatenate([np.frombuffer(x, np.uint32) for x in told[c].to_pylist()]) for c in ("firsts", "sizes")]).astype(np.int64)
            order = np.lexsort((digests, ids))
            ids, digests, pairs = ids[order], digests[order], pairs[order]
            cut = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (digests[1:] != digests[:-1])))) if len(ids) else []
            for a, b in zip(cut, np.append(cut[1:], len(ids))):
                runs[int(ids[a]), int(digests[a])] = pairs[a:b]
        counts, spans, kept = [], [], []
        for id_, digest, text in zip(table["id"].to_pylist(), table["digest"].to_pylist(), table["text"].to_pylist()):
            raw = (text or "").encode()
            counts.append(count(raw))
            marks = marked(runs.get((id_, digest)), counts[-1], units.length)
            spans.append([] if marks is None else spans_of(marks))
            kept.append(keep(raw, marks))
        return pa.table({"id": table["id"].cast(pa.int64()), "n_units": pa.array(counts, pa.int64()), "spans": pa.array(spans, SPANS), "kept": pa.array(kept, pa.binary())})

    covered = duplicate_windows(chunks, units, parts, compare)
    done = chunks.groupBy("chunk").cogroup(covered.groupBy("chunk")).applyInArrow(apply, "id long, n_units long, spans array<struct<start:int,end:int>>, kept binary")
    return done.select(F.nullif("id", F.lit(NO_ID)).alias("doc_id"), "n_units", "spans", "kept")


def marked(runs: np.ndarray | None, count: int, length: int) -> np.ndarray | None:
    """Which of ``count`` units lie in a window of the runs (first window, number)."""
    if runs is None:
        return None
    edge = np.zeros(count + 1, np.int64)
    np.add.at(edge, runs[:, 0], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1] + length - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def spans_of(marks: np.ndarray) -> list[dict[str, int]]:
    """The maximal runs of marked units."""
    edge = np.diff(np.concatenate(([0], marks.astype(np.int8), [0])))
    return [{"start": a, "end": b} for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())]


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
