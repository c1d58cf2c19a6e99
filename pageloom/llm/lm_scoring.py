"""Stupid-backoff scores from n-gram counts over all documents, each document left out of its own counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dealing import dealt
from .text import grams, slices, utf8, word_hashes, words

ORDER = 3
BACKOFF = 0.4
#: n-grams travel as 48 bits of their hash beside their bucket, which the hash picks too.
CODE_BYTES = 6
ASKED = "bucket int, chunk int, order int, grams binary, counts binary"
TOLD = "chunk int, order int, bucket int, counts binary"
SCORES = "doc_id long, n_words long, log_score double, n_backed_off long"


def _planes(values: np.ndarray) -> bytes:
    """Sorted codes byte place by byte place: the leading ones repeat, and so compress."""
    return values.view(np.uint8).reshape(-1, 8)[:, :CODE_BYTES].T.tobytes()


def _code(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes // np.uint64(buckets)) & np.uint64((1 << 8 * CODE_BYTES) - 1)


def _small(counts: np.ndarray) -> bytes:
    """Counts of a message, 7 bits at a time and place by place; high places are mostly zero, and so compress."""
    counts = counts.astype(np.uint64)
    out, rest = [], counts
    width = max(1, -(-int(counts.max(initial=0)).bit_length() // 7))
    for _ in range(width):
        out.append((rest & np.uint64(127)).astype(np.uint8))
        rest = rest >> np.uint64(7)
    return bytes([width]) + np.concatenate(out).tobytes() if len(counts) else b"\1"


def _counts(packed: bytes) -> np.ndarray:
    width = packed[0]
    places = np.frombuffer(packed, np.uint8, offset=1).reshape(width, -1).astype(np.int64)
    return (places << (7 * np.arange(width))[:, None]).sum(0)


def _values(packed: bytes) -> np.ndarray:
    n = len(packed) // CODE_BYTES
    out = np.zeros((n, 8), np.uint8)
    out[:, :CODE_BYTES] = np.frombuffer(packed, np.uint8).reshape(CODE_BYTES, n).T
    return out.reshape(-1).view(np.uint64)


class ChunkGrams:
    """The n-grams of a chunk of rows: for each order the different ones, their counts, and which one stands where."""

    def __init__(self, table: pa.Table, buckets: int):
        data, bounds = utf8(table["text"])
        rows, hashes = [], []
        for a, b in slices(bounds):
            part, at = data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
            starts, ends, row = words(part, at)
            rows.append(row + a)
            hashes.append(word_hashes(part, starts, ends))
        self.row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        unit = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.n_rows, self.unit = table.num_rows, unit
        self.buckets = buckets
        self.made: dict[int, tuple] = {}
        self.lists: dict[int, tuple] = {}
        self.counts: dict[int, np.ndarray] = {}

    def order(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts within one row, the different n-grams, the number of each start's, and their counts in the chunk."""
        if n not in self.made:
            at = np.arange(max(len(self.row) - n + 1, 0))
            if n > 1 and len(at):
                at = at[self.row[at] == self.row[at + n - 1]]
            every = (grams(self.unit, n)[at] if n > 1 else self.unit[at]) if len(at) else np.zeros(0, np.uint64)
            different, place, count = np.unique(every, return_inverse=True, return_counts=True)
            self.made[n] = at, different, place, count
        return self.made[n]

    def sent(self, n: int, told: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What a chunk asks about an order: places in the list of its n-grams, buckets and codes, in the order of sending.

        Above pairs only n-grams whose two shorter ones other rows hold. Each round makes the
        same list from the same rows, so an answer need not name what it answers.
        """
        if n not in self.lists:
            _, different, place, _ = self.order(n)
            at = np.arange(len(different))
            if n > 2:
                shorter = np.zeros(len(self.row), bool)
                shorter[self.order(n - 1)[0][self.elsewhere(n - 1, told) > 0]] = True
                start = self.order(n)[0]
                worth = np.zeros(len(different), bool)
                worth[place[shorter[start] & shorter[start + 1]]] = True
                at = np.flatnonzero(worth)
            bucket, code = (different[at] % np.uint64(self.buckets)).astype(np.int64), _code(different[at], self.buckets)
            by = np.lexsort((code, bucket))
            self.lists[n] = at[by], bucket[by], code[by]
        return self.lists[n]

    def elsewhere(self, n: int, told: dict) -> np.ndarray:
        """For each start of an n-gram its count in all other rows."""
        if n in self.counts:
            return self.counts[n]
        at, different, place, count = self.order(n)
        where, bucket, _ = self.sent(n, told)
        outside = np.zeros(len(different), np.int64)
        edges = np.searchsorted(bucket, np.arange(self.buckets + 1))
        for (order, b), packed in told.items():
            if order == n:
                outside[where[edges[b] : edges[b + 1]]] = _counts(packed)
        total = (count + outside)[place]
        own = np.ones(len(at), np.int64)
        several = np.flatnonzero(count[place] > 1)
        if len(several):
            code = self.row[at[several]] * np.int64(len(different)) + place[several]
            _, back, many = np.unique(code, return_inverse=True, return_counts=True)
            own[several] = many[back]
        self.counts[n] = total - own
        return self.counts[n]


def _questions(held: ChunkGrams | None, orders: range, told: dict, chunk: int) -> pa.Table:
    """The n-grams of a chunk with their counts in it, one row for each order and bucket."""
    rows = []
    for n in orders if held is not None else ():
        where, bucket, code = held.sent(n, told)
        count = held.order(n)[3][where]
        cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
        for a, b in zip(cut, np.append(cut[1:], len(bucket))):
            rows.append((int(bucket[a]), chunk, n, _planes(code[a:b]), _small(count[a:b])))
    columns = list(zip(*rows)) or [[]] * 5
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.table({name: pa.array(c, k) for name, c, k in zip(("bucket", "chunk", "order", "grams", "counts"), columns, kinds)})


def _told(table: pa.Table) -> dict[tuple[int, int], bytes]:
    """The answers to a chunk by order and bucket."""
    return dict(zip(zip(table["order"].to_pylist(), table["bucket"].to_pylist()), table["counts"].to_pylist()))


def _answers(table: pa.Table) -> pa.Table:
    """The count table of a bucket: to each question what other chunks add to the asker's own counts, in the same order."""
    columns = {c: table[c].to_pylist() for c in ("bucket", "chunk", "order", "grams", "counts")}
    rows = []
    for n in sorted(set(columns["order"])):
        mine = [i for i, o in enumerate(columns["order"]) if o == n]
        parts = [_values(columns["grams"][i]) for i in mine]
        counts = [_counts(columns["counts"][i]) for i in mine]
        _, place = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(place, weights=np.concatenate(counts)).astype(np.int64)[place]
        at = 0
        for i, count in zip(mine, counts):
            rest = total[at : at + len(count)] - count
            at += len(count)
            if rest.any():
                rows.append((columns["chunk"][i], n, columns["bucket"][i], _small(rest)))
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.table({name: pa.array(c, k) for name, c, k in zip(("chunk", "order", "bucket", "counts"), list(zip(*rows)) or [[]] * 4, kinds)})


def backoff_scores(documents: DataFrame, order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """``doc_id, n_words, log_score, n_backed_off``: the natural log of each text's score, summed over its words.

    A word scores the relative frequency of the longest n-gram that ends in it and that
    another row holds, times ``backoff`` for each order given up; a word that no other row
    holds counts as half a time among all others. Counts cover all rows but the scored one.

    Count tables are dealt by hash. Each chunk of rows sends each of its n-grams once, with
    its count, and hears what other chunks add; so a word of every row is one entry for each
    chunk. n-grams above pairs are sent only where both of their shorter ones occur in other
    rows, as no other can. The texts dealt to chunks are one exchange, read by each round. Chunks
    and buckets follow the length of the texts (:func:`dealing.dealt`), not the partitions.

    A null or empty text has no words and scores 0; null ids stay; a repeated row counts as
    another row; no rows give no rows; other columns are not looked at.
    """
    pieces, buckets = dealt(documents)
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(pieces)).cast("int")
    chunks = documents.select("doc_id", "text", chunk.alias("chunk"))

    def ask_first(table: pa.Table) -> pa.Table:
        return _questions(ChunkGrams(table, buckets), range(1, min(order, 2) + 1), {}, table["chunk"][0].as_py())

    def ask_next(n: int):
        def ask(table: pa.Table, answers: pa.Table) -> pa.Table:
            if not table.num_rows:
                return _questions(None, range(0), {}, 0)
            return _questions(ChunkGrams(table, buckets), range(n, n + 1), _told(answers), table["chunk"][0].as_py())

        return ask

    answers = chunks.groupBy("chunk").applyInArrow(ask_first, ASKED).groupBy("bucket").applyInArrow(_answers, TOLD)
    for n in range(3, order + 1):
        asked = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(ask_next(n), ASKED)
        answers = answers.unionByName(asked.groupBy("bucket").applyInArrow(_answers, TOLD))
    total = count_words(documents)

    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        held, told = ChunkGrams(table, buckets), _told(answers)
        n_words = np.bincount(held.row, minlength=held.n_rows)
        others = np.maximum(total - n_words, 0)[held.row] + 1.0
        before = held.elsewhere(1, told)
        value = (before + 0.5) / others
        depth = np.ones(len(held.row), np.int64)
        context = before.astype(float)  # counts of the n - 1 words that start here
        for n in range(2, order + 1):
            at, _, _, _ = held.order(n)
            seen = held.elsewhere(n, told)
            counts = np.zeros(len(held.row))
            counts[at] = seen
            last = at + n - 1
            found = seen > 0
            value[last[found]] = seen[found] / context[at[found]]
            depth[last[found]] = n
            context = counts
        # an n-gram at a row's start cannot be longer than what stands before
        first = np.concatenate(([0], np.cumsum(n_words)))[held.row]
        possible = np.minimum(order, np.arange(len(held.row)) - first + 1)
        value = np.log(value) + np.log(backoff) * (possible - depth)
        return pa.table({
            "doc_id": table["doc_id"].cast(pa.int64()), "n_words": pa.array(n_words.astype(np.int64)),
            "log_score": pa.array(np.bincount(held.row, weights=value, minlength=held.n_rows).astype(float)),
            "n_backed_off": pa.array(np.bincount(held.row, weights=possible > depth, minlength=held.n_rows).astype(np.int64)),
        })

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, SCORES)


def count_words(documents: DataFrame) -> int:
    """The number of words of all texts: one narrow scan, one sum."""
    from .packing import token_counts

    return token_counts(documents).agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]


def report(documents: DataFrame) -> DataFrame:
    """Scores with their mean per word."""
    scored = backoff_scores(documents)
    mean = F.when(F.col("n_words") > 0, F.round(F.col("log_score") / F.col("n_words"), 6)).otherwise(F.lit(0.0))
    return scored.select("doc_id", "n_words", "n_backed_off", mean.alias("mean_log_score"))
