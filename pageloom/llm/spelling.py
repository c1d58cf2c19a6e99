"""Spelling variant grouping: words at one edit, found in a trie over the words' letter-group counts.

One edit changes the counts of a word's letter groups by one surplus, one deficit, or one of each.
So the words are arranged in a trie whose levels are the word's length and its counts of one
letter group after the other; a search walks it depth first with a budget of one surplus and one
deficit, and compares letters only at the leaves. The trie's upper levels deal the words to
tasks, the lower ones are walked inside a task, for all of its searched words at once.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runs import fold, pieces, runs
from .text import slices, utf8

#: Letter groups, the levels of the trie after the length; letters of none of them share a last group.
GROUPS = ("e", "n", "a", "i", "t", "r", "o", "s", "d", "h", "l", "u", "c", "m", "gw", "pf", "by", "kv", "jqxz")
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), 0xC3]] = True  # 0xC3 leads U+00C0 to U+00FF in UTF-8
CELL_WORDS = 8_000  # words, and searched words, of one task's part of a node
NODE_ROWS = 200_000  # nodes (a few bytes each) up to which their sizes are broadcast; beyond, they are joined by a shuffle
LEAF = 64  # words in a leaf
PAIRS = 1 << 18  # pairs of words whose letters are compared at once
SLICE = 8 << 20
#: Occurrences are damaged for the test's sake: one letter goes where a checksum is divisible by this.
EVERY = 199


def words(documents: DataFrame, least_length: int = 6, least_count: int = 5, every: int = EVERY) -> DataFrame:
    """``word, n``: runs of Latin letters, A-Z in lower case, counted over all texts.

    Of an occurrence whose CRC-32 of ``<doc_id>:<run>`` is divisible by ``every`` the letter at the
    checksum modulo the run's length is deleted first; a null id is written as nothing.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = utf8(batch.column("text"))
            ids = [(x or "").encode() for x in batch.column("doc_id").to_pylist()]
            for a, b in slices(bounds, SLICE):
                found, n = counted(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], ids[a:b], least_length, every)
                yield pa.RecordBatch.from_arrays([found.cast(pa.string()), pa.array(n, pa.int64())], ["word", "n"])

    each = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(count, "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def counted(data: np.ndarray, bounds: np.ndarray, ids: list[bytes], least_length: int, every: int) -> tuple[pa.Array, np.ndarray]:
    """The words of a slice of rows and their numbers."""
    data = fold(data)
    lead = data == 0xC3
    inside = LETTER[data] | np.concatenate(([False], lead[:-1]))
    starts, ends, rows = runs(inside, bounds)
    coded = pieces(data, inside, starts, ends).dictionary_encode()
    codes, distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    n = np.bincount(codes, minlength=len(distinct))
    sizes = np.array([len(w) for w in distinct], np.int64)
    letters = sizes - np.array([w.count(b"\xc3") for w in distinct], np.int64)
    sums = checksums(ids, rows, codes, distinct, sizes)
    hurt = np.flatnonzero(sums % np.uint32(every) == 0)
    n -= np.bincount(codes[hurt], minlength=len(distinct))
    kept = np.flatnonzero((n > 0) & (letters >= least_length))
    rest = []
    for code, place in zip(codes[hurt].tolist(), (sums[hurt] % letters[codes[hurt]]).tolist()):
        if letters[code] > least_length:
            word = distinct[code].decode()
            rest.append((word[:place] + word[place + 1 :]).encode())
    every_word = pa.concat_arrays([coded.dictionary.take(pa.array(kept)), pa.array(rest, pa.large_binary())])
    return every_word, np.concatenate((n[kept], np.ones(len(rest), np.int64)))


def checksums(ids: list[bytes], rows: np.ndarray, codes: np.ndarray, distinct: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of ``<id>:<word>`` for all words: that of the id's part, moved over the word's bytes, combined with the word's own.

    Moving over ``size`` bytes is linear, so it is a table of four bytes' images for each size.
    """
    heads = np.array([zlib.crc32(i + b":") for i in ids], np.uint32)[rows] if ids else np.zeros(0, np.uint32)
    own = np.array([zlib.crc32(w) for w in distinct], np.uint32)
    out = own[codes]
    size = sizes[codes]
    order = np.argsort(size, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
        if len(part):
            table, head = _moved(int(size[part[0]])), heads[part]
            for byte in range(4):
                out[part] ^= table[byte][(head >> np.uint32(8 * byte)) & np.uint32(255)]
    return out


def _moved(size: int) -> np.ndarray:
    """For each byte of a checksum, and each of its values, the image after ``size`` more bytes."""
    zeros = bytes(size)
    bits = [zlib.crc32(zeros, 1 << bit) ^ zlib.crc32(zeros) for bit in range(32)]
    table = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for bit in range(8):
            table[byte] ^= np.where(np.arange(256) >> bit & 1, np.uint32(bits[8 * byte + bit]), np.uint32(0))
    return table


def vectors(letters: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Length and letter-group counts of words given as rows of Latin-1 codes."""
    groups = np.full(256, len(GROUPS), np.int64)
    for level, group in enumerate(GROUPS):
        groups[[ord(c) for c in group]] = level
    out = np.zeros((len(letters), len(GROUPS) + 2), np.int32)
    out[:, 0] = lengths
    rows, places = np.nonzero(letters)
    np.add.at(out, (rows, 1 + groups[letters[rows, places]]), 1)
    return out


def node(word: str, levels: int) -> Column:
    """Length and the first ``levels`` group counts of a word, as an array."""
    bare = lambda group: F.length(F.translate(F.col(word), group, ""))
    return F.array(F.length(word), *[F.length(word) - bare(group) for group in GROUPS[:levels]])


def reachable(levels: int) -> list[list[int]]:
    """What a search may differ by in length and the upper levels.

    A search finds shorter words by one deficit, and words of its own length by a surplus before a
    deficit, or by neither. The other halves of both are found from the other side.
    """
    unit = lambda **at: [at.get(f"g{i}", 0) for i in range(levels)]
    shorter = [[-1, *unit()], *([-1, *unit(**{f"g{i}": -1})] for i in range(levels))]
    equal = [[0, *unit()], *([0, *unit(**{f"g{i}": 1})] for i in range(levels))]
    both = [[0, *unit(**{f"g{i}": 1, f"g{j}": -1})] for i in range(levels) for j in range(i + 1, levels)]
    return shorter + equal + both


class Trie:
    """Words sorted by their vectors; a node is a range of them with equal counts up to its level."""

    def __init__(self, words: list[str]):
        self.letters, self.lengths = _letters(words)
        found = vectors(self.letters, self.lengths)
        order = np.lexsort(found.T[::-1])
        self.words, self.vectors = order, found[order]

    def walk(self, asked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Depth first: leaves, as places of words, and the searches (rows of vectors) that reach each within the budget."""
        none = np.zeros(len(asked), np.int8)
        stack = [(0, len(self.vectors), 0, np.arange(len(asked)), none, none)]
        while stack:
            low, high, level, alive, surplus, deficit = stack.pop()
            if level == self.vectors.shape[1] or high - low <= LEAF:
                yield self.words[low:high], alive
                continue
            counts = self.vectors[low:high, level]
            edges = np.concatenate(([0], np.flatnonzero(np.diff(counts)) + 1, [high - low]))
            own = asked[alive, level]
            for a, b in zip(edges[:-1], edges[1:]):
                more = counts[a] - own
                if level == 0:  # a search goes to words of its own length, or one shorter
                    some = (more == 0) | (more == -1)
                    plus, minus = none[alive], none[alive]
                else:
                    plus, minus = surplus + np.maximum(more, 0), deficit + np.maximum(-more, 0)
                    shorter = asked[alive, 0] != self.vectors[low, 0]
                    some = (minus <= 1) & (plus <= np.where(shorter, 0, 1)) & (shorter | (minus <= plus))
                if some.any():
                    stack.append((low + a, low + b, level + 1, alive[some], plus[some].astype(np.int8), minus[some].astype(np.int8)))


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Words as rows of Latin-1 codes, filled with zeros, and their lengths."""
    lengths = np.array([len(w) for w in words], np.int64)
    width = int(lengths.max(initial=1))
    return np.frombuffer(b"".join(w.encode("latin-1").ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width), lengths


def one_edit(one: np.ndarray, two: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Whether pairs of rows of letters differ by one replaced letter, or (``shorter``) the second lacks one of the first's."""
    width = max(one.shape[1], two.shape[1]) + 1
    one, two = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (one, two))
    unequal = one != two
    after = one[:, 1:] != two[:, :-1]
    before = np.logical_or.accumulate(unequal, axis=1)[:, :-1]
    return np.where(shorter, ~(before & after).any(axis=1), unequal.sum(axis=1) == 1)


def allowed(found: np.ndarray, asked: np.ndarray, less: np.ndarray) -> np.ndarray:
    """Whether pairs of vectors are within the budget, each unordered pair of words from one side only."""
    more = found - asked
    rest = more[:, 1:]
    plus, minus = np.maximum(rest, 0).sum(axis=1), np.maximum(-rest, 0).sum(axis=1)
    first = rest[np.arange(len(rest)), np.argmax(rest != 0, axis=1)]
    equal = (more[:, 0] == 0) & np.where(plus == 0, (minus == 0) & less, (plus == 1) & (minus == 1) & (first > 0))
    return equal | ((more[:, 0] == -1) & (plus == 0) & (minus == 1))


def near_words(found: list[str], asked: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``found`` and ``asked`` of all pairs at one edit.

    The longer word asks; of two words of one length the one that lacks the first differing group's
    letter, or with equal vectors the greater.
    """
    trie = Trie(found)
    letters, lengths = _letters(asked)
    own = vectors(letters, lengths)
    rank = np.unique(np.array([*found, *asked]), return_inverse=True)[1]
    of_found, of_asked = rank[: len(found)], rank[len(found) :]
    sorted_place = np.empty(len(found), np.int64)
    sorted_place[trie.words] = np.arange(len(found))
    lefts, rights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for leaf, alive in trie.walk(own):
        step = max(1, PAIRS // len(leaf))
        for low in range(0, len(alive), step):
            some = alive[low : low + step]
            left, right = np.repeat(leaf, len(some)), np.tile(some, len(leaf))
            kept = np.flatnonzero(allowed(trie.vectors[sorted_place[left]], own[right], of_found[left] < of_asked[right]))
            left, right = left[kept], right[kept]
            same = one_edit(letters[right], trie.letters[left], lengths[right] != trie.lengths[left])
            lefts.append(left[same])
            rights.append(right[same])
    return np.concatenate(lefts), np.concatenate(rights)


def meet(table: pa.Table) -> pa.Table:
    """For one part of a node: of each word with near words here their number and the best of them."""
    asks = table["asks"].to_numpy()
    all_words, n = table["word"].to_pylist(), table["n"].to_numpy()
    found, asked = np.flatnonzero(~asks), np.flatnonzero(asks)
    left, right = near_words([all_words[i] for i in found], [all_words[i] for i in asked]) if len(found) and len(asked) else ([], [])
    left, right = found[left], asked[right]
    name, rank = np.unique(np.array(all_words), return_inverse=True) if all_words else (np.zeros(0, "U1"), np.zeros(0, np.int64))
    own, near = np.concatenate((left, right)), np.concatenate((right, left))
    order = np.lexsort((rank[near], -n[near], rank[own]))
    each, first, times = np.unique(rank[own][order], return_index=True, return_counts=True)
    best = near[order][first]
    return pa.table({
        "word": pa.array(name[each].tolist(), pa.string()), "n_near": pa.array(times, pa.int64()),
        "best": pa.array([all_words[i] for i in best], pa.string()), "best_n": pa.array(n[best], pa.int64()),
    })


def near(vocabulary: DataFrame, size: int, cell_words: int = CELL_WORDS) -> DataFrame:
    """``word, n_near, best, best_n`` of the words that have near words in the vocabulary.

    A word stands at one node of the trie's upper levels, and asks at every node within the budget.
    A node with many words, or many that ask there, is cut into parts: each task holds
    one part of the words and one of the askers, so no letter pattern gathers its words in one task.
    """
    levels = min(len(GROUPS), max(2, math.ceil(math.log(max(size, 1) / cell_words, 3))))
    own = node("word", levels)
    key = lambda counts: F.array_join(F.transform(counts, lambda x: x.cast("string")), ".")
    steps = F.array(*[F.array(*[F.lit(x) for x in step]) for step in reachable(levels)])
    targets = F.filter(F.transform(steps, lambda step: F.zip_with(own, step, lambda x, y: x + y)), lambda counts: F.forall(counts, lambda x: x >= 0))
    found = vocabulary.select("word", "n", key(own).alias("node"), F.lit(False).alias("asks"))
    asked = vocabulary.select("word", "n", F.explode(F.transform(targets, key)).alias("node"), F.lit(True).alias("asks"))
    parts = lambda rows, name: rows.groupBy("node").agg(F.ceil(F.count("*") / cell_words).cast("int").alias(name))
    nodes = parts(found, "cuts").join(parts(asked, "ask_cuts"), "node").checkpoint()
    rows = found.unionAll(asked).join(F.broadcast(nodes) if nodes.count() <= NODE_ROWS else nodes, "node")
    deal = F.xxhash64("word")
    one = lambda cuts: F.array(F.pmod(deal, F.col(cuts)).cast("int"))
    every = lambda cuts: F.sequence(F.lit(0), F.col(cuts) - 1)
    rows = rows.withColumn("cut", F.explode(F.when(F.col("asks"), every("cuts")).otherwise(one("cuts"))))
    rows = rows.withColumn("ask_cut", F.explode(F.when(F.col("asks"), one("ask_cuts")).otherwise(every("ask_cuts"))))
    # the walk takes far longer than its rows take to send, so its tasks are not made fewer by their bytes
    rows = rows.repartition(int(vocabulary.sparkSession.conf.get("spark.sql.shuffle.partitions")), "node", "cut", "ask_cut")
    met = rows.groupBy("node", "cut", "ask_cut").applyInArrow(meet, "word string, n_near long, best string, best_n long")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.word").alias("best"), (-F.col("b.less")).alias("best_n"))


def roots(forms: DataFrame, hops: int) -> DataFrame:
    """``word, root`` of the words that have a form: forms are followed to the last, at most ``hops`` of them, by doubling."""
    ends = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(max(hops, 1)))):
        ends = ends.checkpoint()
        on = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ends = ends.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return ends


def variants(documents: DataFrame, least_length: int = 6, least_count: int = 5, ratio: int = 5, every: int = EVERY, cell_words: int = CELL_WORDS) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of all words of the texts (see :func:`words`).

    ``form`` is the near word (one letter inserted, deleted or replaced) of largest ``n``, the smallest of
    equal ones, if that is at least ``ratio`` times the word's own ``n``; ``root`` follows forms to the
    last, and is the word itself without one. Each form is ``ratio`` times as frequent as its
    word, so chains are short and doubling ends after a few joins.

    Null and empty texts have no words; a null id is written as nothing in the checksum. Repeated
    rows count as often as they occur. Runs of any length are words like others. Empty tables
    give no rows; other columns are not looked at.
    """
    vocabulary = words(documents, least_length, least_count, every).checkpoint()
    size, most = vocabulary.agg(F.count("*"), F.max("n")).first()
    rows = vocabulary.join(near(vocabulary, size, cell_words), "word", "left")
    form = F.col("best_n") >= ratio * F.col("n")
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(form, F.col("best")).alias("form"), F.when(form, F.col("best_n")).alias("form_n")).checkpoint()
    hops = math.floor(math.log(max(most or 1, 1) / least_count, ratio) + 1e-9) if size else 0
    found = roots(rows.where(F.col("form").isNotNull()), max(hops, 1))
    return rows.join(found, "word", "left").withColumn("root", F.coalesce("root", "word"))
