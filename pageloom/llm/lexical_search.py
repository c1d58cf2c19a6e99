"""Ranked lexical search, reversed: the items' terms are the index, and the documents stream through it.

Few items are asked, very many documents answer. So the inverted index is built over the
items' terms and broadcast; every task streams its documents' term counts through it and keeps
a bounded heap for each item. Only heaps are shuffled, never a document or a posting.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runs import fold, pieces, runs
from .text import slices, utf8

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
INSIDE = np.ones(256, bool)
INSIDE[[b for b in range(128) if not chr(b).isalnum()]] = False
PASS_ROWS = 500_000  # (item, term) pairs of the index in one broadcast
CELLS = 1 << 20  # scores of (document, item) held at once
MERGES = 64  # parts in which the tasks' heaps are merged first
#: Scale of scores: a term's weight, its saturation, and the share of a document's length in it.
WEIGHT, UNIT, TENTH, SLOPE = 1000, 1_000_000_000, 1000, 12


@dataclass
class Index:
    """Inverted lists: term ``t`` has ``items[first[t]:first[t + 1]]`` with ``times`` of its repeats."""

    ids: np.ndarray
    null_id: np.ndarray
    terms: pa.LargeBinaryArray
    first: np.ndarray
    items: np.ndarray
    times: np.ndarray


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id, term, times`` of all items; rows of one id are one item, a null id is an id of its own."""
    upper = "".join(map(chr, range(65, 91)))
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), upper, upper.lower())
    each = items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(F.regexp_extract_all(text, F.lit(TERM), F.lit(0))).alias("term"))
    return each.groupBy("item_id", "term").agg(F.count("*").alias("times"))


def indexes(items: DataFrame, pass_rows: int) -> Iterator[Index]:
    """The index in passes of about ``pass_rows`` pairs, so that each broadcast has a bound, whatever the items' number."""
    terms = item_terms(items).checkpoint()
    n = max(1, math.ceil(terms.count() / pass_rows))
    for part in range(n):
        rows = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == part).orderBy("term", "item_id").toArrow()
        if not rows.num_rows:
            continue
        ids = rows["item_id"].unique()
        words = rows["term"].combine_chunks().dictionary_encode()
        codes = words.indices.to_numpy()
        yield Index(
            ids=ids.fill_null(0).to_numpy().astype(np.int64), null_id=np.array(ids.is_null().to_pylist(), bool),
            terms=words.dictionary.cast(pa.large_binary()),
            first=np.searchsorted(codes, np.arange(len(words.dictionary) + 1)),
            items=pc.index_in(rows["item_id"].combine_chunks(), value_set=ids).to_numpy(zero_copy_only=False).astype(np.int64),
            times=rows["times"].to_numpy().astype(np.int64),
        )


def counted(batch: pa.RecordBatch, index: Index) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each slice of rows: its bounds, the rows' numbers of terms, and row, term and count of all terms of the index."""
    data, bounds = utf8(batch.column("text"))
    for a, b in slices(bounds):
        part = fold(data[bounds[a] : bounds[b]])
        inside = INSIDE[part]
        starts, ends, rows = runs(inside, bounds[a : b + 1] - bounds[a])
        code = pc.index_in(pieces(part, inside, starts, ends), value_set=index.terms)
        known = np.flatnonzero(np.asarray(code.is_valid()))
        codes = code.fill_null(0).to_numpy()[known].astype(np.int64)
        keys, tf = np.unique(rows[known] * len(index.terms) + codes, return_counts=True)
        yield a, b, np.bincount(rows, minlength=b - a), keys // len(index.terms), keys % len(index.terms), tf


def statistics(documents: DataFrame, held: Broadcast) -> tuple[int, int, dict[int, int]]:
    """Documents with a term, all their terms, and the documents that hold each term of the index."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        found, n, total = np.zeros(len(index.terms), np.int64), 0, 0
        for batch in batches:
            for _, _, sizes, _, terms, _ in counted(batch, index):
                found += np.bincount(terms, minlength=len(found))
                n, total = n + int((sizes > 0).sum()), total + int(sizes.sum())
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_pydict({"term": np.concatenate((some, [-1, -2])), "n": np.concatenate((found[some], [n, total]))})

    rows = documents.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    sums = {r.term: r.n for r in rows}
    return sums.pop(-1, 0), sums.pop(-2, 0), sums


def weights(n: int, found: dict[int, int], terms: int) -> np.ndarray:
    """The weight of each term by the number of documents that hold it."""
    return np.array([math.floor(WEIGHT * math.log((2 * n + 2) / (2 * found.get(t, 0) + 1))) for t in range(terms)], np.int64)


class Heaps:
    """The ``k`` best documents of each item so far: score, then id (nulls last)."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, np.int64)
        self.item, self.score, self.doc, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, scores: np.ndarray, docs: np.ndarray, nulls: np.ndarray) -> None:
        rows, items = np.nonzero(scores >= self.least)
        if not len(rows):
            return
        item, score = np.concatenate((self.item, items)), np.concatenate((self.score, scores[rows, items]))
        doc, null = np.concatenate((self.doc, docs[rows])), np.concatenate((self.null, nulls[rows]))
        order = np.lexsort((doc, null, -score, item))
        place = np.arange(len(order)) - np.searchsorted(item[order], item[order])
        last = order[place == self.k - 1]
        self.least[item[last]] = score[last]
        order = order[place < self.k]
        self.item, self.score, self.doc, self.null = item[order], score[order], doc[order], null[order]


def _best(documents: DataFrame, held: Broadcast, weight: Broadcast, n: int, total: int, k: int) -> DataFrame:
    """``item_id, doc_id, score``: the heaps of all tasks."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, w = held.value, weight.value
        lists, width = np.diff(index.first), len(index.ids)
        heaps = Heaps(width, k)
        for batch in batches:
            ids = batch.column("doc_id")
            docs, nulls = ids.fill_null(0).to_numpy(zero_copy_only=False), np.asarray(ids.is_null())
            for a, _, sizes, rows, terms, tf in counted(batch, index):
                length = np.array([100 - 25 + 25 * int(size) * n // total for size in sizes] if total else [], np.int64)
                value = w[terms] * (UNIT * tf // (TENTH * tf + SLOPE * length[rows]))
                step = max(1, CELLS // width)
                for low in range(0, len(sizes), step):
                    here = slice(*np.searchsorted(rows, (low, low + step)))
                    if here.start == here.stop:
                        continue
                    high = min(low + step, len(sizes))
                    scores = np.zeros((high - low) * width, np.int64)
                    each = lists[terms[here]]
                    at = np.repeat(index.first[terms[here]] - np.cumsum(each) + each, each) + np.arange(each.sum())
                    np.add.at(scores, np.repeat(rows[here] - low, each) * width + index.items[at], np.repeat(value[here], each) * index.times[at])
                    heaps.add(scores.reshape(-1, width), docs[a + low : a + high], nulls[a + low : a + high])
        yield pa.RecordBatch.from_arrays(
            [pa.array(index.ids[heaps.item], mask=index.null_id[heaps.item]), pa.array(heaps.doc, mask=heaps.null), pa.array(heaps.score)], ["item_id", "doc_id", "score"]
        )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(stream, "item_id long, doc_id long, score long")


def _top(rows: DataFrame, k: int, *by: str | Column) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(documents: DataFrame, items: DataFrame, k: int = 20, pass_rows: int = PASS_ROWS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item.

    Two narrow scans of the documents for each pass of the index (one for the counts, one for
    the scores); each task sends ``k`` rows an item at most, merged in two steps.

    Nulls and empty texts have no terms: such a document is never found and does not count, such
    an item has no rows. Rows of one item id are one item, whose terms add up; a null item id is
    an id of its own. Each row of a repeated document counts and is ranked; equal scores stand by
    ascending id, a null id last. A text of any length is one document. Empty tables give no
    rows; other columns are not looked at.
    """
    spark, out = documents.sparkSession, None
    for index in indexes(items, pass_rows):
        held = spark.sparkContext.broadcast(index)
        n, total, found = statistics(documents, held)
        weight = spark.sparkContext.broadcast(weights(n, found, len(index.terms)))
        rows = _best(documents, held, weight, n, total, k)
        out = rows if out is None else out.unionAll(rows)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    first = _top(out.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(MERGES))), k, "item_id", "part")
    return _top(first.drop("rank", "part"), k, "item_id").select("item_id", "rank", "doc_id", "score")
