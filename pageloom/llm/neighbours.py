"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its nearest pivots. Blocks of rows keep an inverted
file: for each pivot the places it has among the rows' pivots. A query reads the lists of its own
pivots, ranks the block's rows by footrule distance and computes the true measure for the best.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import utf8

PIVOTS = 256  # pivots, a bounded sample of the distinct vectors
PREFIX = 128  # pivots in a vector's representation, at most 255
SHARE = 0.2  # of a block's rows, in footrule order, the true measure is computed
BLOCK_ROWS = 8192
QUERY_ROWS = 2048


def usable(vectors: DataFrame, k: int, every: int) -> DataFrame:
    """``vec_id, vec, ask, first``: the rows to be indexed, and those to be asked with, each (id, vector) once.

    Of equal vectors only the ``k + 1`` smallest ids can stand among the ``k`` nearest of any query, so no
    others are indexed (``first`` marks the smallest): a vector that a third of all rows hold neither
    fills a block nor takes the candidates' places.
    """
    vec = F.col("embedding").cast("array<double>")
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf))) & F.exists("vec", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec")).where(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False))).distinct()
    place = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    indexed = rows.withColumn("place", place).where(F.col("place") <= k + 1).select("vec_id", "vec", F.lit(False).alias("ask"), (F.col("place") == 1).alias("first"))
    return indexed.unionAll(rows.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "vec", F.lit(True).alias("ask"), F.lit(False).alias("first")))


def lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Rows on the unit sphere of one more dimension, where nearness is the inner product with a query."""
    vectors = vectors / longest
    rest = np.sqrt(np.maximum(0, 1 - (vectors * vectors).sum(axis=1)))
    return np.concatenate((vectors, rest[:, None]), axis=1)


def asked(vectors: np.ndarray) -> np.ndarray:
    """Queries on the same sphere: their length does not matter, and the added dimension is zero."""
    return np.concatenate((vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None], np.zeros((len(vectors), 1))), axis=1)


def permutations(points: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest pivots of each point, nearest first; of equally near ones the first."""
    return np.argsort(-(points @ pivots.T), axis=1, kind="stable")[:, :prefix].astype(np.uint16)


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """A list column as rows of ``width`` numbers; a shorter list is padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    out = np.zeros((len(column), width))
    out[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


class InvertedFile:
    """For each pivot the weight ``prefix - place`` that it has in every row of the block, 0 where it is not among the row's pivots.

    Two permutations ``a``, ``b`` of one prefix have the footrule distance ``prefix * (prefix + 1) - 2 * sum(min(a, b))``
    over the weights of their pivots, so the least distance is the largest sum. Every second row holds
    a pivot with the standard parameters; a list of all rows in order is then shorter than one of places.
    """

    def __init__(self, order: np.ndarray, pivots: int):
        rows, self.prefix = order.shape
        self.lists = np.zeros((pivots, rows), np.uint8)
        for place in range(self.prefix):
            self.lists[order[:, place], np.arange(rows)] = self.prefix - place

    def nearness(self, order: np.ndarray) -> np.ndarray:
        """Sums of common weights of a query's permutation with every row."""
        out = np.zeros(self.lists.shape[1], np.uint16 if self.prefix < 256 else np.uint32)
        for place, pivot in enumerate(order):
            out += np.minimum(self.lists[pivot], np.uint8(self.prefix - place))
        return out


def nearest(ids: np.ndarray, vectors: np.ndarray, index: InvertedFile, own: int, query: np.ndarray, order: np.ndarray, k: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Places and measures of the ``k`` best candidates of one query in a block whose rows stand by id."""
    near = index.nearness(order)
    wanted = min(len(ids), math.ceil(share * len(ids)) + 10 * k)
    some = np.sort(np.argpartition(near, len(near) - wanted)[len(near) - wanted :])
    some = some[ids[some] != own]
    score = (vectors[some] * query).sum(axis=1)
    best = np.lexsort((ids[some], -score))[:k]
    return some[best], score[best]


def search(vectors: DataFrame, k: int = 20, every: int = 20, pivots: int = PIVOTS, prefix: int = PREFIX, share: float = SHARE, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of largest inner product found for each query.

    Queries are the rows whose id is divisible by ``every``. The pivots are a bounded sample;
    every row is indexed. Rows are dealt to blocks, queries to blocks of their own, and each pair
    of blocks is one task of bounded size; a task sends ``k`` rows a query. In each block the true
    measure is computed for ``share`` of its rows and ``10 * k`` more.

    Rows without id, and vectors that are null, zero or hold nulls or non-finite numbers, take no
    part; vectors shorter than the longest count as padded with zeros. Repeated rows count once;
    of two vectors of one id each is searched and found, but not by its own id. Equal measures
    stand by ascending id. No rows give no rows; other columns are not looked at.
    """
    spark = vectors.sparkSession
    both = usable(vectors, k, every).checkpoint()
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    n, asks, width, longest = both.agg(F.count_if(~F.col("ask")), F.count_if("ask"), F.max(F.size("vec")), F.max(length)).first()
    if not n or not asks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # pivots: of about four times as many distinct vectors, drawn by their hash, those of least hash
    drawn = F.pmod(F.xxhash64("vec"), F.lit(max(1, n // (4 * pivots)))) == 0
    sample = both.where("first").where(drawn).select("vec").orderBy(F.hash("vec"), "vec").limit(pivots).toArrow()
    points = lifted(matrix(sample["vec"], width), longest)
    held, prefix = spark.sparkContext.broadcast(points), min(prefix, len(points))

    def represent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, ask = matrix(batch.column("vec"), width), np.asarray(batch.column("ask"))
            order = permutations(np.where(ask[:, None], asked(values), lifted(values, longest)), held.value, prefix)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("ask"), _binary(values), _binary(order)], ["vec_id", "ask", "vec", "pivots"]
            )

    blocks, parts = math.ceil(n / block_rows), math.ceil(asks / query_rows)
    index = both.select("vec_id", "vec", "ask").mapInArrow(represent, "vec_id long, ask boolean, vec binary, pivots binary")
    deal = F.xxhash64("vec_id", "vec")
    # a row goes to its block and all parts of queries, a query to its part and all blocks
    cells = index.withColumn("block", F.explode(F.when(F.col("ask"), F.sequence(F.lit(0), F.lit(blocks - 1))).otherwise(F.array(F.pmod(deal, F.lit(blocks)).cast("int")))))
    cells = cells.withColumn("part", F.explode(F.when(F.col("ask"), F.array(F.pmod(deal, F.lit(parts)).cast("int"))).otherwise(F.sequence(F.lit(0), F.lit(parts - 1)))))

    def answer(table: pa.Table) -> pa.Table:
        table = table.sort_by([("vec_id", "ascending"), ("vec", "ascending")])
        ask = table["ask"].to_numpy()
        ids, values = table["vec_id"].to_numpy(), _numbers(table["vec"], np.float64)
        order = _numbers(table["pivots"], np.uint16)
        own, from_, found, score = [], [], [], []
        if ask.any() and not ask.all():
            file, row_ids, row_values = InvertedFile(order[~ask], len(points)), ids[~ask], values[~ask]
            for q in np.flatnonzero(ask):
                at, measure = nearest(row_ids, row_values, file, ids[q], values[q], order[q], k, share)
                own.append(np.full(len(at), ids[q]))
                from_.append(np.full(len(at), q))
                found.append(row_ids[at])
                score.append(measure)
        flat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        vec = table["vec"].take(pa.array(flat(from_, np.int64)))
        return pa.table({"query_id": flat(own, np.int64), "vec": vec, "vec_id": flat(found, np.int64), "score": flat(score, np.float64)})

    found = cells.groupBy("block", "part").applyInArrow(answer, "query_id long, vec binary, vec_id long, score double")
    found = found.withColumn("vec", F.xxhash64("vec"))
    order = Window.partitionBy("query_id", "vec").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _binary(values: np.ndarray) -> pa.Array:
    """Rows of numbers as binary values of one length."""
    width = values.shape[1] * values.itemsize
    offsets = np.arange(len(values) + 1, dtype=np.int32) * np.int32(width)
    return pa.BinaryArray.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _numbers(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """The rows of :func:`_binary` again."""
    data, _ = utf8(column)
    return data.copy().view(kind).reshape(len(column), -1)
