"""Packing into token-budget batches, with length buckets that make the padding least."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import SPACES, slices, utf8

MAX_LEN = 2048
TOKEN_BUDGET = 16384
N_BUCKETS = 8
SHARD_ROWS = 50_000


def token_counts(documents: DataFrame) -> DataFrame:
    """``doc_id, digest, n_tokens``: words between ASCII white space; a null text has none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = utf8(batch.column("text"))
            out = []
            for a, b in slices(bounds):
                part, at = data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
                inside = ~SPACES[part]
                start = inside & np.concatenate(([True], ~inside[:-1])) if len(part) else inside
                first = at[:-1][at[:-1] < len(part)]
                start[first] = inside[first]
                total = np.concatenate(([0], np.cumsum(start)))
                out.append(total[at[1:]] - total[at[:-1]])
            n = np.concatenate(out) if out else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(n.astype(np.int64))], ["doc_id", "digest", "n_tokens"])

    return documents.select("doc_id", F.xxhash64("text").alias("digest"), "text").mapInArrow(count, "doc_id long, digest long, n_tokens long")


def bucket_bounds(lengths: list[int], counts: list[int], n_buckets: int) -> list[int]:
    """Upper bounds of at most ``n_buckets`` buckets with the least total padding.

    Dynamic programming over the different lengths: the least padding of the first j lengths
    in k buckets is the least over i of that of the first i in k - 1, plus what the lengths
    i..j need to reach the longest of them. Of equal choices the first stays.
    """
    order = np.argsort(lengths)
    size, count = np.array(lengths, np.int64)[order], np.array(counts, np.int64)[order]
    m = len(size)
    if m == 0:
        return []
    many = np.concatenate(([0], np.cumsum(count)))
    tokens = np.concatenate(([0], np.cumsum(count * size)))
    least = np.full(m + 1, np.iinfo(np.int64).max // 4, np.int64)
    least[0] = 0
    choice = []
    for _ in range(min(n_buckets, m)):
        new, pick = least.copy(), np.full(m + 1, -1, np.int64)
        for j in range(1, m + 1):
            cost = least[:j] + size[j - 1] * (many[j] - many[:j]) - (tokens[j] - tokens[:j])
            i = int(np.argmin(cost))
            if cost[i] < new[j]:
                new[j], pick[j] = cost[i], i
        choice.append(pick)
        least = new
    bounds, j = [], m
    for pick in reversed(choice):
        if j > 0 and pick[j] >= 0:
            bounds.append(int(size[j - 1]))
            j = int(pick[j])
    return bounds[::-1]


def pack(documents: DataFrame, max_len: int = MAX_LEN, token_budget: int = TOKEN_BUDGET, n_buckets: int = N_BUCKETS) -> DataFrame:
    """``doc_id, piece, start_token, n_tokens, bucket, bucket_len, batch, slot`` for each piece.

    A document longer than ``max_len`` tokens is cut into pieces of that length. Pieces are
    padded to the bound of their bucket; a batch holds as many as fit the token budget. Their
    places are counted in two steps, within shards of a bucket and over the shards' totals, so
    that no bucket is one task. Documents without tokens, and null texts, are pieces of no
    token in the first bucket; null ids come first in their shard; repeated rows are packed as
    often as they occur; no rows give no rows.
    """
    pieces = (
        token_counts(documents)
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("n_tokens") - 1) / F.lit(max_len)).cast("int")))))
        .withColumn("start_token", F.col("piece") * F.lit(max_len).cast("long"))
        .withColumn("n_tokens", F.least(F.col("n_tokens") - F.col("start_token"), F.lit(max_len).cast("long")))
        .checkpoint(eager=True)  # small rows, read for the histogram and for the batches
    )
    # at most max_len + 1 different lengths reach the driver
    histogram = pieces.groupBy("n_tokens").count().collect()
    total = sum(r["count"] for r in histogram)
    bounds = bucket_bounds([r["n_tokens"] for r in histogram], [r["count"] for r in histogram], n_buckets) or [max_len]
    shards = max(64, -(-total // SHARD_ROWS))
    bucket = F.lit(len(bounds) - 1)
    for k in reversed(range(len(bounds) - 1)):
        bucket = F.when(F.col("n_tokens") <= bounds[k], k).otherwise(bucket)
    length = F.element_at(F.array(*(F.lit(b) for b in bounds)), F.col("bucket") + 1)
    placed = (
        pieces.withColumn("bucket", bucket)
        .withColumn("shard", F.pmod(F.xxhash64("doc_id", "digest", "piece"), F.lit(shards)))
        .withColumn("at", F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("doc_id", "digest", "piece")))
    )
    sizes = pieces.withColumn("bucket", bucket).groupBy("bucket", F.pmod(F.xxhash64("doc_id", "digest", "piece"), F.lit(shards)).alias("shard")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    room = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.greatest(F.col("bucket_len"), F.lit(1))))
    return (
        placed.join(offsets, ["bucket", "shard"])
        .withColumn("bucket_len", length)
        .withColumn("place", F.col("offset") + F.col("at") - 1)
        .select("doc_id", "piece", "start_token", "n_tokens", "bucket", "bucket_len", F.floor(F.col("place") / room).alias("batch"), F.pmod(F.col("place"), room).alias("slot"))
    )
