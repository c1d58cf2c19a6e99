"""How many chunks the rows are dealt to, and how many buckets take the chunks' messages."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a chunk, so that it fits a Python worker, and bytes whose units one bucket holds.
CHUNK_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20


def dealt(documents: DataFrame, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> tuple[int, int]:
    """Numbers of chunks and buckets, by the length of all texts alone.

    They do not depend on the number of partitions, so neither do the messages between them:
    more partitions give the same messages to more tasks. A chunk sends a bucket one message
    at most, and none without a unit in it; so messages never outnumber the chunks' units, however
    many chunks and buckets there are.
    """
    total = documents.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    return max(1, math.ceil(total / chunk_bytes)), max(1, math.ceil(total / bucket_bytes))
