"""Streaming twins. All read files as a stream and end when the input is read
(``availableNow``); results and stream state live below the shared folder.

The stateful operators drop what comes later than their watermark: they are for live input,
which comes roughly in time order. The files of a table come in any order, so a table is
read by micro-batches that are aggregated each by itself (``run_to_end`` with ``each``), and
the parts of a key are put together afterwards (``merged``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import settings as S
from ..operators.jobs import batch_outcome_apply
from ..session import scratch_path
from ..settings import DEFAULTS

FILES_PER_TRIGGER = 1000


def table_stream(spark: SparkSession, root: str, name: str, files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    """A table as a stream, whether it is one file or a folder of part files.

    The schema is the table's; ``files_per_trigger`` bounds a micro-batch.
    """
    path = f"{root.rstrip('/')}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    # a glob that only this path fits: a stream takes a folder, or a pattern of files
    pattern = f"{root.rstrip('/')}/{name}.parque[t]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(pattern)


class LateRows(RuntimeError):
    """Rows came later than the watermark and were dropped."""


def span(spark: SparkSession, root: str, name: str, ts: str = "ts") -> str:
    """A delay as long as the table's time goes: with it as watermark no row of the table is late, whatever the order of its files."""
    first, last = spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet").agg(F.min(ts).cast("timestamp"), F.max(ts).cast("timestamp")).first()
    return f"{int((last - first).total_seconds()) + 1 if first else 1} seconds"


def run_to_end(
    stream: DataFrame,
    name: str,
    mode: str = "append",
    each: Callable[[DataFrame], DataFrame] | None = None,
    at: str | None = None,
    whole: bool = False,
) -> DataFrame:
    """Run a stream over all present input into a new table; return that table.

    Each micro-batch writes its own folder and overwrites it when it is repeated
    after a failure, so no row is lost or doubled. ``update`` results carry the
    batch number they come from (``_batch``). ``each`` is applied to the rows of every
    micro-batch alone: no state is kept, a watermark in it means nothing, and no row is late.
    ``at`` is the table's path, where a later run goes on after the batches and with the state of an
    earlier one. With ``whole`` rows dropped by the watermark are an error (:class:`LateRows`).
    """
    spark = stream.sparkSession
    shape = stream.schema if each is None else each(stream).schema
    target = scratch_path(spark, name) if at is None else at
    late: dict[int, int] = {}

    def seen() -> None:
        for progress in query.recentProgress if whole else []:
            late[progress["batchId"]] = sum(state["numRowsDroppedByWatermark"] for state in progress["stateOperators"])

    def store(batch: DataFrame, number: int) -> None:
        if number % 50 == 49:  # a query remembers its last hundred batches
            seen()
        rows = batch if each is None else each(batch)
        rows.write.mode("overwrite").parquet(f"{target}/_batch={number}")

    query = (
        stream.writeStream.foreachBatch(store)
        .outputMode(mode)
        .option("checkpointLocation", target + "-progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    seen()
    if sum(late.values()):
        raise LateRows(f"{sum(late.values())} rows of {name} came later than the watermark")
    return spark.read.schema(T.StructType([*shape.fields, T.StructField("_batch", T.LongType())])).parquet(target)


def stream_cache(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """Use of each key per hour: requests, recorded successes, last use; run in update mode.

    ``log``: fetch_key, ts, success. State ends with the watermark.
    """
    return (
        log.withWatermark("ts", late)
        .groupBy(F.window("ts", "1 hour").alias("hour"), "fetch_key")
        .agg(F.count("*").alias("n"), F.count_if("success").alias("n_success"), F.max("ts").alias("last_used"))
        .select("fetch_key", F.col("hour.start").alias("hour"), "n", "n_success", "last_used")
    )


def stream_rate_slots(requests: DataFrame, interval: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Requests of each domain per interval, and those above one; run in update mode.

    ``requests``: domain, ts.
    """
    return (
        requests.withWatermark("ts", late)
        .groupBy(F.window("ts", interval).alias("slot"), "domain")
        .agg(F.count("*").alias("n"))
        .select("domain", F.col("slot.start").alias("slot"), "n", (F.col("n") - 1).alias("above"))
    )


def with_hour(log: DataFrame) -> DataFrame:
    return log.withColumn("hour", F.date_trunc("hour", "ts"))


def stream_inflight_dedupe(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """One row for each key and hour: later requests of the hour are dropped.

    ``log``: fetch_key, ts. The watermark reaches over the hour, so its state is kept as long as needed, and no longer.
    """
    hours = with_hour(log)
    return hours.withWatermark("ts", late).dropDuplicatesWithinWatermark(["fetch_key", "hour"]).select("fetch_key", "hour")


def stream_request_counters(log: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Request counts per minute, method, path and status; run in update mode."""
    return (
        log.withWatermark("ts", late)
        .groupBy(F.window("ts", "1 minute").alias("minute"), "method", "path", "status")
        .agg(F.count("*").alias("n"), F.sum("seconds").alias("sum_seconds"))
        .select(F.col("minute.start").alias("minute"), "method", "path", "status", "n", "sum_seconds")
    )


def latest_update(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The last state of each key from an update-mode run."""
    values = [name for name in updates.columns if name not in (*keys, "_batch")]
    return (
        updates.groupBy(*keys)
        .agg(F.max_by(F.struct(*values), "_batch").alias("_last"))
        .select(*keys, "_last.*")
    )


def merged(parts: DataFrame, keys: list[str], **how: Callable[[str], Column]) -> DataFrame:
    """One row of each key from the parts that its micro-batches wrote; ``how`` merges each value."""
    if not how:
        return parts.select(*keys).distinct()
    return parts.groupBy(*keys).agg(*(merge(value).alias(value) for value, merge in how.items()))


_OUTCOME = ("attempt", "reported_at", "request_id", "result", "error_code", "error_message", "retry_after_seconds")


def latest_outcomes(outcomes: DataFrame, max_attempts: int = DEFAULTS.max_attempts) -> DataFrame:
    """The latest attempt of each item, kept as state; a row comes out whenever it changes. Run in update mode.

    ``outcomes``: item_id, attempt, reported_at, request_id, result, error_code, error_message,
    retry_after_seconds. Of two reports the greater by these columns, in order, is the later, so repeated and
    disordered events change nothing. The state of an item ends with the item: with a success, an error
    that is not retried, or the last attempt. An older report that comes after that is passed on once more
    and put in its place when the table is read, so nothing is ever late and no watermark is needed.
    """
    fields = [outcomes.schema[name] for name in _OUTCOME]
    kinds = ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in fields)
    key = f"item_id {outcomes.schema['item_id'].dataType.simpleString()}"
    final = {code for code, _, retried in S.ERRORS if not retried}
    rank = lambda row: tuple((value is not None, 0 if value is None else value) for value in row)

    def fold(item: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = tuple(state.get) if state.exists else None
        best = known
        for batch in batches:
            for row in batch[list(_OUTCOME)].astype(object).itertuples(index=False, name=None):
                row = tuple(_plain(value) for value in row)
                if best is None or rank(row) > rank(best):
                    best = row
        attempt, code = best[0], best[4]
        if code is not None and code not in final and (attempt or 0) < max_attempts:
            state.update(best)
        elif state.exists:
            state.remove()
        if best != known:
            yield pd.DataFrame([(*item, *best)], columns=["item_id", *_OUTCOME], dtype=object)

    def _plain(value):
        if value is None or value != value:
            return None
        if isinstance(value, pd.Timestamp):
            return value.to_pydatetime()
        return int(value) if isinstance(value, float) else value.item() if hasattr(value, "item") else value

    return outcomes.groupBy("item_id").applyInPandasWithState(fold, f"{key}, {kinds}", kinds, "update", GroupStateTimeout.NoTimeout)


def stream_job_state(
    outcomes: DataFrame, items: DataFrame, jobs: DataFrame, as_of: Column, at: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Item outcomes as a stream (at least once, in any order); returns items and jobs afterwards.

    The latest attempt of each item is the stream's state (:func:`latest_outcomes`), and its changes are appended to
    an outcome log at ``at``. The tables are merged when they are read: one outcome per item
    counts, so a repeated event changes nothing and no batch rewrites the item table. Run again at the same
    path it goes on where it ended.
    """
    arrived = run_to_end(latest_outcomes(outcomes), "job-outcomes", "update", at=at)
    return batch_outcome_apply(items, jobs, arrived.drop("_batch"), as_of)
