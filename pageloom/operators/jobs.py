"""Job and item tables: creation, claiming, outcomes, roll-up.

Items: item_id, job_id, position, queue, state, attempts, next_run_at, worker_id,
leased_until, request_id, result, error_code, error_message. Jobs: job_id, client_id,
prior_state, created_at. A transition changes the named columns of the rows it is about
and keeps everything else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import settings as S
from ..functions import timing as T
from ..settings import DEFAULTS
from .requests import queue_of

def item_positions(batches: DataFrame) -> DataFrame:
    """One row per request of a batch with its 0-based position."""
    kept = [name for name in batches.columns if name != "requests"]
    return batches.select(*kept, F.posexplode("requests").alias("position", "request"))


def job_create(batches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Batches (job_id, client_id, priority, created_at, requests) to job and item rows."""
    jobs = batches.select(
        "job_id", "client_id", F.lit("queued").alias("state"), "priority", F.size("requests").alias("item_count"), "created_at"
    )
    items = item_positions(batches).select(
        T.stable_id("item", F.col("job_id"), F.col("position")).alias("item_id"),
        "job_id",
        "position",
        F.to_json("request", {"ignoreNullFields": "false"}).alias("payload"),
        queue_of(F.coalesce("request.mode", F.lit("auto"))).alias("queue"),
        F.lit("queued").alias("state"),
        F.lit(0).alias("attempts"),
        F.col("created_at").alias("next_run_at"),
    )
    return jobs, items


def job_item_count(items: DataFrame) -> DataFrame:
    return items.groupBy("job_id").agg(F.count("*").alias("item_count"))


def job_with_items(jobs: DataFrame, items: DataFrame, client_id=None) -> DataFrame:
    """Jobs with their items, one row per item (a job without items keeps one row)."""
    wanted = jobs if client_id is None else jobs.where(F.col("client_id") == client_id)
    return wanted.join(items.drop("client_id"), "job_id", "left")


def job_view(jobs: DataFrame, items: DataFrame) -> DataFrame:
    """Public view, one row per job and item: job fields, counts, and the public item fields.

    A job without items keeps one row, with zero counts and no item.
    """
    counts = items.groupBy("job_id").agg(
        F.count("*").alias("item_count"),
        F.count_if(F.col("state") == "succeeded").alias("succeeded_count"),
        F.count_if(F.col("state") == "failed").alias("failed_count"),
    )
    shown = items.select("job_id", "position", "item_id", F.col("state").alias("item_state"), "request_id", "error_code")
    return (
        jobs.select("job_id", "client_id", "created_at", F.col("prior_state").alias("state"))
        .join(counts, "job_id", "left")
        .fillna(0, ["item_count", "succeeded_count", "failed_count"])
        .join(shown, "job_id", "left")
    )


def items_sorted(items: DataFrame) -> DataFrame:
    """Items in order of job and position: a range sort over all partitions."""
    return items.orderBy("job_id", "position")


def job_not_found(lookups: DataFrame, jobs: DataFrame) -> DataFrame:
    """Look-ups (job_id, client_id) that name no job of that client."""
    return lookups.join(jobs.select("job_id", "client_id"), ["job_id", "client_id"], "left_anti").withColumn(
        "error", F.lit("JOB_NOT_FOUND")
    )


def job_rollup(items: DataFrame, jobs: DataFrame) -> DataFrame:
    """Counts and state per job.

    All items ended: failed if any failed, else succeeded (also when all were
    cancelled). Otherwise running if any item runs, else the earlier state stays.
    """
    ended = F.col("state").isin(*S.TERMINAL_STATES)
    folded = items.groupBy("job_id").agg(
        F.count_if(F.col("state") == "succeeded").alias("succeeded_count"),
        F.count_if(F.col("state") == "failed").alias("failed_count"),
        F.bool_and(ended).alias("_ended"),
        F.bool_or(F.col("state") == "running").alias("_running"),
    )
    state = (
        F.when(F.coalesce("_ended", F.lit(True)), F.when(F.col("failed_count") > 0, "failed").otherwise("succeeded"))
        .when(F.col("_running"), "running")
        .otherwise(F.col("prior_state"))
    )
    return (
        jobs.select("job_id", "prior_state")
        .join(folded, "job_id", "left")
        .select(
            "job_id",
            F.coalesce("succeeded_count", F.lit(0)).alias("succeeded_count"),
            F.coalesce("failed_count", F.lit(0)).alias("failed_count"),
            state.alias("state"),
        )
    )


def job_cancel(jobs: DataFrame, items: DataFrame, cancels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply cancel requests (job_id, client_id): new jobs and items.

    Queued items are cancelled; the job is, when then all its items have ended.
    """
    named = (
        cancels.join(jobs.select("job_id", "client_id"), ["job_id", "client_id"], "left_semi")
        .select("job_id")
        .distinct()
        .withColumn("_cancel", F.lit(True))
    )
    hit = F.coalesce("_cancel", F.lit(False))
    new_items = (
        items.join(named, "job_id", "left")
        .withColumn("state", F.when(hit & (F.col("state") == "queued"), "cancelled").otherwise(F.col("state")))
        .drop("_cancel")
    )
    # a job whose items are all ended or still queued, or that has none, is cancelled as a whole
    closed = items.groupBy("job_id").agg(F.bool_and(F.col("state").isin("queued", *S.TERMINAL_STATES)).alias("_all"))
    new_jobs = (
        jobs.join(named, "job_id", "left")
        .join(closed, "job_id", "left")
        .withColumn("state", F.when(hit & F.coalesce("_all", F.lit(True)), "cancelled").otherwise(F.col("prior_state")))
        .drop("_all", "_cancel")
    )
    return new_jobs, new_items


def claim_order(items: DataFrame, as_of: Column, per_queue: int = 1) -> DataFrame:
    """The next items of every queue, with their rank.

    Due items that are queued, or whose lease has run out. ``rank <= k`` over a
    row number keeps k rows per queue before the shuffle already.
    """
    due = (F.col("next_run_at") <= as_of) & (
        (F.col("state") == "queued") | ((F.col("state") == "running") & (F.col("leased_until") < as_of))
    )
    order = Window.partitionBy("queue").orderBy("next_run_at", "created_at", "item_id")
    return items.where(due).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_queue)


def item_claim(
    items: DataFrame, jobs: DataFrame, as_of: Column, worker_id: str, per_queue: int = 1
) -> tuple[DataFrame, DataFrame]:
    """All items, the claimed ones running under a new lease, and all jobs, theirs running (``state``)."""
    taken = claim_order(items, as_of, per_queue).select("item_id", "job_id", F.lit(True).alias("_claimed"))
    hit = F.coalesce("_claimed", F.lit(False))
    new_items = (
        items.join(taken.drop("job_id"), "item_id", "left")
        .withColumns(
            {
                "state": F.when(hit, "running").otherwise(F.col("state")),
                "worker_id": F.when(hit, worker_id).otherwise(F.col("worker_id")),
                "leased_until": F.when(hit, T.lease_until(as_of)).otherwise(F.col("leased_until")),
                "attempts": F.when(hit, F.col("attempts") + 1).otherwise(F.col("attempts")),
            }
        )
        .drop("_claimed")
    )
    started = taken.select("job_id", "_claimed").distinct()
    new_jobs = (
        jobs.join(started, "job_id", "left")
        .withColumn("state", F.when(hit, "running").otherwise(F.col("prior_state")))
        .drop("_claimed")
    )
    return new_items, new_jobs


def claim_changes(items: DataFrame, as_of: Column, worker_id: str, per_queue: int = 1) -> DataFrame:
    """The claimed items as they are afterwards, and no other row: what a claim has to write."""
    return claim_order(items, as_of, per_queue).drop("rank").withColumns(
        {"state": F.lit("running"), "worker_id": F.lit(worker_id), "leased_until": T.lease_until(as_of), "attempts": F.col("attempts") + 1}
    )


def outcome_changes(items: DataFrame, outcomes: DataFrame, as_of: Column, max_attempts: int = DEFAULTS.max_attempts) -> DataFrame:
    """The items that an outcome is reported of, as they are afterwards (see :func:`apply_outcomes`), and no other row."""
    return apply_outcomes(items, outcomes, as_of, max_attempts, "inner")


def item_complete(items: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Finished fetches end their item as succeeded, whatever the page's status was."""
    return apply_outcomes(items, outcomes.where(F.col("error_code").isNull()), F.lit(None).cast("timestamp_ntz"))


def item_fail(items: DataFrame, outcomes: DataFrame, as_of: Column) -> DataFrame:
    return apply_outcomes(items, outcomes.where(F.col("error_code").isNotNull()), as_of)


def _retryable(code: Column) -> Column:
    known = [name for name, _, _ in S.ERRORS]
    retried = [name for name, _, retry in S.ERRORS if retry]
    # an error that is in no catalog counts as internal, which is retried
    return code.isin(*retried) | ~code.isin(*known)


def apply_outcomes(
    items: DataFrame, outcomes: DataFrame, as_of: Column, max_attempts: int = DEFAULTS.max_attempts, how: str = "left"
) -> DataFrame:
    """Items after a batch of outcomes; with ``how="inner"`` only those that have one.

    ``outcomes``: item_id, attempt, reported_at, request_id, result, error_code,
    error_message, retry_after_seconds. No error: succeeded with its request and result.
    Retryable error with attempts left: queued again after the given delay or 2^attempts
    seconds. Otherwise failed. Unknown errors become INTERNAL_ERROR. Both ways the lease
    ends. Of several outcomes of an item the latest attempt counts, and of one attempt the
    latest report, so repeats are harmless. Items without an outcome keep every column.
    """
    known = [name for name, _, _ in S.ERRORS]
    fields = ("request_id", "result", "error_code", "error_message", "retry_after_seconds")
    reported = outcomes.groupBy("item_id").agg(F.max(F.struct("attempt", "reported_at", *fields)).alias("_o"))
    code = F.col("_o.error_code")
    hit = F.col("_o").isNotNull()
    good, bad = hit & code.isNull(), hit & code.isNotNull()
    again = bad & _retryable(code) & (F.col("attempts") < max_attempts)
    delay = T.item_backoff(F.col("attempts"), F.col("_o.retry_after_seconds"))
    no_lease = F.lit(None).cast(items.schema["leased_until"].dataType)
    joined = items.join(reported, "item_id", how)
    return joined.withColumns(
        {
            "next_run_at": F.when(again, T.plus_seconds(as_of, delay)).otherwise(F.col("next_run_at")),
            "request_id": F.when(good, F.col("_o.request_id")).otherwise(F.col("request_id")),
            "result": F.when(good, F.col("_o.result")).otherwise(F.col("result")),
            "error_code": F.when(bad & code.isin(*known), code).when(bad, "INTERNAL_ERROR").otherwise(F.col("error_code")),
            "error_message": F.when(bad, F.col("_o.error_message")).otherwise(F.col("error_message")),
            "leased_until": F.when(hit, no_lease).otherwise(F.col("leased_until")),
            "state": F.when(good, "succeeded").when(again, "queued").when(bad, "failed").otherwise(F.col("state")),
        }
    ).drop("_o")


def batch_outcome_apply(
    items: DataFrame, jobs: DataFrame, outcomes: DataFrame, as_of: Column
) -> tuple[DataFrame, DataFrame]:
    """Items after the outcomes, and the jobs rolled up from them."""
    new_items = apply_outcomes(items, outcomes, as_of)
    return new_items, job_rollup(new_items, jobs)


def orphan_items(items: DataFrame, jobs: DataFrame) -> DataFrame:
    """Items that name no job (the foreign key)."""
    return items.join(jobs.select("job_id"), "job_id", "left_anti")
