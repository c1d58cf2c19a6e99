"""Job and item tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.timing import micros
from ..operators import jobs as J
from ..session import scratch_path
from ..sources import jobs_io
from .book import query

_NOW = "1998-06-01 00:00:00"


def now():
    return F.lit(_NOW).cast("timestamp_ntz")


_BATCHES = """SELECT job_id, client_id, created_at, 'normal' AS priority FROM f_jobs"""


def batches(spark):
    """Ten requests per job, as an array, made from the job row itself."""
    request = F.transform(
        F.sequence(F.lit(0), F.lit(9)),
        lambda at: F.struct(
            F.concat(F.lit("https://h"), F.col("job_id").cast("string"), F.lit(".example.org/"), at.cast("string")).alias("url"),
            F.when(at % 3 == 0, "http").when(at % 3 == 1, "browser").alias("mode"),
        ),
    )
    return spark.sql(_BATCHES).withColumn("requests", request)


_ITEMS = """(SELECT job_id, created_at, CAST(p AS INTEGER) AS position, concat('https://h', job_id, '.example.org/', p) AS url,
 CASE p % 3 WHEN 0 THEN 'http' WHEN 1 THEN 'browser' END AS mode FROM f_jobs CROSS JOIN range(10) r(p))"""


@query("item_positions", "f_jobs", sql=f"SELECT job_id, position, url FROM {_ITEMS}")
def item_positions(spark, root):
    return J.item_positions(batches(spark)).select("job_id", "position", "request.url")


@query(
    "job_create",
    "f_jobs",
    sql=f"""SELECT job_id, position, concat('item_', sha256(concat(job_id, chr(1), position))[1:32]) AS item_id,
 concat('{{"url":"', url, '","mode":', coalesce('"' || mode || '"', 'null'), '}}') AS payload,
 CASE mode WHEN 'http' THEN 'http' ELSE 'browser' END AS queue, 'queued' AS state, CAST(10 AS INTEGER) AS item_count FROM {_ITEMS}""",
)
def job_create(spark, root):
    jobs, items = J.job_create(batches(spark))
    return items.join(jobs.select("job_id", "item_count"), "job_id").select(
        "job_id", "position", "item_id", "payload", "queue", "state", "item_count"
    )


@query("job_item_count", "f_job_items", sql="SELECT job_id, count(*) AS item_count FROM f_job_items GROUP BY job_id")
def job_item_count(spark, root):
    return J.job_item_count(spark.table("f_job_items"))


@query(
    "job_with_items",
    "f_jobs",
    "f_job_items",
    sql="""SELECT j.job_id, j.client_id, j.prior_state, i.item_id, i.position, i.state FROM f_jobs j
LEFT JOIN f_job_items i ON i.job_id = j.job_id WHERE j.client_id = 3""",
)
def job_with_items(spark, root):
    joined = J.job_with_items(spark.table("f_jobs"), spark.table("f_job_items"), client_id=3)
    return joined.select("job_id", "client_id", "prior_state", "item_id", "position", "state")


@query(
    "job_view_project",
    "f_jobs",
    "f_job_items",
    sql="""SELECT job_id, j.client_id, epoch_us(j.created_at) AS created_us, j.prior_state AS state, count(*) OVER w AS item_count,
 count(*) FILTER (i.state = 'succeeded') OVER w AS succeeded_count, count(*) FILTER (i.state = 'failed') OVER w AS failed_count,
 i.position, i.item_id, i.state AS item_state, i.request_id, i.error_code
FROM f_jobs j JOIN f_job_items i USING (job_id) WINDOW w AS (PARTITION BY job_id)""",
)
def job_view_project(spark, root):
    view = J.job_view(spark.table("f_jobs"), spark.table("f_job_items"))
    return view.withColumn("created_us", micros(F.col("created_at"))).drop("created_at")


_LOOKUPS = "SELECT DISTINCT o_orderkey AS job_id, o_custkey % 7 AS client_id FROM orders"


@query(
    "job_not_found",
    "f_jobs",
    sql=f"""SELECT job_id, client_id, 'JOB_NOT_FOUND' AS error FROM ({_LOOKUPS}) l
WHERE NOT EXISTS (SELECT 1 FROM f_jobs j WHERE j.job_id = l.job_id AND j.client_id = l.client_id)""",
)
def job_not_found(spark, root):
    return J.job_not_found(spark.sql(_LOOKUPS), spark.table("f_jobs"))


_ENDED = "('succeeded', 'failed', 'cancelled')"


def rollup_sql(items: str) -> str:
    return f"""SELECT j.job_id, count(*) FILTER (i.state = 'succeeded') AS succeeded_count, count(*) FILTER (i.state = 'failed') AS failed_count,
 CASE WHEN bool_and(i.state IN {_ENDED}) THEN CASE WHEN bool_or(i.state = 'failed') THEN 'failed' ELSE 'succeeded' END
  WHEN bool_or(i.state = 'running') THEN 'running' ELSE min(j.prior_state) END AS state
FROM f_jobs j JOIN {items} i ON i.job_id = j.job_id GROUP BY j.job_id"""


@query("job_rollup", "f_jobs", "f_job_items", sql=rollup_sql("f_job_items"))
def job_rollup(spark, root):
    return J.job_rollup(spark.table("f_job_items"), spark.table("f_jobs"))


@query(
    "job_cancel",
    "f_jobs",
    "f_job_items",
    sql=f"""WITH c AS (SELECT job_id FROM f_jobs WHERE client_id = 3),
i AS (SELECT job_id, item_id, CASE WHEN state = 'queued' AND job_id IN (SELECT job_id FROM c) THEN 'cancelled' ELSE state END AS state FROM f_job_items),
j AS (SELECT job_id, CASE WHEN job_id IN (SELECT job_id FROM c) AND bool_and(i.state IN {_ENDED}) THEN 'cancelled' ELSE min(prior_state) END AS job_state
 FROM f_jobs JOIN i USING (job_id) GROUP BY job_id)
SELECT item_id, job_id, i.state, job_state FROM i JOIN j USING (job_id)""",
)
def job_cancel(spark, root):
    """Client 3 asks to cancel every job; only its own ones are."""
    jobs, items = spark.table("f_jobs"), spark.table("f_job_items")
    cancels = jobs.select("job_id", F.lit(3).cast("bigint").alias("client_id"))
    new_jobs, new_items = J.job_cancel(jobs, items, cancels)
    return new_items.join(new_jobs.select("job_id", F.col("state").alias("job_state")), "job_id").select(
        "item_id", "job_id", "state", "job_state"
    )


_CLAIM = f"""SELECT *, row_number() OVER (PARTITION BY queue ORDER BY next_run_at, created_at, item_id) AS rank FROM f_queue
 WHERE next_run_at <= TIMESTAMP '{_NOW}' AND (state = 'queued' OR (state = 'running' AND leased_until < TIMESTAMP '{_NOW}'))"""


@query("claim_order", "f_queue", sql=f"SELECT item_id, queue, CAST(rank AS INTEGER) AS rank FROM ({_CLAIM}) WHERE rank <= 5")
def claim_order(spark, root):
    return J.claim_order(spark.table("f_queue"), now(), per_queue=5).select("item_id", "queue", "rank")


_ITEM = "item_id, job_id, position, queue, attempts, worker_id, request_id, result, error_code, error_message, state"


def _whole(items, *more):
    """Every column of the items, times as numbers."""
    return items.select(
        *_ITEM.split(", "), micros(F.col("leased_until")).alias("leased_us"), micros(F.col("next_run_at")).alias("next_run_us"), *more
    )


@query(
    "item_claim",
    "f_queue",
    "f_jobs",
    sql=f"""WITH c AS (SELECT item_id, job_id FROM ({_CLAIM}) WHERE rank <= 100)
SELECT q.item_id, q.job_id, q.position, q.queue, q.attempts + CASE WHEN c.item_id IS NULL THEN 0 ELSE 1 END AS attempts,
 CASE WHEN c.item_id IS NOT NULL THEN 'w1' ELSE q.worker_id END AS worker_id, q.request_id, q.result, q.error_code, q.error_message,
 CASE WHEN c.item_id IS NULL THEN q.state ELSE 'running' END AS state, epoch_us(CASE WHEN c.item_id IS NULL THEN q.leased_until
  ELSE TIMESTAMP '{_NOW}' + INTERVAL 120 SECOND END) AS leased_us, epoch_us(q.next_run_at) AS next_run_us,
 CASE WHEN q.job_id IN (SELECT job_id FROM c) THEN 'running' ELSE j.prior_state END AS job_state
FROM f_queue q JOIN f_jobs j USING (job_id) LEFT JOIN c ON c.item_id = q.item_id""",
)
def item_claim(spark, root):
    items, jobs = J.item_claim(spark.table("f_queue"), spark.table("f_jobs"), now(), "w1", per_queue=100)
    return _whole(items).join(jobs.select("job_id", F.col("state").alias("job_state")), "job_id")


_CLAIMED = f"""WITH c AS (SELECT item_id FROM ({_CLAIM}) WHERE rank <= 100)
SELECT q.item_id, q.job_id, q.position, q.queue, q.attempts + CASE WHEN c.item_id IS NULL THEN 0 ELSE 1 END AS attempts,
 CASE WHEN c.item_id IS NOT NULL THEN 'w1' ELSE q.worker_id END AS worker_id, q.request_id, q.result, q.error_code, q.error_message,
 CASE WHEN c.item_id IS NULL THEN q.state ELSE 'running' END AS state, epoch_us(CASE WHEN c.item_id IS NULL THEN q.leased_until
  ELSE TIMESTAMP '{_NOW}' + INTERVAL 120 SECOND END) AS leased_us, epoch_us(q.next_run_at) AS next_run_us,
 CASE WHEN c.item_id IS NULL THEN 0 ELSE 1 END AS version FROM f_queue q LEFT JOIN c ON c.item_id = q.item_id"""


@query("item_claim_changes", "f_queue", sql=_CLAIMED)
def item_claim_changes(spark, root):
    """A claim writes the claimed items alone; the table is the base with them."""
    path = scratch_path(spark, "claimed")
    jobs_io.write_base(spark.table("f_queue"), path)
    base = jobs_io.read_items(spark, path, changed=False)
    jobs_io.append_changes(J.claim_changes(base, now(), "w1", per_queue=100).drop("version", "part"), path, 1)
    items = jobs_io.read_items(spark, path)
    return _whole(items, F.col("version").cast("int").alias("version"))


_CODE = "CASE WHEN o.error_code = 'CRASH' THEN 'INTERNAL_ERROR' ELSE o.error_code END"
_AGAIN = "coalesce(o.error_code IN ('READ_TIMEOUT', 'CRASH') AND i.attempts < 3, FALSE)"
# the latest attempt of each item that reported
_LATEST = "(SELECT * FROM {outcomes} QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY attempt DESC) = 1)"
_APPLIED = f"""(SELECT i.item_id, i.job_id, i.position, i.queue, i.attempts, i.worker_id,
 CASE WHEN o.item_id IS NOT NULL AND o.error_code IS NULL THEN o.request_id ELSE i.request_id END AS request_id,
 CASE WHEN o.item_id IS NOT NULL AND o.error_code IS NULL THEN o.result ELSE i.result END AS result,
 coalesce({_CODE}, i.error_code) AS error_code, CASE WHEN o.error_code IS NOT NULL THEN o.error_message ELSE i.error_message END AS error_message,
 CASE WHEN o.item_id IS NULL THEN i.state WHEN o.error_code IS NULL THEN 'succeeded' WHEN {_AGAIN} THEN 'queued' ELSE 'failed' END AS state,
 epoch_us(CASE WHEN o.item_id IS NULL THEN i.leased_until END) AS leased_us,
 epoch_us(CASE WHEN {_AGAIN} THEN TIMESTAMP '{_NOW}' + to_seconds(CASE WHEN coalesce(o.retry_after_seconds, 0) = 0
  THEN power(2, i.attempts) ELSE o.retry_after_seconds END) ELSE i.next_run_at END) AS next_run_us
FROM f_job_items i LEFT JOIN {_LATEST} o ON o.item_id = i.item_id)"""


@query(
    "item_complete",
    "f_job_items",
    "f_outcomes",
    sql=f"SELECT * FROM {_APPLIED.format(outcomes='(SELECT * FROM f_outcomes WHERE error_code IS NULL)')}",
)
def item_complete(spark, root):
    return _whole(J.item_complete(spark.table("f_job_items"), spark.table("f_outcomes")))


@query(
    "item_fail",
    "f_job_items",
    "f_outcomes",
    sql=f"SELECT * FROM {_APPLIED.format(outcomes='(SELECT * FROM f_outcomes WHERE error_code IS NOT NULL)')}",
)
def item_fail(spark, root):
    return _whole(J.item_fail(spark.table("f_job_items"), spark.table("f_outcomes"), now()))


BATCH_SQL = f"""SELECT a.*, r.succeeded_count, r.failed_count, r.state AS job_state FROM {_APPLIED.format(outcomes='f_outcomes')} a
JOIN ({rollup_sql(_APPLIED.format(outcomes='f_outcomes'))}) r USING (job_id)"""


def applied(items, jobs):
    """Items after a batch, with their job's counts and state."""
    return _whole(items).join(jobs.withColumnRenamed("state", "job_state"), "job_id")


@query("batch_outcome_apply", "f_job_items", "f_jobs", "f_outcomes", sql=BATCH_SQL)
def batch_outcome_apply(spark, root):
    return applied(*J.batch_outcome_apply(spark.table("f_job_items"), spark.table("f_jobs"), spark.table("f_outcomes"), now()))


@query(
    "batch_outcome_changes",
    "f_job_items",
    "f_outcomes",
    sql=f"SELECT a.*, o.item_id IS NOT NULL AS changed FROM {_APPLIED.format(outcomes='f_outcomes')} a LEFT JOIN (SELECT DISTINCT item_id FROM f_outcomes) o USING (item_id)",
)
def batch_outcome_changes(spark, root):
    """Outcomes write the items that they are about, in two versions, which are then brought into the base."""
    path = scratch_path(spark, "outcomes-applied")
    jobs_io.write_base(spark.table("f_job_items"), path)
    outcomes = spark.table("f_outcomes")
    for version, half in ((1, F.col("item_id") % 2 == 0), (2, F.col("item_id") % 2 == 1)):
        items = jobs_io.read_items(spark, path, changed=version > 1)
        jobs_io.append_changes(J.outcome_changes(items, outcomes.where(half), now()).drop("version", "part"), path, version)
    jobs_io.compact(spark, path)
    return _whole(jobs_io.read_items(spark, path), (F.col("version") > 0).alias("changed"))


@query("items_sorted", "f_job_items", sql="SELECT job_id, position, item_id, state FROM f_job_items ORDER BY job_id, position")
def items_sorted(spark, root):
    return J.items_sorted(spark.table("f_job_items")).select("job_id", "position", "item_id", "state")


@query(
    "job_tables_io",
    "f_job_items",
    "f_jobs",
    sql="""SELECT queue, state, count(*) AS items, CAST(sum(attempts) AS BIGINT) AS attempts,
 count(*) FILTER (client_id = 3) AS orphans FROM f_job_items GROUP BY queue, state""",
)
def job_tables_io(spark, root):
    """Write both tables, read them back, and check the foreign key; items of client 3 name a job that does not exist."""
    path = scratch_path(spark, "jobs")
    lost = spark.table("f_job_items").withColumn("job_id", F.when(F.col("client_id") == 3, -F.col("job_id") - 1).otherwise(F.col("job_id")))
    jobs_io.write_tables(spark.table("f_jobs"), lost, path)
    jobs, items = jobs_io.read_tables(spark, path)
    orphans = J.orphan_items(items, jobs).groupBy("queue", "state").agg(F.count("*").alias("orphans"))
    stored = items.groupBy("queue", "state").agg(F.count("*").alias("items"), F.sum("attempts").alias("attempts"))
    return stored.join(orphans, ["queue", "state"], "left").fillna(0, ["orphans"])


@query(
    "queue_depth",
    "f_queue",
    sql="""SELECT queue, count(*) FILTER (state = 'queued') AS waiting, count(*) FILTER (state = 'running') AS running,
 count(*) FILTER (state = 'failed') AS failed, epoch_us(min(CASE WHEN state = 'queued' THEN created_at END)) AS oldest_us FROM f_queue GROUP BY queue""",
)
def queue_depth(spark, root):
    from ..operators import metrics as M

    depth = M.queue_depth(spark.table("f_queue"))
    return depth.select("queue", "waiting", "running", "failed", micros(F.col("oldest_waiting")).alias("oldest_us"))
