"""Streaming twins over the event table read as a stream, whatever the order of its files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as U
from ..sources.fixtures import VIEWS
from ..streaming import jobs as Z
from .book import DOMAIN, query
from .jobs import BATCH_SQL, applied, now


def stream_view(spark, root, name):
    """A derived view computed over the streamed event table."""
    Z.table_stream(spark, root, "events").createOrReplaceTempView("events")
    spark.sql(VIEWS[name]).createOrReplaceTempView(name)


def _log(spark):
    stamped = spark.table("f_requests").withColumn("ts", F.col("ts").cast("timestamp"))
    return stamped.select(
        F.concat_ws("|", "url", "mode").alias("fetch_key"), U.domain_of(F.col("url")).alias("domain"), "ts",
        F.col("status_code").between(200, 399).alias("success"),
    )


@query(
    "stream_cache",
    sql="""SELECT concat_ws('|', url, mode) AS fetch_key, epoch_us(date_trunc('hour', ts)) AS hour_us, count(*) AS n,
 count(*) FILTER (status_code BETWEEN 200 AND 399) AS n_success, epoch_us(max(ts)) AS last_used_us FROM f_requests GROUP BY 1, 2""",
    oracle_views=("f_requests",),
)
def stream_cache(spark, root):
    stream_view(spark, root, "f_requests")
    parts = Z.run_to_end(_log(spark), "cache", each=Z.stream_cache)
    whole = Z.merged(parts, ["fetch_key", "hour"], n=F.sum, n_success=F.sum, last_used=F.max)
    return whole.select("fetch_key", F.unix_micros("hour").alias("hour_us"), "n", "n_success", F.unix_micros("last_used").alias("last_used_us"))


@query(
    "stream_inflight_dedupe",
    sql="SELECT DISTINCT concat_ws('|', url, mode) AS fetch_key, epoch_us(date_trunc('hour', ts)) AS hour_us FROM f_requests",
    oracle_views=("f_requests",),
)
def stream_inflight_dedupe(spark, root):
    stream_view(spark, root, "f_requests")
    parts = Z.run_to_end(_log(spark), "dedupe", each=lambda log: Z.with_hour(log).select("fetch_key", "hour").distinct())
    return Z.merged(parts, ["fetch_key", "hour"]).select("fetch_key", F.unix_micros("hour").alias("hour_us"))


@query(
    "stream_rate_slots",
    sql=f"""SELECT {DOMAIN} AS domain, epoch_us(time_bucket(INTERVAL 10 MINUTE, ts)) AS slot_us, count(*) AS n, count(*) - 1 AS above
FROM f_requests GROUP BY 1, 2""",
    oracle_views=("f_requests",),
)
def stream_rate_slots(spark, root):
    stream_view(spark, root, "f_requests")
    parts = Z.run_to_end(_log(spark), "slots", each=Z.stream_rate_slots)
    whole = Z.merged(parts, ["domain", "slot"], n=F.sum)
    return whole.select("domain", F.unix_micros("slot").alias("slot_us"), "n", (F.col("n") - 1).alias("above"))


@query(
    "stream_request_counters",
    sql="""SELECT epoch_us(date_trunc('minute', ts)) AS minute_us, method, path, status, count(*) AS n, round(sum(seconds), 6) AS sum_seconds
FROM f_http_log GROUP BY 1, 2, 3, 4""",
    oracle_views=("f_http_log",),
)
def stream_request_counters(spark, root):
    stream_view(spark, root, "f_http_log")
    log = spark.table("f_http_log").withColumn("ts", F.col("ts").cast("timestamp"))
    parts = Z.run_to_end(log, "counters", each=Z.stream_request_counters)
    whole = Z.merged(parts, ["minute", "method", "path", "status"], n=F.sum, sum_seconds=F.sum)
    return whole.select(
        F.unix_micros("minute").alias("minute_us"), "method", "path", "status", "n", F.round("sum_seconds", 6).alias("sum_seconds")
    )


@query(
    "stream_inflight_live",
    sql="SELECT DISTINCT concat_ws('|', url, mode) AS fetch_key, epoch_us(date_trunc('hour', ts)) AS hour_us FROM f_requests",
    oracle_views=("f_requests",),
)
def stream_inflight_live(spark, root):
    """The de-duplication with its state in the stream; a watermark over the table's span, and late rows are an error."""
    stream_view(spark, root, "f_requests")
    passed = Z.run_to_end(Z.stream_inflight_dedupe(_log(spark), Z.span(spark, root, "events")), "dedupe-live", whole=True)
    return passed.select("fetch_key", F.unix_micros("hour").alias("hour_us"))


@query(
    "stream_counters_live",
    sql="""SELECT epoch_us(date_trunc('minute', ts)) AS minute_us, method, path, status, count(*) AS n, round(sum(seconds), 6) AS sum_seconds
FROM f_http_log GROUP BY 1, 2, 3, 4""",
    oracle_views=("f_http_log",),
)
def stream_counters_live(spark, root):
    """The counters with their state in the stream; the last update of each stands."""
    stream_view(spark, root, "f_http_log")
    log = spark.table("f_http_log").withColumn("ts", F.col("ts").cast("timestamp"))
    updates = Z.run_to_end(Z.stream_request_counters(log, Z.span(spark, root, "events")), "counters-live", "update", whole=True)
    whole = Z.latest_update(updates, ["minute", "method", "path", "status"])
    return whole.select(
        F.unix_micros("minute").alias("minute_us"), "method", "path", "status", "n", F.round("sum_seconds", 6).alias("sum_seconds")
    )


@query("stream_job_state", "f_job_items", "f_jobs", sql=BATCH_SQL, oracle_views=("f_job_items", "f_jobs", "f_outcomes"))
def stream_job_state(spark, root):
    """Outcome events stream in; the item and job tables are static."""
    items, jobs = spark.table("f_job_items"), spark.table("f_jobs")
    Z.table_stream(spark, root, "orders").createOrReplaceTempView("orders")
    spark.sql(VIEWS["f_job_items"]).createOrReplaceTempView("f_job_items")
    return applied(*Z.stream_job_state(spark.sql(VIEWS["f_outcomes"]), items, jobs, now()))
