"""Counters, histograms, report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import metrics as M
from .. import settings as S
from ..session import scratch_path
from .book import DOMAIN, query


@query(
    "http_request_counter",
    "f_http_log",
    sql="SELECT method, path, status, count(*) AS n FROM f_http_log GROUP BY 1, 2, 3",
)
def http_request_counter(spark, root):
    return M.http_request_counter(spark.table("f_http_log"))


_BOUNDS = ", ".join(f"('{bound:g}', {bound})" for bound in S.HISTOGRAM_BOUNDS) + ", ('+Inf', 1e300)"


@query(
    "latency_histogram",
    "f_http_log",
    sql=f"""SELECT path, le, count(*) FILTER (seconds <= b) AS n, count(*) AS total, round(sum(seconds), 6) AS sum_seconds
FROM f_http_log CROSS JOIN (VALUES {_BOUNDS}) v(le, b) GROUP BY path, le""",
)
def latency_histogram(spark, root):
    histogram = M.latency_histogram(spark.table("f_http_log"))
    return histogram.withColumn("sum_seconds", F.round("sum_seconds", 6))


_CODES = "CASE status_code WHEN 403 THEN 'DOMAIN_NOT_ALLOWED' WHEN 429 THEN 'READ_TIMEOUT' WHEN 503 THEN 'CONNECT_FAILED' END"


@query(
    "error_code_counts",
    "f_requests",
    sql=f"""SELECT coalesce({_CODES}, '') AS error_code, count(*) AS n, (SELECT count(*) FROM f_requests) AS requests,
 round(count(*) / (SELECT count(*) FROM f_requests), 9) AS share FROM f_requests GROUP BY 1""",
)
def error_code_counts(spark, root):
    return M.error_code_counts(spark.table("f_requests").withColumn("error_code", F.expr(_CODES)))


_STRATEGY = "CASE mode WHEN 'browser' THEN 'browser' ELSE 'http' END"


@query(
    "latency_by_domain_strategy",
    "f_requests",
    sql=f"""SELECT domain, strategy, count(*) AS n, round(avg(elapsed_ms), 6) AS mean_ms, round(quantile_cont(elapsed_ms, 0.95), 6) AS p95_ms,
 max(elapsed_ms) AS max_ms FROM (SELECT *, {DOMAIN} AS domain, {_STRATEGY} AS strategy FROM f_requests)
GROUP BY GROUPING SETS ((domain, strategy), (domain), ())""",
)
def latency_by_domain_strategy(spark, root):
    log = spark.table("f_requests").select(
        U.domain_of(F.col("url")).alias("domain"), F.expr(_STRATEGY).alias("strategy"), "elapsed_ms"
    )
    table = M.latency_by_domain_strategy(log, exact=True)
    return table.select(
        "domain", "strategy", "n", F.round("mean_ms", 6).alias("mean_ms"), F.round("p95_ms", 6).alias("p95_ms"), "max_ms"
    )


@query(
    "latency_sketch_range",
    "f_requests",
    sql=f"""WITH r AS (SELECT {DOMAIN} AS domain, {_STRATEGY} AS strategy, elapsed_ms FROM f_requests
 WHERE ts >= (SELECT date_trunc('hour', min(ts)) + INTERVAL 24 HOUR FROM f_requests))
SELECT domain, strategy, count(*) AS n, round(avg(elapsed_ms), 6) AS mean_ms, max(elapsed_ms) AS max_ms, TRUE AS within
FROM r GROUP BY GROUPING SETS ((domain, strategy), (domain), ())""",
)
def latency_sketch_range(spark, root):
    """Sketches of each hour are stored; all but the first day's are merged, and their percentiles held against the exact ranks."""
    log = spark.table("f_requests").select("ts", U.domain_of(F.col("url")).alias("domain"), F.expr(_STRATEGY).alias("strategy"), "elapsed_ms")
    path = scratch_path(spark, "latency-hours")
    M.latency_sketches(log.withColumn("ts", F.col("ts").cast("timestamp"))).write.parquet(path)
    stored = spark.read.parquet(path)
    first = stored.agg(F.min("hour").alias("first"))
    late = lambda rows, at: rows.crossJoin(F.broadcast(first)).where(F.col(at) >= F.col("first") + F.expr("INTERVAL 24 HOUR"))
    found = M.latency_of(late(stored, "hour"))
    asked = found.select(F.col("domain").alias("d"), F.col("strategy").alias("s"), "p95_ms")
    rows = late(log.withColumn("at", F.col("ts").cast("timestamp")), "at")
    # each row counts for its strategy, its domain and for all
    levels = F.explode(F.array(F.struct("domain", "strategy"), F.struct("domain", F.lit(None).alias("strategy")), F.struct(F.lit(None).alias("domain"), F.lit(None).alias("strategy"))))
    each = rows.select(levels.alias("g"), "elapsed_ms").groupBy("g", "elapsed_ms").agg(F.count("*").alias("c"))
    met = each.join(asked, F.col("g.domain").eqNullSafe(F.col("d")) & F.col("g.strategy").eqNullSafe(F.col("s")))
    ranks = met.groupBy("d", "s").agg(
        (F.sum(F.when(F.col("elapsed_ms") < F.col("p95_ms"), F.col("c")).otherwise(0)) / F.sum("c")).alias("below"),
        (F.sum(F.when(F.col("elapsed_ms") <= F.col("p95_ms"), F.col("c")).otherwise(0)) / F.sum("c")).alias("up_to"),
    )
    error = 2 * M.rank_error()  # the bound holds in 99 of 100 cases; twice as much in all
    within = (F.col("below") <= 0.95 + error) & (F.col("up_to") >= 0.95 - error)
    return found.join(ranks, F.col("domain").eqNullSafe(F.col("d")) & F.col("strategy").eqNullSafe(F.col("s"))).select(
        "domain", "strategy", "n", F.round("mean_ms", 6).alias("mean_ms"), "max_ms", within.alias("within")
    )
