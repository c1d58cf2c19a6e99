"""Counters, histograms and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import settings as S


def http_request_counter(log: DataFrame) -> DataFrame:
    return log.groupBy("method", "path", "status").agg(F.count("*").alias("n"))


def latency_histogram(log: DataFrame) -> DataFrame:
    """Cumulative bucket counts per path, with total and sum, in one pass."""
    counts = [
        F.count_if(F.col("seconds") <= bound).alias(f"_{number}") for number, bound in enumerate(S.HISTOGRAM_BOUNDS)
    ]
    folded = log.groupBy("path").agg(*counts, F.count("*").alias("total"), F.sum("seconds").alias("sum_seconds"))
    buckets = [
        F.struct(F.lit(f"{bound:g}").alias("le"), F.col(f"_{number}").alias("n"))
        for number, bound in enumerate(S.HISTOGRAM_BOUNDS)
    ]
    buckets.append(F.struct(F.lit("+Inf").alias("le"), F.col("total").alias("n")))
    return folded.select("path", "total", "sum_seconds", F.explode(F.array(*buckets)).alias("bucket")).select(
        "path", "bucket.le", "bucket.n", "total", "sum_seconds"
    )


def error_code_counts(outcomes: DataFrame) -> DataFrame:
    """Requests per error code ('' = none) and its share of all requests.

    ``GROUPING SETS`` gives the total in the same pass; the joined total is one row.
    """
    code = F.coalesce("error_code", F.lit(""))
    counted = outcomes.groupBy(code.alias("error_code")).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("requests"))
    return counted.crossJoin(F.broadcast(total)).select(
        "error_code", "n", "requests", F.round(F.col("n") / F.col("requests"), 9).alias("share")
    )


#: Size of a latency sketch.
SKETCH_K = 800
_LEVELS = [["domain", "strategy"], ["domain"], []]


def rank_error(k: int = SKETCH_K) -> float:
    """How far a sketch's quantile may be from the asked rank, as a share of the rows, in 99 of 100 cases."""
    return 2.296 / k**0.9723


def latency_sketches(outcomes: DataFrame, k: int = SKETCH_K) -> DataFrame:
    """One row per hour, domain and strategy: rows, their sum and maximum, and a quantile sketch of bounded size.

    ``outcomes``: ts, domain, strategy, elapsed_ms. The rows are what is stored: any range of
    hours is put together from them (:func:`latency_of`) without the requests.
    """
    return outcomes.groupBy(F.date_trunc("hour", "ts").alias("hour"), "domain", "strategy").agg(
        F.count("elapsed_ms").alias("n"),
        F.sum(F.col("elapsed_ms").cast("bigint")).alias("sum_ms"),
        F.max("elapsed_ms").alias("max_ms"),
        F.kll_sketch_agg_bigint(F.col("elapsed_ms").cast("bigint"), k).alias("sketch"),
    )


def latency_of(sketches: DataFrame, share: float = 0.95, k: int = SKETCH_K) -> DataFrame:
    """Latency per domain and strategy, per domain, and overall (NULL = all), merged from stored sketches.

    Only sketches are shuffled; ``rank_error(k)`` bounds how far the percentile's rank is from ``share``.
    """
    merged = sketches.groupingSets(_LEVELS, "domain", "strategy").agg(
        F.sum("n").alias("n"), F.sum("sum_ms").alias("_sum"), F.max("max_ms").alias("max_ms"), F.kll_merge_agg_bigint("sketch", k).alias("_sketch")
    )
    # a group whose latencies are all NULL has an empty sketch, which has no quantile
    some = F.when(F.col("n") > 0, F.col("_sketch"))
    return merged.select("domain", "strategy", "n", (F.col("_sum") / F.col("n")).alias("mean_ms"), F.kll_sketch_get_quantile_bigint(some, F.lit(share)).alias("p95_ms"), "max_ms")


def latency_by_domain_strategy(outcomes: DataFrame, exact: bool = False, k: int = SKETCH_K) -> DataFrame:
    """Latency per domain and strategy, per domain, and overall (NULL = all).

    The percentile comes from sketches of bounded size (see :func:`latency_of`); ``exact=True``
    interpolates between the values and keeps one counter per distinct millisecond.
    """
    if not exact:
        stamped = outcomes if "ts" in outcomes.columns else outcomes.withColumn("ts", F.lit(None).cast("timestamp"))
        return latency_of(latency_sketches(stamped, k), k=k)
    return (
        outcomes.groupingSets(_LEVELS, "domain", "strategy")
        .agg(
            F.count("*").alias("n"),
            F.avg("elapsed_ms").alias("mean_ms"),
            F.percentile("elapsed_ms", 0.95).alias("p95_ms"),
            F.max("elapsed_ms").alias("max_ms"),
        )
    )


def cache_hit_rate(outcomes: DataFrame) -> DataFrame:
    """Hits over look-ups; requests that skip reading are no look-ups."""
    return outcomes.where(F.col("read")).agg(
        F.count("*").alias("lookups"),
        F.count_if(F.col("outcome") == "hit").alias("hits"),
        F.round(F.avg((F.col("outcome") == "hit").cast("double")), 9).alias("hit_rate"),
    )


def queue_depth(items: DataFrame) -> DataFrame:
    """Waiting, running and failed items per queue and the oldest waiting one's time."""
    return items.groupBy("queue").agg(
        F.count_if(F.col("state") == "queued").alias("waiting"),
        F.count_if(F.col("state") == "running").alias("running"),
        F.count_if(F.col("state") == "failed").alias("failed"),
        F.min(F.when(F.col("state") == "queued", F.col("created_at"))).alias("oldest_waiting"),
    )
