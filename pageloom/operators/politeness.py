"""Per-domain pacing in a recorded log: gaps, concurrency, runs of failures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timing import micros
from ..plans.running import SECOND_US, running, with_chunk
from ..settings import DEFAULTS


def rate_slots(
    requests: DataFrame, interval_us: int = DEFAULTS.domain_interval_us, chunk_us: int = SECOND_US
) -> DataFrame:
    """Recorded gaps per domain: each request's distance to the one before, and how far it is below the interval.

    ``requests``: request_id, domain, ts. The first request of a domain has no gap.
    """
    arrivals = requests.select("request_id", "domain", micros(F.col("ts")).alias("arrival_us"))
    line = with_chunk(arrivals, F.col("arrival_us"), chunk_us)
    seen = running(line, ["domain"], ["arrival_us", "request_id"], {"before": ("max", F.col("arrival_us"))}, exclusive=True)
    gap = F.col("arrival_us") - F.col("before")
    return seen.select(
        "request_id", "domain", "arrival_us", gap.alias("gap_us"),
        F.coalesce(F.greatest(F.lit(interval_us) - gap, F.lit(0)), F.lit(0)).cast("bigint").alias("short_us"),
    )


def domain_concurrency(
    flights: DataFrame, limit: int = DEFAULTS.domain_concurrency, chunk_us: int = SECOND_US
) -> DataFrame:
    """Peak number of requests in flight per domain and how many started above the limit.

    ``flights``: domain, start_us, end_us. A sweep over starts (+1) and ends (-1);
    an end frees its place for a start at the same time.
    """
    starts = flights.select("domain", F.col("start_us").alias("at"), F.lit(1).alias("step"))
    ends = flights.select("domain", F.col("end_us").alias("at"), F.lit(-1).alias("step"))
    # equal steps at one time are one row: less to shuffle on busy domains
    moves = starts.unionByName(ends).groupBy("domain", "at", "step").agg(F.count("*").alias("n"))
    line = with_chunk(moves, F.col("at"), chunk_us)
    level = running(
        line, ["domain"], ["at", "step"], {"in_flight": ("sum", (F.col("step") * F.col("n")).cast("bigint"))}
    )
    above = F.least(F.greatest(F.col("in_flight") - limit, F.lit(0)), F.col("n"))
    return level.groupBy("domain").agg(
        F.max("in_flight").alias("peak"),
        F.sum(F.when(F.col("step") == 1, F.col("n")).otherwise(0)).alias("requests"),
        F.sum(F.when(F.col("step") == 1, above).otherwise(0)).alias("above_limit"),
    )


def circuit_breaker(outcomes: DataFrame, failures: int = 5, chunk_us: int = SECOND_US) -> DataFrame:
    """Runs of at least ``failures`` recorded failures in a row: (domain, start_us, end_us, failures).

    ``outcomes``: request_id, domain, ts, failed (NULL for errors that are not the domain's
    fault; these neither count nor end a run). Gaps and islands: failures with as many
    successes before them are one run.
    """
    rows = outcomes.select("request_id", "domain", micros(F.col("ts")).alias("at"), F.col("failed").cast("boolean").alias("failed"))
    line = with_chunk(rows, F.col("at"), chunk_us)
    good = F.coalesce(~F.col("failed"), F.lit(False)).cast("bigint")
    island = running(line, ["domain"], ["at", "request_id"], {"good": ("sum", good)})
    runs = island.where("failed").groupBy("domain", "good").agg(
        F.min("at").alias("start_us"), F.max("at").alias("end_us"), F.count("*").alias("failures")
    )
    return runs.where(F.col("failures") >= failures).drop("good")
