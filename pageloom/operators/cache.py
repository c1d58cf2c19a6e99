"""Cache reuse in a recorded request log: look-ups, reuse, overlaps, recency.

A request log row has fetch_key, request_id, ts, ttl, force_refresh, success and,
where flight times matter, elapsed_ms. Rows of one key are in order of (ts, request_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timing import micros
from ..plans.running import SECOND_US, running, with_chunk
from ..settings import DEFAULTS
from .requests import may_read, may_write

# ---------------------------------------------------------------------------
# look-up
# ---------------------------------------------------------------------------
def cache_lookup(requests: DataFrame, entries: DataFrame, chunk_us: int = SECOND_US) -> DataFrame:
    """As-of join: the entry last set before a request, if it has not expired.

    ``requests``: request_id, fetch_key, ts. ``entries``: entry_id, fetch_key, set_at,
    expires_at. A newer entry replaces an older one, so only the newest counts. Both
    sides become one timeline with a running maximum; no row pairs are built.
    """
    sets = entries.select(
        "fetch_key",
        micros(F.col("set_at")).alias("at"),
        F.lit(0).alias("kind"),
        F.lit(None).cast(requests.schema["request_id"].dataType).alias("request_id"),
        F.struct(
            micros(F.col("set_at")).alias("set_at"),
            F.col("entry_id").alias("entry_id"),
            micros(F.col("expires_at")).alias("expires_at"),
        ).alias("entry"),
    )
    reads = requests.select(
        "fetch_key",
        micros(F.col("ts")).alias("at"),
        F.lit(1).alias("kind"),
        "request_id",
        F.lit(None).cast(sets.schema["entry"].dataType).alias("entry"),
    )
    line = with_chunk(sets.unionByName(reads), F.col("at"), chunk_us)
    latest = running(line, ["fetch_key"], ["at", "kind"], {"seen": ("max", F.col("entry"))})
    alive = F.col("seen.expires_at") > F.col("at")
    return latest.where(F.col("kind") == 1).select(
        "request_id",
        "fetch_key",
        F.when(alive, F.col("seen.entry_id")).alias("entry_id"),
        F.coalesce(alive, F.lit(False)).alias("hit"),
    )


# ---------------------------------------------------------------------------
# what the log records about reuse
# ---------------------------------------------------------------------------
def cache_replay(log: DataFrame, negative_ttl: int | None = None, chunk_us: int = SECOND_US) -> DataFrame:
    """hit or miss per request: (fetch_key, request_id, at, outcome, and the log's ``read`` where it has one), from recorded responses.

    Each recorded success with a ttl is an entry from its own time on; a request that may
    read hits if the newest one before it has not expired. With ``negative_ttl`` recorded
    failures are entries too, for that many seconds at most, and give ``negative_hit``.
    Every recorded response counts, whether or not a cache would have let it happen.
    """
    rows = log.select(
        "fetch_key", micros(F.col("ts")).alias("at"), "request_id", "force_refresh", "success",
        (F.col("ttl").cast("bigint") * 1_000_000).alias("ttl_us"), *([name for name in ("read",) if name in log.columns]),
    )
    life = F.col("ttl_us") if negative_ttl is None else F.when(F.col("success"), F.col("ttl_us")).otherwise(F.least("ttl_us", F.lit(negative_ttl * 1_000_000)))
    kept = (F.col("ttl_us") > 0) & (F.col("success") if negative_ttl is None else F.lit(True))
    entry = F.when(kept, F.struct("at", "request_id", (F.col("at") + life).alias("expires"), "success"))
    line = with_chunk(rows, F.col("at"), chunk_us)
    latest = running(line, ["fetch_key"], ["at", "request_id"], {"entry": ("max", entry)}, exclusive=True)
    hit = ~F.col("force_refresh") & (F.col("ttl_us") > 0) & F.coalesce(F.col("entry.expires") > F.col("at"), F.lit(False))
    outcome = F.when(hit & F.col("entry.success"), "hit").when(hit, "negative_hit").otherwise("miss")
    return latest.select("fetch_key", "request_id", "at", outcome.alias("outcome"), *([name for name in ("read",) if name in log.columns]))


def negative_cache(log: DataFrame, negative_ttl: int, chunk_us: int = SECOND_US) -> DataFrame:
    """The same with recorded failures, for at most ``negative_ttl`` seconds."""
    return cache_replay(log, negative_ttl, chunk_us)


def inflight_merge(log: DataFrame, chunk_us: int = SECOND_US) -> DataFrame:
    """Requests that came while an earlier one of their key was in flight: (fetch_key, request_id, at, busy_until, overlaps).

    A running maximum of the recorded ends; an end frees the key for a request at its time.
    """
    rows = log.select("fetch_key", micros(F.col("ts")).alias("at"), "request_id", (F.col("elapsed_ms") * 1000).cast("bigint").alias("elapsed_us"))
    line = with_chunk(rows, F.col("at"), chunk_us)
    seen = running(line, ["fetch_key"], ["at", "request_id"], {"busy_until": ("max", F.col("at") + F.col("elapsed_us"))}, exclusive=True)
    return seen.select("fetch_key", "request_id", "at", "busy_until", F.coalesce(F.col("busy_until") > F.col("at"), F.lit(False)).alias("overlaps"))


# ---------------------------------------------------------------------------
# eviction, fallback, purge
# ---------------------------------------------------------------------------
def lru_resident(log: DataFrame, entries: int = DEFAULTS.cache_entries) -> DataFrame:
    """The ``entries`` keys used last (fetch_key, last_used_at, last_request): pre-aggregated per key, then a top-k."""
    used = log.groupBy("fetch_key").agg(F.max(F.struct(micros(F.col("ts")).alias("at"), "request_id")).alias("last"))
    return (
        used.select("fetch_key", F.col("last.at").alias("last_used_at"), F.col("last.request_id").alias("last_request"))
        .orderBy(F.desc("last_used_at"), F.desc("last_request"))
        .limit(entries)
    )


def stale_if_error(log: DataFrame, chunk_us: int = SECOND_US) -> DataFrame:
    """Failed requests get the key's most recent earlier success, flagged stale."""
    line = log.select(
        "fetch_key", "request_id", micros(F.col("ts")).alias("at"), F.col("success").alias("ok")
    )
    line = with_chunk(line, F.col("at"), chunk_us)
    latest = running(
        line, ["fetch_key"], ["at", "request_id"], {"good": ("max", F.when(F.col("ok"), F.struct("at", "request_id")))}
    )
    stale = ~F.col("ok") & F.col("good").isNotNull()
    return latest.select(
        "fetch_key",
        "request_id",
        F.col("ok").alias("success"),
        F.when(~F.col("ok"), F.col("good.request_id")).alias("served_request"),
        stale.alias("stale"),
    )


def cache_purge(entries: DataFrame, purge: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Entries that no purge row (what, value) names by one of ``columns``; a NULL value names nothing."""
    rest = entries
    for column in columns:
        named = purge.where((F.col("what") == column) & F.col("value").isNotNull()).select(F.col("value").alias("_value")).distinct()
        rest = rest.join(named, F.col(column) == F.col("_value"), "left_anti")
    return rest


def replay_inputs(requests: DataFrame, key: Column) -> DataFrame:
    """A request log from prepared requests and their recorded status."""
    ttl = F.coalesce("cache_ttl", F.lit(DEFAULTS.cache_ttl))
    good = (F.col("status_code") >= 200) & (F.col("status_code") < 400)
    return requests.select(
        key.alias("fetch_key"),
        "request_id",
        "ts",
        ttl.cast("bigint").alias("ttl"),
        "force_refresh",
        good.alias("success"),
        "elapsed_ms",
        may_read(F.col("force_refresh"), ttl).alias("read"),
        may_write(good, ttl).alias("writes"),
    )
