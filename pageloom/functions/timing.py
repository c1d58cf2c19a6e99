"""Delays, leases, ids and time formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..settings import DEFAULTS

_NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
_HTTP_DATE = r"^\s*(?:[A-Za-z]{3},\s*)?(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}) (GMT|UTC|UT|[+-]\d{4})\s*$"


def micros(ts: Column) -> Column:
    """Microseconds since the epoch, as BIGINT (session time zone UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def backoff_delay(attempt: Column, base: float = DEFAULTS.retry_base_seconds, jitter: bool = False) -> Column:
    """``base * 2^(attempt-1)`` seconds, optionally plus up to 0.1 s."""
    delay = F.lit(base) * F.pow(F.lit(2.0), attempt - 1)
    return delay + F.rand() * 0.1 if jitter else delay


def retry_delay(attempt: Column, retry_after: Column, now: Column, jitter: bool = False) -> Column:
    """Seconds to wait: a Retry-After number or date wins over the backoff."""
    cap = F.lit(DEFAULTS.retry_cap_seconds)
    zone = F.regexp_extract(retry_after, _HTTP_DATE, 2)
    offset = F.when(zone.isin("GMT", "UTC", "UT"), "+0000").otherwise(F.nullif(zone, F.lit("-0000")))
    when = F.try_to_timestamp(
        F.concat_ws(" ", F.regexp_extract(retry_after, _HTTP_DATE, 1), offset), F.lit("d MMM yyyy HH:mm:ss xx")
    )
    dated = (F.unix_micros(when) - micros(now)) / 1e6
    return (
        F.when(retry_after.rlike(_NUMBER), F.least(F.trim(retry_after).try_cast("double"), cap))
        .when(
            retry_after.rlike(_HTTP_DATE) & offset.isNotNull() & when.isNotNull(),
            F.greatest(F.lit(0.0), F.least(dated, cap)),
        )
        .otherwise(backoff_delay(attempt, jitter=jitter))
    )


def item_backoff(attempts: Column, retry_after_seconds: Column) -> Column:
    """Requeue delay in seconds; zero counts as not given."""
    return F.coalesce(F.nullif(retry_after_seconds.cast("double"), F.lit(0.0)), F.pow(F.lit(2.0), attempts))


def plus_seconds(ts: Column, seconds: Column) -> Column:
    return ts + F.make_dt_interval(secs=seconds)


def lease_until(now: Column, lease_seconds: int = DEFAULTS.lease_seconds) -> Column:
    return plus_seconds(now, F.lit(lease_seconds))


def iso_time(ts: Column) -> Column:
    """UTC time as ISO-8601; the fraction is left out when it is zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(ts, ".SSSSSS")
    return F.concat(whole, F.when(fraction == ".000000", "").otherwise(fraction), F.lit("+00:00"))


def parse_iso(text: Column) -> Column:
    return F.to_timestamp(text)


def date_path(ts: Column) -> Column:
    return F.date_format(ts, "yyyy/MM/dd")


def elapsed_ms(started: Column, ended: Column) -> Column:
    """Whole milliseconds between two times in seconds, cut towards zero."""
    return ((ended - started) * 1000).cast("bigint")


def new_id(prefix: str) -> Column:
    return F.concat(F.lit(prefix + "_"), F.replace(F.uuid(), F.lit("-"), F.lit("")))


def stable_id(prefix: str, *parts: Column) -> Column:
    """Repeatable id: a lost executor recomputes the same value."""
    text = F.concat_ws("\u0001", *[part.cast("string") for part in parts])
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(text, 256), 1, 32))


def api_key_digest(key: Column) -> Column:
    return F.sha2(key, 256)


def request_id_or(given: Column, fallback: Column) -> Column:
    return F.substring(F.coalesce(F.nullif(given, F.lit("")), fallback), 1, 128)
