"""Folding recorded attempts and responses."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import settings as S
from ..functions import headers as H
from ..functions import text as X
from ..functions import timing as T
from ..html.parse import has_match
from ..settings import DEFAULTS
from . import requests as R


def status_class(status: Column, location: Column | None = None) -> Column:
    """retryable, redirect (only with a target) or final."""
    target = F.lit(True) if location is None else F.coalesce(location, F.lit("")) != ""
    return (
        F.when(status.isin(*S.RETRYABLE_STATUS), "retryable")
        .when(status.isin(*S.REDIRECT_STATUS) & target, "redirect")
        .otherwise("final")
    )


def is_final(status: Column, error: Column | None = None) -> Column:
    """Does this attempt end the retries? Transport errors do not, other errors do."""
    done = ~status.isin(*S.RETRYABLE_STATUS)
    if error is None:
        return F.coalesce(done, F.lit(False))
    return F.when(error.isNotNull(), ~error.isin(*S.TRANSPORT_ERRORS)).otherwise(F.coalesce(done, F.lit(False)))


def retry_fold(attempts: DataFrame, max_attempts: int = DEFAULTS.max_attempts) -> DataFrame:
    """One row per request: the attempts that were needed, and how they ended.

    Attempts count up to the first final one, at most ``max_attempts``. Each sequence
    number has its own aggregate, so the fold is a plain ``groupBy`` with map-side
    combine and a bounded buffer, whatever the number of rows of one request.
    """
    has_error = "error_code" in attempts.columns
    error = F.col("error_code") if has_error else F.lit(None).cast("string")
    rows = attempts.where(F.col("sequence") <= max_attempts).select(
        "request_id",
        F.col("sequence").cast("int").alias("sequence"),
        is_final(F.col("status_code"), error if has_error else None).alias("_final"),
        F.struct(
            F.col("sequence").cast("int").alias("sequence"),
            F.lit("http").alias("strategy"),
            F.col("status_code").cast("int").alias("status_code"),
            error.alias("error_code"),
            F.col("elapsed_ms").cast("bigint").alias("elapsed_ms"),
            F.lit(None).cast("string").alias("upgrade_reason"),
        ).alias("_attempt"),
    )
    slots = [
        F.min(F.when(F.col("sequence") == number, F.col("_attempt"))).alias(f"_slot{number}")
        for number in range(1, max_attempts + 1)
    ]
    folded = rows.groupBy("request_id").agg(
        F.min(F.when(F.col("_final"), F.col("sequence"))).alias("_cut"), F.max("sequence").alias("_last"), *slots
    )
    kept = F.filter(
        F.array(*[F.col(f"_slot{number}") for number in range(1, max_attempts + 1)]),
        lambda slot: slot.isNotNull() & (slot["sequence"] <= F.coalesce("_cut", "_last")),
    )
    return (
        folded.select("request_id", kept.alias("attempts"))
        .withColumn("_end", F.element_at("attempts", -1))
        .select(
            "request_id",
            "attempts",
            F.size("attempts").alias("n_attempts"),
            F.col("_end.status_code").alias("final_status"),
            F.col("_end.error_code").alias("final_error"),
        )
    )


def attempts_kept(attempts: DataFrame, max_attempts: int = DEFAULTS.max_attempts) -> DataFrame:
    """The kept attempts as rows, in sequence order per request."""
    return retry_fold(attempts, max_attempts).select("request_id", F.explode("attempts").alias("_a")).select(
        "request_id", "_a.*"
    )


def attempts_union(http: DataFrame, browser: DataFrame) -> DataFrame:
    """Http attempts followed by the browser's; the last http one gets the reason.

    ``http``: request_id, attempts, upgrade_reason (NULL = no upgrade).
    ``browser``: request_id, status_code, error_code, elapsed_ms, one row per upgrade.
    """
    second = browser.select(
        "request_id",
        F.array(
            F.struct(
                F.lit(1).alias("sequence"),
                F.lit("browser").alias("strategy"),
                F.col("status_code").cast("int").alias("status_code"),
                F.col("error_code").cast("string").alias("error_code"),
                F.col("elapsed_ms").cast("bigint").alias("elapsed_ms"),
                F.lit(None).cast("string").alias("upgrade_reason"),
            )
        ).alias("_browser"),
    )
    stamped = F.transform(
        F.col("attempts"),
        lambda attempt, at: F.when(
            at == F.size("attempts") - 1, attempt.withField("upgrade_reason", F.col("upgrade_reason"))
        ).otherwise(attempt),
    )
    joined = http.join(second, "request_id", "left")
    return joined.select(
        "request_id",
        F.when(F.col("_browser").isNull(), F.col("attempts")).otherwise(F.concat(stamped, "_browser")).alias("attempts"),
    )


@F.pandas_udf(StringType())
def _selector_verdict(body: pd.Series, selector: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else has_match(b, s) for b, s in zip(body, selector)], dtype=object)


def selector_present(body: Column, selector: Column) -> Column:
    """present, missing, unparsable or unsupported; NULL without body or selector."""
    wanted = body.isNotNull() & selector.isNotNull()
    return _selector_verdict(F.when(wanted, body), F.when(wanted, selector))


def upgrade_reason(responses: DataFrame, min_chars: int = DEFAULTS.min_html_chars) -> DataFrame:
    """Add ``upgrade_reason``: why a browser should repeat this fetch, or NULL.

    ``responses``: status_code, content_type, body (text), required_selector. The
    cheap rules run in the JVM first; only bodies that reach the selector rule are
    sent to the parser.
    """
    kind = F.lower(F.coalesce("content_type", F.lit(S.DEFAULT_CONTENT_TYPE)))
    body = F.col("body")
    lowered = F.lower(body)
    marked = F.lit(False)
    for marker in S.CHALLENGE_MARKERS:
        marked = marked | lowered.contains(marker)
    cheap = (
        F.when(
            F.col("status_code").isin(*S.UPGRADE_STATUS), F.concat(F.lit("status_"), F.col("status_code").cast("string"))
        )
        .when(~kind.contains("html"), "-")
        .when(F.length(X.strip(body)) < min_chars, "html_too_short")
        .when(marked, "javascript_challenge")
    )
    staged = responses.withColumn("_cheap", cheap)
    open_rule = F.col("_cheap").isNull() & (F.coalesce("required_selector", F.lit("")) != "")
    verdict = selector_present(F.when(open_rule, body), F.when(open_rule, F.col("required_selector")))
    staged = staged.withColumn("_verdict", verdict)
    reason = (
        F.when(F.col("_cheap").isNotNull(), F.nullif(F.col("_cheap"), F.lit("-")))
        .when(F.col("_verdict") == "missing", "required_selector_missing")
        .when(F.col("_verdict") == "unparsable", "invalid_html")
    )
    # a selector that cannot be read says nothing about the page: an error, and no reason
    error = F.when(F.col("_verdict") == "unsupported", "selector_unsupported")
    return staged.withColumns({"upgrade_reason": reason, "error": error}).drop("_cheap", "_verdict")


def strategy_of(mode: Column, reason: Column) -> Column:
    """Only ``auto`` upgrades; http and browser are kept as asked."""
    return F.when((mode == "browser") | ((mode == "auto") & reason.isNotNull()), "browser").otherwise("http")


def response_project(outcomes: DataFrame) -> DataFrame:
    """Fetch outcomes as response rows.

    ``outcomes``: request_id, requested_url, final_url, status_code, strategy, elapsed_ms,
    content_type, body (text), artifact_id, fetched_at, attempts (array), hit, stale. A hit
    took no time and has no attempts of its own; the rest is what the cache kept. Where the
    bodies stay in a table of their own, ``body_md5`` stands in place of ``body``.
    """
    hit = F.col("hit")
    none = F.array().cast(outcomes.schema["attempts"].dataType)
    return outcomes.select(
        "request_id",
        R.success(F.col("status_code")).alias("success"),
        "requested_url",
        "final_url",
        "status_code",
        "strategy",
        hit.alias("from_cache"),
        F.coalesce("stale", F.lit(False)).alias("stale"),
        F.when(hit, F.lit(0).cast("bigint")).otherwise(F.col("elapsed_ms")).alias("elapsed_ms"),
        F.coalesce("content_type", F.lit(S.DEFAULT_CONTENT_TYPE)).alias("content_type"),
        *[name for name in ("body", "body_md5") if name in outcomes.columns],
        "artifact_id",
        "fetched_at",
        F.when(hit, none).otherwise(F.col("attempts")).alias("attempts"),
    )


def decode_response(body: Column, headers: Column) -> Column:
    return X.decode_body(body, X.header_charset(H.content_type(headers)))


def next_retry_at(ended: Column, attempt: Column, retry_after: Column) -> Column:
    """Earliest time of the next attempt."""
    return T.plus_seconds(ended, T.retry_delay(attempt, retry_after, ended))
