"""Preparing fetch requests: validation, defaults, routing, keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import settings as S
from ..functions import headers as H
from ..functions import urls as U
from ..settings import DEFAULTS
from .domains import longest_rule
from .guard import guard_syntax


def _bad(condition: Column) -> Column:
    """A rule that is broken only by a value, never by NULL."""
    return F.coalesce(condition, F.lit(False))


def broken_rule(columns: list[str]) -> Column:
    """Name of the first field whose value breaks its rule, or NULL."""
    rules = {
        "url": F.col("url").isNull() | ~F.col("url").rlike(r"(?i)^https?://[^/?#]+"),
        "mode": _bad(~F.col("mode").isin(*S.MODES)) if "mode" in columns else None,
        "profile": _bad(~F.col("profile").rlike(S.PROFILE_PATTERN) | (F.length("profile") > 100))
        if "profile" in columns
        else None,
        "proxy_policy": _bad(~F.col("proxy_policy").isin(*S.PROXY_POLICIES)) if "proxy_policy" in columns else None,
        "cache_ttl": _bad(~F.col("cache_ttl").between(0, S.MAX_CACHE_TTL)) if "cache_ttl" in columns else None,
        "timeout_seconds": _bad((F.col("timeout_seconds") <= 0) | (F.col("timeout_seconds") > 300))
        if "timeout_seconds" in columns
        else None,
        "required_selector": _bad(F.length("required_selector") > 500) if "required_selector" in columns else None,
    }
    chain: Column | None = None
    for field, broken in rules.items():
        if broken is not None:
            chain = F.when(broken, field) if chain is None else chain.when(broken, field)
    return chain


def request_validate(requests: DataFrame) -> DataFrame:
    """Add ``broken_field`` and ``error``; both are NULL for valid requests."""
    field = broken_rule(requests.columns)
    return requests.withColumn("broken_field", field).withColumn(
        "error", F.when(F.col("broken_field").isNotNull(), "INVALID_REQUEST")
    )


def batch_validate(requests: DataFrame) -> DataFrame:
    """Per job: request count, and an error when size or priority is out of rule."""
    sizes = requests.groupBy("job_id").agg(
        F.count("*").alias("n_requests"), F.min("priority").alias("first"), F.max("priority").alias("last")
    )
    known = F.col("first").isin(*S.PRIORITIES) & F.col("last").isin(*S.PRIORITIES)
    wrong = ~F.col("n_requests").between(1, S.MAX_BATCH) | ~F.coalesce(known, F.lit(True))
    return sizes.select("job_id", "n_requests", F.when(wrong, "INVALID_REQUEST").alias("error"))


def request_defaults(requests: DataFrame) -> DataFrame:
    """Fill missing fields; ``save_artifact`` keeps its NULL."""
    values = {"mode": "auto", "profile": "anonymous", "proxy_policy": "auto", "force_refresh": False}
    return requests.fillna({name: value for name, value in values.items() if name in requests.columns})


def queue_of(mode: Column) -> Column:
    """Only plain HTTP items go to the http queue; auto items need a browser worker."""
    return F.when(mode == "http", "http").otherwise("browser")


def use_proxy(policy: Column, default_policy: str = "direct", proxy_known: bool = True) -> Column:
    by_default = F.lit(default_policy == "proxy")
    return ((policy == "proxy") | ((policy == "auto") & by_default)) & F.lit(proxy_known)


def ttl_of(cache_ttl: Column, default: int = DEFAULTS.cache_ttl) -> Column:
    return F.coalesce(cache_ttl, F.lit(default))


def may_read(force_refresh: Column, ttl: Column) -> Column:
    return ~force_refresh & (ttl > 0)


def may_write(success: Column, ttl: Column) -> Column:
    return success & (ttl > 0)


def ttl_resolve(requests: DataFrame) -> DataFrame:
    ttl = ttl_of(F.col("cache_ttl"))
    return requests.withColumns(
        {
            "ttl": ttl,
            "readable": may_read(F.col("force_refresh"), ttl),
            "writable": may_write(success(F.col("status_code")), ttl),
        }
    )


def success(status: Column) -> Column:
    return (status >= 200) & (status < 400)


def save_resolve(save_artifact: Column, default: bool = True) -> Column:
    return F.coalesce(save_artifact, F.lit(default))


def body_size_check(body: Column, limit: int = DEFAULTS.max_body_bytes) -> Column:
    return F.when(F.octet_length(body) > limit, "RESPONSE_TOO_LARGE")


def extract_xor(url: Column, artifact_id: Column) -> Column:
    """Exactly one of both must be given; an empty text counts as absent."""
    given = [F.coalesce(value, F.lit("")) != "" for value in (url, artifact_id)]
    return F.when(given[0] == given[1], "INVALID_REQUEST")


def artifact_id_valid(artifact_id: Column) -> Column:
    return artifact_id.rlike(r"^art_[0-9a-f]{32}\z")


def header_check(requests: DataFrame) -> DataFrame:
    """``forbidden`` header name and the error it causes."""
    return requests.withColumn("forbidden", H.forbidden_header(F.col("headers"))).withColumn(
        "error", F.when(F.col("forbidden").isNotNull(), "INVALID_REQUEST")
    )


def fetch_keys(requests: DataFrame, normalized: bool = False) -> DataFrame:
    """Add ``fetch_key`` over the URL in its canonical form; with ``normalized`` fragments do not matter either."""
    url = U.url_normalize(F.col("url")) if normalized else U.url_canonical(F.col("url"))
    headers = F.col("headers") if "headers" in requests.columns else None
    key = H.fetch_key(
        url, F.col("mode"), F.col("profile"), F.col("proxy_policy"), F.col("save_artifact"), headers
    )
    return requests.withColumn("fetch_key", key)


def prepare(requests: DataFrame, blocked_hosts: list[str] | None = None) -> DataFrame:
    """Defaults, checks, guard syntax, key and ttl in one projection (no shuffle)."""
    checked = guard_syntax(request_validate(request_defaults(requests)), blocked_hosts)
    if "headers" in requests.columns:
        broken_header = F.when(H.forbidden_header(F.col("headers")).isNotNull(), "INVALID_REQUEST")
        checked = checked.withColumn("error", F.coalesce("error", broken_header))
    checked = checked.withColumn("error", F.coalesce("error", "code"))
    return fetch_keys(checked).withColumn("ttl", ttl_of(F.col("cache_ttl")))


def domain_policy_apply(requests: DataFrame, policies: DataFrame) -> DataFrame:
    """A domain's forced strategy, proxy and limits override the request's own.

    ``policies``: domain, mode, proxy_policy, max_attempts, interval_us (NULL = no rule). A
    policy holds for its domain and everything below it; of nested ones the longest domain's holds, alone.
    """
    rules = policies.select("domain", "mode", "proxy_policy", "max_attempts", "interval_us")
    joined = longest_rule(requests.withColumn("domain", U.domain_of(F.col("url"))), rules, "domain")
    return joined.withColumns(
        {
            "mode": F.coalesce("rule.mode", "mode"),
            "proxy_policy": F.coalesce("rule.proxy_policy", "proxy_policy"),
            "max_attempts": F.coalesce("rule.max_attempts", F.lit(DEFAULTS.max_attempts)),
            "interval_us": F.coalesce("rule.interval_us", F.lit(DEFAULTS.domain_interval_us)),
        }
    ).drop("rule")


def client_quota(requests: DataFrame, quota: int) -> DataFrame:
    """Requests per client and minute, and whether they pass the quota."""
    minute = F.date_trunc("minute", F.col("ts")).cast("timestamp_ntz")
    counted = requests.groupBy("client_id", minute.alias("minute")).agg(F.count("*").alias("n"))
    return counted.withColumn("over_quota", F.col("n") > quota)
