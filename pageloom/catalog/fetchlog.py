"""Retries, redirects, cache reuse, pacing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.timing import micros
from ..operators import cache as C
from ..operators import fetchlog as L
from ..operators import guard as G
from ..operators import politeness as P
from ..operators import redirects as D
from ..session import shared_root
from .book import DOMAIN, query

# ---------------------------------------------------------------------------
# retries and attempts
# ---------------------------------------------------------------------------
_CUT = """(SELECT request_id, coalesce(min(CASE WHEN status_code NOT IN (408, 425, 429, 500, 502, 503, 504) THEN sequence END), 3) AS cut
 FROM f_attempts GROUP BY request_id)"""


@query(
    "retry_fold",
    "f_attempts",
    sql=f"""SELECT a.request_id, c.cut AS n_attempts, a.status_code AS final_status FROM f_attempts a
JOIN {_CUT} c ON a.request_id = c.request_id AND a.sequence = c.cut""",
)
def retry_fold(spark, root):
    return L.retry_fold(spark.table("f_attempts")).select("request_id", "n_attempts", "final_status")


@query(
    "attempts_collect",
    "f_attempts",
    sql=f"""SELECT a.request_id, a.sequence, 'http' AS strategy, a.status_code, a.elapsed_ms FROM f_attempts a
JOIN {_CUT} c ON a.request_id = c.request_id AND a.sequence <= c.cut""",
)
def attempts_collect(spark, root):
    return L.attempts_kept(spark.table("f_attempts")).select(
        "request_id", "sequence", "strategy", "status_code", "elapsed_ms"
    )


@query(
    "attempts_union",
    "f_attempts",
    "f_requests",
    sql=f"""WITH kept AS (SELECT a.*, c.cut FROM f_attempts a JOIN {_CUT} c ON a.request_id = c.request_id AND a.sequence <= c.cut),
up AS (SELECT k.request_id, k.status_code FROM kept k JOIN f_requests r ON r.request_id = k.request_id
 WHERE k.sequence = k.cut AND k.status_code IN (403, 429, 503) AND r.mode = 'auto')
SELECT k.request_id, k.sequence AS place, 'http' AS strategy, k.status_code,
 CASE WHEN k.sequence = k.cut AND u.status_code IS NOT NULL THEN concat('status_', u.status_code) END AS upgrade_reason
FROM kept k LEFT JOIN up u ON k.request_id = u.request_id
UNION ALL SELECT u.request_id, c.cut + 1, 'browser', 200, NULL FROM up u JOIN {_CUT} c ON u.request_id = c.request_id""",
)
def attempts_union(spark, root):
    folded = L.retry_fold(spark.table("f_attempts"))
    modes = spark.table("f_requests").select("request_id", "mode")
    reason = F.when(
        (F.col("mode") == "auto") & F.col("final_status").isin(403, 429, 503),
        F.concat(F.lit("status_"), F.col("final_status").cast("string")),
    )
    http = folded.join(modes, "request_id").select("request_id", "attempts", reason.alias("upgrade_reason"))
    browser = http.where(F.col("upgrade_reason").isNotNull()).select(
        "request_id",
        F.lit(200).alias("status_code"),
        F.lit(None).cast("string").alias("error_code"),
        F.lit(0).alias("elapsed_ms"),
    )
    joined = L.attempts_union(http, browser)
    return joined.select("request_id", F.posexplode("attempts").alias("at", "a")).select(
        "request_id", (F.col("at") + 1).alias("place"), "a.strategy", "a.status_code", "a.upgrade_reason"
    )


# a response's page is the one with its request's page number; every third answer came from the cache
def _answers(body: str, pages: str) -> str:
    return f"""SELECT r.request_id, r.url AS requested_url, concat(r.url, CASE WHEN r.status_code = 301 THEN '?moved' ELSE '' END) AS final_url, r.status_code,
 CASE WHEN r.mode = 'browser' THEN 'browser' ELSE 'http' END AS strategy, r.elapsed_ms, r.request_id % 3 = 0 AS hit, r.request_id % 12 = 0 AS stale,
 CASE r.request_id % 4 WHEN 1 THEN 'text/html' WHEN 2 THEN 'application/json' END AS content_type, {body}, r.ts AS fetched_at,
 CASE WHEN r.save_artifact THEN concat('art_', md5(CAST(r.request_id AS VARCHAR(20)))) END AS artifact_id
FROM f_requests r JOIN {pages} p ON p.page_id = r.page_id"""


_ANSWERS = _answers("p.html AS body", "pages")


@query(
    "response_project",
    "f_requests",
    "f_attempts",
    sql=f"""WITH tries AS (SELECT a.request_id, string_agg(concat(a.sequence, ':', a.status_code), ',' ORDER BY a.sequence) AS tries
 FROM f_attempts a JOIN {_CUT} c ON a.request_id = c.request_id AND a.sequence <= c.cut GROUP BY a.request_id)
SELECT request_id, status_code BETWEEN 200 AND 399 AS success, requested_url, final_url, status_code, strategy, hit AS from_cache, stale,
 CASE WHEN hit THEN 0 ELSE elapsed_ms END AS elapsed_ms, coalesce(content_type, 'application/octet-stream') AS content_type, md5(body) AS body_md5,
 artifact_id, epoch_us(fetched_at) AS fetched_us, CASE WHEN hit THEN '' ELSE coalesce(tries, '') END AS attempts
FROM ({_ANSWERS}) LEFT JOIN tries USING (request_id)""",
)
def response_project(spark, root):
    tries = L.retry_fold(spark.table("f_attempts")).select("request_id", "attempts")
    # a page is the body of many responses: its digest is taken once, and no response carries the body through a join
    spark.table("pages").select("page_id", F.md5("html").alias("body_md5")).createOrReplaceTempView("f_bodies")
    outcomes = spark.sql(_answers("p.body_md5", "f_bodies")).join(tries, "request_id", "left")
    shown = F.transform("attempts", lambda a: F.concat_ws(":", a["sequence"].cast("string"), a["status_code"].cast("string")))
    return L.response_project(outcomes).select(
        "request_id", "success", "requested_url", "final_url", "status_code", "strategy", "from_cache", "stale", "elapsed_ms", "content_type",
        "body_md5", "artifact_id", micros(F.col("fetched_at")).alias("fetched_us"),
        F.coalesce(F.array_join(shown, ","), F.lit("")).alias("attempts"),
    )


# ---------------------------------------------------------------------------
# redirects
# ---------------------------------------------------------------------------
_WALK = """WITH walk(start, node, depth, path, code) AS (
 SELECT src, src, 0, [src], {first} FROM f_redirects
 UNION ALL
 SELECT w.start, h.dst, w.depth + 1, list_append(w.path, h.dst), CASE {guard} WHEN w.depth + 1 > 10 THEN 'TOO_MANY_REDIRECTS'
  WHEN list_contains(w.path, h.dst) THEN 'REDIRECT_LOOP' WHEN h.dst NOT IN (SELECT src FROM f_redirects) THEN 'NOT_RECORDED' END
 FROM walk w JOIN f_redirects h ON h.src = w.node WHERE w.code IS NULL AND h.dst IS NOT NULL)
SELECT start AS src, CASE WHEN code IS NULL THEN node END AS final,
 CAST(CASE WHEN code IN ('REDIRECT_LOOP', 'TOO_MANY_REDIRECTS') THEN depth - 1 ELSE depth END AS INTEGER) AS hops, code
FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY depth DESC) AS rn FROM walk) WHERE rn = 1"""


def _numbers(chains):
    """The page numbers of the URLs."""
    number = lambda c: F.nullif(F.regexp_extract(c, "p([0-9]+)$", 1), F.lit("")).cast("bigint")
    return chains.select(number("src").alias("src"), number("final").alias("final"), "hops", "code")


@query(
    "redirect_resolve",
    "f_hops",
    sql=_WALK.format(first="CAST(NULL AS VARCHAR)", guard=""),
    recursive=True,
    oracle_views=("f_redirects",),
)
def redirect_resolve(spark, root):
    return _numbers(D.redirect_resolve(D.hops_of(spark.table("f_hops"))))


# the guard's word on a page: the block list, then its recorded addresses
_JUDGED = """v AS (SELECT page, CASE WHEN page % 23 = 7 THEN 'DOMAIN_NOT_ALLOWED' WHEN count(address) = 0 THEN 'DNS_FAILED'
  WHEN bool_or(address IN ('10.0.0.1', '127.0.0.1', '::1')) THEN 'DOMAIN_NOT_ALLOWED' END AS code
 FROM (SELECT src AS page FROM f_redirects UNION SELECT dst FROM f_redirects WHERE dst IS NOT NULL) LEFT JOIN f_hop_addresses ON page_id = page GROUP BY page)"""


@query(
    "redirect_guard",
    "f_hops",
    "f_hop_addresses",
    sql=f"""WITH {_JUDGED}, walk(start, node, depth, path, code) AS (
 SELECT src, src, 0, [src], v.code FROM f_redirects JOIN v ON v.page = src
 UNION ALL
 SELECT w.start, h.dst, w.depth + 1, list_append(w.path, h.dst), CASE WHEN w.depth + 1 > 10 THEN 'TOO_MANY_REDIRECTS'
  WHEN list_contains(w.path, h.dst) THEN 'REDIRECT_LOOP' WHEN v.code IS NOT NULL THEN v.code WHEN h.dst NOT IN (SELECT src FROM f_redirects) THEN 'NOT_RECORDED' END
 FROM walk w JOIN f_redirects h ON h.src = w.node JOIN v ON v.page = h.dst WHERE w.code IS NULL AND h.dst IS NOT NULL)
SELECT start AS src, CASE WHEN code IS NULL THEN node END AS final,
 CAST(CASE WHEN code IN ('REDIRECT_LOOP', 'TOO_MANY_REDIRECTS') THEN depth - 1 ELSE depth END AS INTEGER) AS hops, code
FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY depth DESC) AS rn FROM walk) WHERE rn = 1""",
    recursive=True,
    oracle_views=("f_redirects", "f_hop_addresses"),
)
def redirect_guard(spark, root):
    """Each requested URL passes the guard first: block list and recorded addresses."""
    shared_root(spark)
    hops = D.hops_of(spark.table("f_hops")).checkpoint()
    pages = hops.select("src").union(hops.select("dst")).where("src is not null").distinct()
    number = F.regexp_extract("src", "p([0-9]+)$", 1).cast("bigint")
    resolved = pages.select("src", number.alias("page_id")).join(spark.table("f_hop_addresses"), "page_id").select("src", "address")
    verdicts = G.guard_urls(pages.withColumn("url", F.col("src")), resolved, "src", ["blocked0.example.org"])
    return _numbers(D.redirect_resolve(hops, verdicts=verdicts.select("src", "code")))


# ---------------------------------------------------------------------------
# cache
# ---------------------------------------------------------------------------
_LOG_KEY = "concat_ws('|', url, mode, profile, proxy_policy, coalesce(CAST(save_artifact AS VARCHAR), 'null'))"
_LOG = f"""log AS MATERIALIZED (SELECT {_LOG_KEY} AS fetch_key, request_id, epoch_us(ts) AS t_us, CAST(coalesce(cache_ttl, 3600) AS BIGINT) * 1000000 AS ttl,
 force_refresh, status_code BETWEEN 200 AND 399 AS ok, row_number() OVER (PARTITION BY {_LOG_KEY} ORDER BY ts, request_id) AS rn FROM f_requests)"""
# the newest recorded entry strictly before each row of a key
_REUSE = f"""{_LOG}, reuse AS (SELECT *, last_value(CASE WHEN ok AND ttl > 0 THEN t_us + ttl END IGNORE NULLS) OVER
 (PARTITION BY fetch_key ORDER BY t_us, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS expires FROM log),
replay AS (SELECT *, CASE WHEN NOT force_refresh AND ttl > 0 AND coalesce(expires > t_us, FALSE) THEN 'hit' ELSE 'miss' END AS outcome FROM reuse)"""


def request_log(spark):
    key = F.concat_ws(
        "|", "url", "mode", "profile", "proxy_policy", F.coalesce(F.col("save_artifact").cast("string"), F.lit("null"))
    )
    return C.replay_inputs(spark.table("f_requests"), key)


@query(
    "cache_replay",
    "f_requests",
    sql=f"WITH {_REUSE} SELECT fetch_key, request_id, outcome FROM replay",
)
def cache_replay(spark, root):
    return C.cache_replay(request_log(spark)).select("fetch_key", "request_id", "outcome")


@query(
    "cache_lookup",
    "f_requests",
    sql="""WITH e AS (SELECT page_id, request_id AS entry_id, epoch_us(ts) + elapsed_ms * 1000 AS set_at,
  epoch_us(ts) + elapsed_ms * 1000 + CAST(coalesce(cache_ttl, 3600) AS BIGINT) * 1000000 AS expires_at FROM f_requests
  WHERE status_code BETWEEN 200 AND 399 AND coalesce(cache_ttl, 3600) > 0),
r AS (SELECT page_id, request_id, epoch_us(ts) AS t_us FROM f_requests)
SELECT r.request_id, r.page_id AS fetch_key, CASE WHEN e.expires_at > r.t_us THEN e.entry_id END AS entry_id,
 coalesce(e.expires_at > r.t_us, FALSE) AS hit
FROM r ASOF LEFT JOIN e ON r.page_id = e.page_id AND r.t_us >= e.set_at""",
)
def cache_lookup(spark, root):
    log = spark.table("f_requests").withColumn("fetch_key", F.col("page_id"))
    ttl = F.coalesce("cache_ttl", F.lit(3600)).cast("bigint")
    good = F.col("status_code").between(200, 399)
    set_us = micros(F.col("ts")) + F.col("elapsed_ms") * 1000
    entries = log.where(good & (ttl > 0)).select(
        F.col("request_id").alias("entry_id"),
        "fetch_key",
        F.timestamp_micros(set_us).alias("set_at"),
        F.timestamp_micros(set_us + ttl * 1_000_000).alias("expires_at"),
    )
    return C.cache_lookup(log, entries)


def long_flights(spark):
    """Flights are stretched to hours, so that many requests meet one in flight."""
    return request_log(spark).withColumn("elapsed_ms", F.col("elapsed_ms") * 200_000)


@query(
    "inflight_merge",
    "f_requests",
    sql=f"""WITH l AS (SELECT {_LOG_KEY} AS fetch_key, request_id, epoch_us(ts) AS t_us, elapsed_ms * 200000000 AS e FROM f_requests),
b AS (SELECT *, max(t_us + e) OVER (PARTITION BY fetch_key ORDER BY t_us, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS busy_until FROM l)
SELECT fetch_key, request_id, busy_until, coalesce(busy_until > t_us, FALSE) AS overlaps FROM b""",
)
def inflight_merge(spark, root):
    return C.inflight_merge(long_flights(spark)).select("fetch_key", "request_id", "busy_until", "overlaps")


@query("negative_cache", "f_requests", sql=f"""WITH {_LOG}, reuse AS (SELECT *, last_value(CASE WHEN ttl > 0 THEN
  {{'x': t_us + CASE WHEN ok THEN ttl ELSE least(ttl, 86400000000) END, 'ok': ok}} END IGNORE NULLS) OVER
 (PARTITION BY fetch_key ORDER BY t_us, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS entry FROM log)
SELECT fetch_key, request_id, CASE WHEN NOT force_refresh AND ttl > 0 AND coalesce(entry.x > t_us, FALSE)
 THEN CASE WHEN entry.ok THEN 'hit' ELSE 'negative_hit' END ELSE 'miss' END AS outcome FROM reuse""")
def negative_cache(spark, root):
    return C.negative_cache(request_log(spark), negative_ttl=86_400).select("fetch_key", "request_id", "outcome")


@query(
    "lru_resident",
    "f_requests",
    sql=f"""WITH {_LOG}, k AS (SELECT fetch_key, max([t_us, request_id]) AS used FROM log GROUP BY fetch_key)
SELECT fetch_key, used[1] AS last_used_at, used[2] AS last_request FROM k ORDER BY used DESC LIMIT 1024""",
)
def lru_resident(spark, root):
    return C.lru_resident(request_log(spark))


@query(
    "stale_if_error",
    "f_requests",
    sql="""SELECT fetch_key, request_id, ok AS success, CASE WHEN NOT ok THEN good END AS served_request, NOT ok AND good IS NOT NULL AS stale
FROM (SELECT page_id AS fetch_key, request_id, ok, last_value(CASE WHEN ok THEN request_id END IGNORE NULLS) OVER
 (PARTITION BY page_id ORDER BY ts, request_id ROWS UNBOUNDED PRECEDING) AS good
 FROM (SELECT *, status_code BETWEEN 200 AND 399 AS ok FROM f_requests))""",
)
def stale_if_error(spark, root):
    log = spark.table("f_requests").select(
        F.col("page_id").alias("fetch_key"), "request_id", "ts", F.col("status_code").between(200, 399).alias("success")
    )
    return C.stale_if_error(log)


@query(
    "cache_purge",
    "f_requests",
    sql=f"""SELECT request_id FROM f_requests WHERE profile <> 'member' AND {DOMAIN} NOT IN (SELECT {DOMAIN} FROM pages WHERE url LIKE '%.html')
AND url NOT IN (SELECT url FROM pages WHERE url LIKE '%#top')""",
)
def cache_purge(spark, root):
    entries = spark.table("f_requests").select("request_id", "url", "profile", U.domain_of(F.col("url")).alias("domain"))
    pages = spark.table("pages").select("page_id", "url", U.domain_of(F.col("url")).alias("domain"))
    purge = (
        pages.where(F.col("url").endswith(".html"))
        .select(F.lit("domain").alias("what"), F.col("domain").alias("value"))
        .unionByName(pages.where(F.col("url").endswith("#top")).select(F.lit("url").alias("what"), F.col("url").alias("value")))
        .unionByName(spark.createDataFrame([("profile", "member")], "what string, value string"))
    )
    return C.cache_purge(entries, purge, ("url", "domain", "profile")).select("request_id")


# ---------------------------------------------------------------------------
# pacing
# ---------------------------------------------------------------------------
# an interval of ten minutes is often missed in the sparse test log
_INTERVAL = 600_000_000
_GAPS = f"""WITH a AS (SELECT request_id, {DOMAIN} AS domain, epoch_us(ts) AS arrival_us, epoch_us(ts) - lag(epoch_us(ts)) OVER
 (PARTITION BY {DOMAIN} ORDER BY ts, request_id) AS gap_us FROM f_requests)
SELECT request_id, domain, arrival_us, gap_us, CAST(coalesce(greatest({_INTERVAL} - gap_us, 0), 0) AS BIGINT) AS short_us FROM a"""


def domain_log(spark):
    return spark.table("f_requests").withColumn("domain", U.domain_of(F.col("url")))


@query("rate_slots", "f_requests", sql=_GAPS)
def rate_slots(spark, root):
    return P.rate_slots(domain_log(spark), interval_us=_INTERVAL)


@query(
    "domain_concurrency",
    "f_requests",
    sql=f"""WITH f AS (SELECT request_id, {DOMAIN} AS domain, epoch_us(ts) AS s, epoch_us(ts) + elapsed_ms * 20000000 AS e FROM f_requests),
m AS (SELECT domain, s AS t_us, 1 AS step, request_id FROM f UNION ALL SELECT domain, e, -1, request_id FROM f),
l AS (SELECT *, sum(step) OVER (PARTITION BY domain ORDER BY t_us, step, request_id ROWS UNBOUNDED PRECEDING) AS n FROM m)
SELECT domain, CAST(max(n) AS BIGINT) AS peak, count(*) FILTER (step = 1) AS requests, count(*) FILTER (step = 1 AND n > 4) AS above_limit
FROM l GROUP BY domain""",
)
def domain_concurrency(spark, root):
    start = micros(F.col("ts"))
    flights = domain_log(spark).select(
        "domain", start.alias("start_us"), (start + F.col("elapsed_ms") * 20_000_000).alias("end_us")
    )
    return P.domain_concurrency(flights)


_RUNS = f"""WITH a AS (SELECT {DOMAIN} AS domain, epoch_us(ts) AS t_us, request_id,
  CASE WHEN status_code IN (403, 429, 503) THEN TRUE WHEN status_code = 404 THEN NULL ELSE FALSE END AS failed FROM f_requests),
b AS (SELECT *, count(*) FILTER (NOT failed) OVER (PARTITION BY domain ORDER BY t_us, request_id ROWS UNBOUNDED PRECEDING) AS good FROM a)
SELECT domain, min(t_us) AS start_us, max(t_us) AS end_us, count(*) AS failures FROM b WHERE failed GROUP BY domain, good HAVING count(*) >= 2"""


def judged_log(spark):
    failed = F.when(F.col("status_code").isin(403, 429, 503), True).when(F.col("status_code") != 404, False)
    return domain_log(spark).withColumn("failed", failed)


@query("circuit_breaker", "f_requests", sql=_RUNS)
def circuit_breaker(spark, root):
    return P.circuit_breaker(judged_log(spark), failures=2).select("domain", "start_us", "end_us", "failures")


@query(
    "cache_hit_rate",
    "f_requests",
    sql=f"""WITH {_REUSE} SELECT count(*) AS lookups, count(*) FILTER (outcome = 'hit') AS hits,
 round(avg(CASE WHEN outcome = 'hit' THEN 1.0 ELSE 0.0 END), 9) AS hit_rate FROM replay WHERE NOT force_refresh AND ttl > 0""",
)
def cache_hit_rate(spark, root):
    from ..operators import metrics as M

    return M.cache_hit_rate(C.cache_replay(request_log(spark)))
