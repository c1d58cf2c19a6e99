"""Request preparation, URL and address rules, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import addresses as A
from ..functions import headers as H
from ..functions import text as X
from ..functions import timing as T
from ..functions import urls as U
from ..operators import domains as N
from ..operators import extract as E
from ..operators import fetchlog as L
from ..operators import guard as G
from ..operators import requests as R
from ..session import scratch_path
from ..sources import tables
from .book import DOMAIN, query

BLOCKED = [f"blocked{number}.example.org" for number in range(2)]


@query("page_scan", sql="SELECT page_id, url, CAST(length(html) AS INTEGER) AS n_chars FROM pages")
def page_scan(spark, root):
    return tables.page_scan(spark, root, "page_id", "url", F.length("html").alias("n_chars"))


_PAYLOAD = """
SELECT request_id, concat('{"url":"', url, '"', CASE WHEN request_id % 3 = 0 THEN '' ELSE concat(',"mode":"', mode, '"') END,
 CASE WHEN request_id % 4 = 0 THEN '' ELSE concat(',"cache_ttl":', request_id % 900) END, ',"extra":[1,{"a":2}],"headers":{"Accept":"*/*"}',
 CASE WHEN save_artifact IS NULL THEN '' ELSE concat(',"save_artifact":', CAST(save_artifact AS VARCHAR(5))) END, '}') AS payload
FROM f_requests"""


@query(
    "payload_parse",
    "f_requests",
    sql=f"""WITH p AS ({_PAYLOAD})
SELECT request_id, payload->>'$.url' AS url, coalesce(payload->>'$.mode', 'auto') AS mode, 'anonymous' AS profile,
 'auto' AS proxy_policy, CAST(payload->>'$.cache_ttl' AS BIGINT) AS cache_ttl, FALSE AS force_refresh,
 CAST(payload->>'$.save_artifact' AS BOOLEAN) AS save_artifact, '*/*' AS accept FROM p""",
)
def payload_parse(spark, root):
    parsed = spark.sql(_PAYLOAD).withColumn("r", tables.parse_payload(F.col("payload")))
    fields = ["url", "mode", "profile", "proxy_policy", "cache_ttl", "force_refresh", "save_artifact"]
    return parsed.select(
        "request_id", *[F.col(f"r.{name}").alias(name) for name in fields], F.col("r.headers")["Accept"].alias("accept")
    )


@query(
    "payload_variant",
    "f_requests",
    sql=f"""WITH p AS (SELECT request_id, CASE request_id % 10 WHEN 4 THEN '{{"url":' WHEN 7 THEN '[1]' ELSE payload END AS payload, request_id % 10 IN (4, 7) AS bad FROM ({_PAYLOAD}))
SELECT request_id, CASE WHEN NOT bad THEN json_extract_string(payload, '$.url') END AS url,
 CASE WHEN NOT bad THEN coalesce(json_extract_string(payload, '$.mode'), 'auto') END AS mode,
 CASE WHEN NOT bad THEN CAST(json_extract_string(payload, '$.cache_ttl') AS BIGINT) END AS cache_ttl,
 CASE WHEN NOT bad THEN 2 END AS extra, CASE WHEN NOT bad THEN '[1,{{"a":2}}]' END AS extra_text, CASE WHEN bad THEN payload END AS unread
FROM (SELECT request_id, bad, payload FROM p WHERE NOT bad UNION ALL SELECT request_id, bad, payload FROM p WHERE bad)""",
)
def payload_variant(spark, root):
    """Documents are stored as VARIANT and read back: what no field names is still in them, and unreadable text is kept."""
    number = F.col("request_id") % 10
    sent = F.when(number == 4, '{"url":').when(number == 7, "[1]").otherwise(F.col("payload"))
    path = scratch_path(spark, "payloads")
    spark.sql(_PAYLOAD).select("request_id", tables.payload_variant(sent).alias("p")).select("request_id", "p.*").write.parquet(path)
    stored = spark.read.parquet(path)
    again = F.parse_json(tables.serialize_document(F.col("document")))
    return stored.select(
        "request_id", "request.url", "request.mode", "request.cache_ttl", F.variant_get(again, "$.extra[1].a", "int").alias("extra"),
        F.to_json(F.variant_get(again, "$.extra", "variant")).alias("extra_text"), "unread",
    )


@query(
    "payload_serialize",
    "f_requests",
    sql="""SELECT request_id, concat('{"request_id":', request_id, ',"mode":"', mode, '","cache_ttl":',
 coalesce(CAST(cache_ttl AS VARCHAR), 'null'), ',"force_refresh":', CAST(force_refresh AS VARCHAR), ',"save_artifact":',
 coalesce(CAST(save_artifact AS VARCHAR), 'null'), '}') AS payload FROM f_requests""",
)
def payload_serialize(spark, root):
    row = F.struct("request_id", "mode", "cache_ttl", "force_refresh", "save_artifact")
    return spark.table("f_requests").select("request_id", tables.serialize(row).alias("payload"))


@query(
    "request_validate",
    "f_raw_requests",
    sql="""SELECT request_id, broken_field, CASE WHEN broken_field IS NOT NULL THEN 'INVALID_REQUEST' END AS error FROM (
 SELECT request_id, CASE WHEN url IS NULL OR NOT regexp_matches(url, '^(?i)https?://[^/?#]+') THEN 'url'
  WHEN mode NOT IN ('auto', 'http', 'browser') THEN 'mode' WHEN NOT regexp_full_match(profile, '[a-zA-Z0-9_.-]{1,100}') THEN 'profile'
  WHEN proxy_policy NOT IN ('auto', 'direct', 'proxy') THEN 'proxy_policy' WHEN cache_ttl < 0 OR cache_ttl > 2592000 THEN 'cache_ttl'
  WHEN timeout_seconds <= 0 OR timeout_seconds > 300 THEN 'timeout_seconds' WHEN length(required_selector) > 500 THEN 'required_selector'
  END AS broken_field FROM f_raw_requests)""",
)
def request_validate(spark, root):
    return R.request_validate(spark.table("f_raw_requests")).select("request_id", "broken_field", "error")


@query(
    "batch_validate",
    "f_job_items",
    sql="""SELECT job_id, count(*) AS n_requests, CASE WHEN count(*) NOT BETWEEN 1 AND 1000 OR
  bool_or(p NOT IN ('low', 'normal', 'high')) THEN 'INVALID_REQUEST' END AS error
FROM (SELECT job_id - job_id % 70000 AS job_id, CASE WHEN job_id % 70000 = 10 AND job_id > 70000 THEN 'urgent' ELSE 'normal' END AS p
  FROM f_job_items WHERE job_id >= 0) GROUP BY job_id""",
)
def batch_validate(spark, root):
    items = spark.table("f_job_items").select(
        (F.col("job_id") - F.col("job_id") % 70000).alias("job_id"),
        F.when((F.col("job_id") % 70000 == 10) & (F.col("job_id") > 70000), "urgent").otherwise("normal").alias("priority"),
    )
    return R.batch_validate(items)


@query(
    "request_defaults",
    "f_raw_requests",
    sql="""SELECT request_id, coalesce(mode, 'auto') AS mode, coalesce(profile, 'anonymous') AS profile,
 coalesce(proxy_policy, 'auto') AS proxy_policy, coalesce(force_refresh, FALSE) AS force_refresh, save_artifact FROM f_raw_requests""",
)
def request_defaults(spark, root):
    return R.request_defaults(spark.table("f_raw_requests")).select(
        "request_id", "mode", "profile", "proxy_policy", "force_refresh", "save_artifact"
    )


@query(
    "url_guard_syntax",
    "f_urls",
    sql="""SELECT page_id, code, CASE WHEN code IS NULL THEN host END AS host, CASE WHEN code IS NULL THEN port END AS port FROM (
 SELECT page_id, host, CAST(CASE WHEN p <> '' THEN p WHEN lower(url) LIKE 'https:%' THEN '443' ELSE '80' END AS INTEGER) AS port,
  CASE WHEN NOT regexp_matches(lower(url), '^https?:') OR host = '' OR url LIKE '%@%' THEN 'INVALID_REQUEST'
   WHEN host IN ('blocked0.example.org', 'blocked1.example.org') THEN 'DOMAIN_NOT_ALLOWED' END AS code
 FROM (SELECT page_id, url, rtrim(lower(regexp_extract(url, '^[a-zA-Z]+://(?:[^/@]*@)?([^/:?#]*)', 1)), '.') AS host,
  regexp_extract(url, '^[a-zA-Z]+://[^/:?#]*:([0-9]+)', 1) AS p FROM f_urls))""",
)
def url_guard_syntax(spark, root):
    return G.guard_syntax(spark.table("f_urls"), BLOCKED).select("page_id", "code", "host", "port")


@query(
    "url_normalize",
    "f_urls",
    sql="""SELECT page_id, CASE page_id % 8 WHEN 3 THEN concat('https://h', page_id, '.example.org/A?b=C')
  WHEN 4 THEN concat('http://h', page_id, '.example.org:8080/') ELSE regexp_replace(url, '#.*$', '') END AS normalized
FROM f_urls WHERE page_id % 8 IN (0, 3, 4, 5, 6)""",
)
def url_normalize(spark, root):
    guarded = G.guard_syntax(spark.table("f_urls"))
    return guarded.where(F.col("code").isNull()).select("page_id", "normalized")


_IP = """(SELECT page_id, address, CAST(split_part(address, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(address, '.', 2) AS BIGINT) * 65536
 + CAST(split_part(address, '.', 3) AS BIGINT) * 256 + CAST(split_part(address, '.', 4) AS BIGINT) AS ip FROM f_addresses)"""
_DENIED = """(ip // 16777216 IN (0, 10, 127) OR ip // 65536 IN (169 * 256 + 254, 192 * 256 + 168) OR ip // 1048576 = 172 * 16 + 1
 OR ip // 16777216 >= 224)"""


@query(
    "address_allowed",
    "f_addresses",
    "f_addresses6",
    sql=f"SELECT page_id, address, NOT {_DENIED} AS allowed, NOT (ip // 16777216 = 127 OR ip // 65536 = 169 * 256 + 254"
    f" OR ip // 16777216 BETWEEN 224 AND 239 OR ip = 0) AS allowed_private FROM {_IP} UNION ALL "
    "SELECT page_id, address, page_id % 8 = 0, page_id % 8 IN (0, 3, 4, 6) FROM f_addresses6",
)
def address_allowed(spark, root):
    return spark.table("f_addresses").unionByName(spark.table("f_addresses6")).select(
        "page_id",
        "address",
        A.address_allowed(F.col("address")).alias("allowed"),
        A.address_allowed(F.col("address"), allow_private=True).alias("allowed_private"),
    )


@query(
    "url_guard",
    "f_urls",
    "f_addresses",
    "f_literal_urls",
    sql=f"""SELECT page_id, code FROM (SELECT page_id, CASE WHEN page_id % 8 IN (1, 2, 7) THEN 'INVALID_REQUEST'
 WHEN regexp_matches(f_urls.url, '^http://blocked[01]\\.') THEN 'DOMAIN_NOT_ALLOWED' WHEN p.url LIKE '%?%' THEN 'DNS_FAILED'
 WHEN {_DENIED} AND ip // 16777216 <> 10 THEN 'DOMAIN_NOT_ALLOWED' END AS code FROM f_urls JOIN {_IP} USING (page_id) JOIN pages p USING (page_id))
UNION ALL SELECT page_id, CASE WHEN (page_id - 1000000) % 6 IN (1, 4) THEN 'DOMAIN_NOT_ALLOWED' END FROM f_literal_urls""",
)
def url_guard(spark, root):
    """The addresses of pages with a query are recorded under keys that do not exist; two networks are allowed."""
    lost = spark.table("pages").select("page_id", F.col("url").contains("?").alias("lost"))
    known = spark.table("f_addresses").join(lost, "page_id").select(
        F.when(F.col("lost"), -F.col("page_id") - 1).otherwise(F.col("page_id")).alias("page_id"), "address"
    )
    networks = spark.createDataFrame([("10.0.0.0/8",), ("fd00::/8",)], "cidr string")
    urls = spark.table("f_urls").unionByName(spark.table("f_literal_urls"))
    return G.guard_urls(urls, known, "page_id", BLOCKED, networks=networks).select("page_id", "code")


_HEADERS = "SELECT request_id, name, value FROM f_header_rows"


def _header_maps(spark):
    return tables.header_map(spark.table("f_header_rows"), "request_id")


@query(
    "forbidden_headers",
    "f_header_rows",
    sql="""SELECT request_id, min(CASE WHEN lower(name) IN ('host', 'content-length', 'connection', 'proxy-authorization') THEN lower(name) END) AS forbidden,
 CASE WHEN bool_or(lower(name) IN ('host', 'content-length', 'connection', 'proxy-authorization')) THEN 'INVALID_REQUEST' END AS error
FROM f_header_rows GROUP BY request_id""",
)
def forbidden_headers(spark, root):
    return R.header_check(_header_maps(spark)).select("request_id", "forbidden", "error")


@query(
    "redact_headers",
    "f_header_rows",
    sql="""SELECT request_id, name, CASE WHEN lower(name) IN ('authorization', 'cookie', 'proxy-authorization', 'set-cookie', 'x-api-key')
 THEN '[REDACTED]' ELSE value END AS value FROM f_header_rows""",
)
def redact_headers(spark, root):
    return _header_maps(spark).select("request_id", F.explode(H.redact_headers(F.col("headers"))).alias("name", "value"))


@query(
    "lower_header_keys",
    "f_header_rows",
    sql="SELECT request_id, lower(name) AS name, value FROM f_header_rows",
)
def lower_header_keys(spark, root):
    return _header_maps(spark).select("request_id", F.explode(H.lower_header_keys(F.col("headers"))).alias("name", "value"))


@query(
    "header_digest",
    "f_header_rows",
    sql="SELECT request_id, name, concat('sha256:', sha256(value)) AS digest FROM f_header_rows",
)
def header_digest(spark, root):
    return spark.table("f_header_rows").select("request_id", "name", H.header_digest(F.col("value")).alias("digest"))


@query(
    "content_type_default",
    "f_responses",
    sql="SELECT page_id, coalesce(content_type, 'application/octet-stream') AS content_type FROM f_responses",
)
def content_type_default(spark, root):
    headers = F.when(F.col("content_type").isNotNull(), F.create_map(F.lit("content-type"), F.col("content_type")))
    return spark.table("f_responses").select("page_id", H.content_type(headers).alias("content_type"))


_KEY = """sha256(concat('{{"headers":{headers},"method":"GET","mode":"', mode, '","profile":"', profile, '","proxy_policy":"',
 proxy_policy, '","save_artifact":', coalesce(CAST(save_artifact AS VARCHAR), 'null'), ',"url":"', url, '"}}'))"""


@query(
    "fetch_key",
    "f_requests",
    "f_header_rows",
    sql=f"""WITH h AS (SELECT request_id, string_agg(concat('"', lower(name), '":"', CASE WHEN lower(name) = 'accept' THEN value
  ELSE concat('sha256:', sha256(value)) END, '"'), ',' ORDER BY lower(name)) AS js FROM f_header_rows
  WHERE lower(name) IN ('accept', 'authorization', 'cookie') GROUP BY request_id)
SELECT r.request_id, {_KEY.format(headers="', concat('{', coalesce(js, ''), '}'), '")} AS fetch_key
FROM f_requests r LEFT JOIN h ON r.request_id = h.request_id""",
)
def fetch_key(spark, root):
    requests = spark.table("f_requests").join(_header_maps(spark), "request_id", "left")
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    return R.fetch_keys(requests.withColumn("headers", F.coalesce("headers", empty))).select("request_id", "fetch_key")


@query(
    "fetch_key_normalized",
    "f_requests",
    sql=f"""SELECT request_id, {_KEY.format(headers='{}')} AS fetch_key
FROM (SELECT * REPLACE (regexp_replace(url, '#.*$', '') AS url) FROM f_requests)""",
)
def fetch_key_normalized(spark, root):
    return R.fetch_keys(spark.table("f_requests"), normalized=True).select("request_id", "fetch_key")


@query(
    "success_flag",
    "f_requests",
    sql="SELECT request_id, status_code BETWEEN 200 AND 399 AS success FROM f_requests",
)
def success_flag(spark, root):
    return spark.table("f_requests").select("request_id", R.success(F.col("status_code")).alias("success"))


@query(
    "status_class",
    "f_requests",
    sql="""SELECT request_id, CASE WHEN status_code IN (408, 425, 429, 500, 502, 503, 504) THEN 'retryable'
 WHEN status_code IN (301, 302, 303, 307, 308) AND request_id % 2 = 0 THEN 'redirect' ELSE 'final' END AS class FROM f_requests""",
)
def status_class(spark, root):
    location = F.when(F.col("request_id") % 2 == 0, "/next")
    return spark.table("f_requests").select("request_id", L.status_class(F.col("status_code"), location).alias("class"))


_REASON = """CASE WHEN status_code IN (403, 429, 503) THEN concat('status_', status_code)
 WHEN coalesce(content_type, '') NOT ILIKE '%html%' THEN NULL WHEN length(trim(body)) < 300 THEN 'html_too_short'
 WHEN lower(body) LIKE '%enable javascript%' THEN 'javascript_challenge'
 WHEN required_selector = '#missing' THEN 'required_selector_missing'
 WHEN required_selector = 'article h1' AND NOT regexp_matches(body, '<article>\\s*<h1') THEN 'required_selector_missing' END"""


@query("upgrade_reason", "f_responses", sql=f"SELECT page_id, {_REASON} AS upgrade_reason FROM f_responses")
def upgrade_reason(spark, root):
    return L.upgrade_reason(spark.table("f_responses")).select("page_id", "upgrade_reason")


@query(
    "strategy_decide",
    "f_responses",
    sql=f"""SELECT page_id, mode, CASE WHEN mode = 'browser' OR (mode = 'auto' AND {_REASON} IS NOT NULL) THEN 'browser' ELSE 'http' END
 AS strategy FROM f_responses""",
)
def strategy_decide(spark, root):
    decided = L.upgrade_reason(spark.table("f_responses"))
    return decided.select("page_id", "mode", L.strategy_of(F.col("mode"), F.col("upgrade_reason")).alias("strategy"))


@query(
    "queue_route",
    "f_requests",
    sql="SELECT request_id, CASE mode WHEN 'http' THEN 'http' ELSE 'browser' END AS queue FROM f_requests",
)
def queue_route(spark, root):
    return spark.table("f_requests").select("request_id", R.queue_of(F.col("mode")).alias("queue"))


@query(
    "proxy_decide",
    "f_requests",
    sql="""SELECT request_id, proxy_policy = 'proxy' AS direct_default, proxy_policy <> 'direct' AS proxy_default,
 FALSE AS no_proxy FROM f_requests""",
)
def proxy_decide(spark, root):
    policy = F.col("proxy_policy")
    return spark.table("f_requests").select(
        "request_id",
        R.use_proxy(policy).alias("direct_default"),
        R.use_proxy(policy, "proxy").alias("proxy_default"),
        R.use_proxy(policy, "proxy", proxy_known=False).alias("no_proxy"),
    )


@query(
    "ttl_resolve",
    "f_requests",
    sql="""SELECT request_id, CAST(coalesce(cache_ttl, 3600) AS INTEGER) AS ttl, NOT force_refresh AND coalesce(cache_ttl, 3600) > 0 AS readable,
 status_code BETWEEN 200 AND 399 AND coalesce(cache_ttl, 3600) > 0 AS writable FROM f_requests""",
)
def ttl_resolve(spark, root):
    return R.ttl_resolve(spark.table("f_requests")).select("request_id", F.col("ttl").cast("int"), "readable", "writable")


@query(
    "save_resolve",
    "f_requests",
    sql="SELECT request_id, coalesce(save_artifact, TRUE) AS save FROM f_requests",
)
def save_resolve(spark, root):
    return spark.table("f_requests").select("request_id", R.save_resolve(F.col("save_artifact")).alias("save"))


@query(
    "body_size_limit",
    sql="SELECT page_id, CASE WHEN strlen(html) > 4096 THEN 'RESPONSE_TOO_LARGE' END AS error FROM pages",
)
def body_size_limit(spark, root):
    return spark.table("pages").select("page_id", R.body_size_check(F.col("html"), 4096).alias("error"))


@query(
    "extract_xor",
    sql="""SELECT page_id, CASE WHEN page_id % 4 IN (0, 3) THEN 'INVALID_REQUEST' END AS error FROM pages""",
)
def extract_xor(spark, root):
    kind = F.col("page_id") % 4
    url = F.when(kind.isin(1, 3), F.col("url")).when(kind == 2, "")
    artifact = F.when(kind.isin(2, 3), F.concat(F.lit("art_"), F.md5(F.col("page_id").cast("string"))))
    return spark.table("pages").select("page_id", R.extract_xor(url, artifact).alias("error"))


@query(
    "artifact_id_check",
    sql="""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN TRUE ELSE FALSE END AS valid FROM documents""",
)
def artifact_id_check(spark, root):
    digest = F.md5(F.col("doc_id").cast("string"))
    kind = F.col("doc_id") % 4
    name = (
        F.when(kind == 0, F.concat(F.lit("art_"), digest))
        .when(kind == 1, digest)
        .when(kind == 2, F.concat(F.lit("art_"), digest, F.lit("0")))
        .otherwise(F.concat(F.lit("../"), digest))
    )
    return spark.table("documents").select("doc_id", R.artifact_id_valid(name).alias("valid"))


@query(
    "error_catalog",
    "f_outcomes",
    sql="""SELECT item_id, error_code, CASE error_code WHEN 'READ_TIMEOUT' THEN 504 WHEN 'INVALID_REQUEST' THEN 422 END AS http_status,
 CASE error_code WHEN 'READ_TIMEOUT' THEN TRUE WHEN 'INVALID_REQUEST' THEN FALSE END AS retryable FROM f_outcomes""",
)
def error_catalog(spark, root):
    """The catalog is a fixed table of 18 rows, so it is broadcast."""
    codes = tables.error_catalog(spark).withColumnRenamed("code", "error_code")
    return spark.table("f_outcomes").select("item_id", "error_code").join(F.broadcast(codes), "error_code", "left")


@query(
    "cidr_allowlist",
    "f_addresses",
    "f_addresses6",
    sql=f"SELECT page_id, address FROM {_IP} WHERE ip // 16777216 = 10 OR ip // 1048576 = 172 * 16 + 1 OR address LIKE '93.184.1%.34'"
    " AND ip // 256 BETWEEN 93 * 65536 + 184 * 256 + 16 AND 93 * 65536 + 184 * 256 + 19 UNION ALL"
    " SELECT page_id, address FROM f_addresses6 WHERE page_id % 8 IN (0, 3)",
)
def cidr_allowlist(spark, root):
    names = ("10.0.0.0/8", "172.16.0.0/12", "93.184.16.0/22", "fd00::/8", "2606:4700::/32")
    networks = spark.createDataFrame([(name,) for name in names], "cidr string")
    return G.within_networks(spark.table("f_addresses").unionByName(spark.table("f_addresses6")), networks)


@query(
    "blocked_hosts",
    "f_urls",
    sql="SELECT page_id, url FROM f_urls WHERE regexp_matches(url, '^http://blocked[01]\\.example')",
)
def blocked_hosts(spark, root):
    hosts = spark.createDataFrame([("Blocked0.example.org.",), ("blocked1.example.org",)], "host string")
    return G.blocked(spark.table("f_urls"), hosts)


@query(
    "addresses_sorted",
    "f_requests",
    "f_addresses",
    sql=f"""SELECT host, address, row_number() OVER (PARTITION BY host ORDER BY address) AS place
FROM (SELECT DISTINCT {DOMAIN} AS host, address FROM pages JOIN f_addresses USING (page_id))""",
)
def addresses_sorted(spark, root):
    resolved = spark.table("pages").select("page_id", U.domain_of(F.col("url")).alias("host")).join(
        spark.table("f_addresses"), "page_id"
    )
    return G.addresses_sorted(resolved)


@query(
    "domain_of",
    "f_urls",
    sql="SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://(?:[^/@]*@)?([^/:?#]*)', 1)) AS domain FROM f_urls",
)
def domain_of(spark, root):
    return spark.table("f_urls").select("page_id", U.domain_of(F.col("url")).alias("domain"))


_HREF = """CASE page_id % 9 WHEN 0 THEN '/a/b?x=1' WHEN 1 THEN 'rel/x' WHEN 2 THEN '../up' WHEN 3 THEN '?q=1' WHEN 4 THEN '#frag'
 WHEN 5 THEN 'https://other.example/x' WHEN 6 THEN 'mailto:a@b.example' WHEN 7 THEN '//cdn.example/y' ELSE '' END"""


@query(
    "url_join",
    sql=f"""SELECT page_id, CASE page_id % 9 WHEN 0 THEN concat(origin, href) WHEN 1 THEN concat(origin, dir, href)
  WHEN 2 THEN concat(origin, regexp_replace(dir, '[^/]+/$', ''), 'up') WHEN 3 THEN concat(origin, path, href)
  WHEN 4 THEN concat(regexp_replace(url, '#.*$', ''), href) WHEN 7 THEN concat(regexp_extract(url, '^(https?:)', 1), href)
  WHEN 8 THEN url ELSE href END AS joined
FROM (SELECT page_id, url, {_HREF} AS href, regexp_extract(url, '^(https?://[^/]+)', 1) AS origin,
 regexp_extract(url, '^https?://[^/]+([^?#]*)', 1) AS path, regexp_extract(url, '^https?://[^/]+([^?#]*/)', 1) AS dir FROM pages)""",
)
def url_join(spark, root):
    return spark.table("pages").select("page_id", "url", F.expr(_HREF).alias("href")).select(
        "page_id", U.url_join(F.col("url"), F.col("href")).alias("joined")
    )


@query(
    "collapse_ws",
    sql=r"SELECT doc_id, trim(regexp_replace(concat(chr(160), text, chr(12288), '  x'), '[\s\x{00A0}\x{3000}]+', ' ', 'g')) AS text FROM documents",
)
def collapse_ws(spark, root):
    padded = F.concat(F.lit("\u00a0"), F.col("text"), F.lit("\u3000  x"))
    return spark.table("documents").select("doc_id", X.collapse_ws(padded).alias("text"))


@query(
    "split_lines",
    sql=r"""SELECT doc_id, CAST(len(l) AS INTEGER) AS n_lines, array_to_string(l, '|') AS lines
FROM (SELECT doc_id, list_filter(string_split_regex(text, '\r\n|[\n\r\v\f]'), lambda x: trim(x, ' ' || chr(9)) <> '') AS l FROM documents)""",
)
def split_lines(spark, root):
    lines = X.split_lines(F.col("text"))
    return spark.table("documents").select(
        "doc_id", F.size(lines).alias("n_lines"), F.array_join(lines, "|").alias("lines")
    )


@query(
    "lines_first_seen",
    sql=r"""SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS lines
FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""",
)
def lines_first_seen(spark, root):
    return spark.table("documents").select(
        "doc_id", F.array_join(X.lines_first_seen(F.split("text", "\n")), "|").alias("lines")
    )


@query(
    "first_match",
    sql=r"""SELECT doc_id, coalesce(list_filter(string_split(text, chr(10)), lambda x: contains(x, 'tion'))[1], '') AS line FROM documents""",
)
def first_match(spark, root):
    line = X.first_match(F.split("text", "\n"), lambda value: value.contains("tion"))
    return spark.table("documents").select("doc_id", line.alias("line"))


@query(
    "charset_decode",
    sql="SELECT doc_id, text FROM documents",
)
def charset_decode(spark, root):
    """Named, missing and unknown charsets all read UTF-8 here; other ones are tested apart."""
    kind = F.when(F.col("doc_id") % 3 == 0, "text/html; charset=UTF-8").when(
        F.col("doc_id") % 3 == 1, "text/html; charset=no-such; q=1"
    ).otherwise("text/html")
    body = F.col("text").cast("binary")
    return spark.table("documents").select("doc_id", X.decode_body(body, X.header_charset(kind)).alias("text"))


@query(
    "meta_charset",
    sql="SELECT page_id, coalesce(nullif(regexp_extract(html[1:4096], '(?i)charset\\s*=\\s*[''\"]?([a-zA-Z0-9._-]+)', 1), ''), 'utf-8') AS charset FROM pages",
)
def meta_charset(spark, root):
    return spark.table("pages").select("page_id", X.meta_charset(F.col("html")).alias("charset"))


@query(
    "retry_after",
    "f_attempts",
    sql="""SELECT request_id, sequence, CASE WHEN sequence = 3 THEN 60.0 WHEN retry_after = '0' THEN 0.0 WHEN retry_after = '900' THEN 300.0
 ELSE 0.25 * power(2, sequence - 1) END AS delay FROM f_attempts""",
)
def retry_after(spark, root):
    given = F.when(F.col("sequence") == 3, "Wed, 21 Oct 2026 07:28:00 GMT").otherwise(F.col("retry_after"))
    now = F.lit("2026-10-21 07:27:00").cast("timestamp")
    return spark.table("f_attempts").select(
        "request_id", "sequence", T.retry_delay(F.col("sequence"), given, now).alias("delay")
    )


@query(
    "backoff_delay",
    "f_attempts",
    sql="SELECT request_id, sequence, 0.25 * power(2, sequence - 1) AS delay FROM f_attempts",
)
def backoff_delay(spark, root):
    return spark.table("f_attempts").select("request_id", "sequence", T.backoff_delay(F.col("sequence")).alias("delay"))


@query(
    "item_backoff",
    "f_outcomes",
    sql="""SELECT item_id, CASE WHEN coalesce(retry_after_seconds, 0) = 0 THEN power(2, attempt) ELSE CAST(retry_after_seconds AS DOUBLE) END
 AS delay FROM f_outcomes""",
)
def item_backoff(spark, root):
    return spark.table("f_outcomes").select(
        "item_id", T.item_backoff(F.col("attempt"), F.col("retry_after_seconds")).alias("delay")
    )


@query(
    "lease_until",
    sql="SELECT event_id, epoch_us(ts) + 120000000 AS lease_us FROM events",
)
def lease_until(spark, root):
    return spark.table("events").select("event_id", T.micros(T.lease_until(F.col("ts"))).alias("lease_us"))


@query(
    "iso_time",
    sql="""SELECT event_id, concat(strftime(ts, '%Y-%m-%dT%H:%M:%S'), CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END,
 '+00:00') AS iso, epoch_us(ts) AS back_us FROM events""",
)
def iso_time(spark, root):
    iso = T.iso_time(F.col("ts").cast("timestamp"))
    return spark.table("events").select("event_id", iso.alias("iso"), F.unix_micros(T.parse_iso(iso)).alias("back_us"))


@query("date_path", sql="SELECT event_id, strftime(ts, '%Y/%m/%d') AS path FROM events")
def date_path(spark, root):
    return spark.table("events").select("event_id", T.date_path(F.col("ts")).alias("path"))


@query(
    "elapsed_ms",
    sql="SELECT event_id, CAST(trunc((value + value / 8 - value) * 1000) AS BIGINT) AS elapsed FROM events",
)
def elapsed_ms(spark, root):
    started = F.col("value")
    return spark.table("events").select(
        "event_id", T.elapsed_ms(started, F.col("value") + F.col("value") / 8).alias("elapsed")
    )


@query("new_id", sql="SELECT event_id, TRUE AS shaped, concat('item_', sha256(CAST(event_id AS VARCHAR))[1:32]) AS stable FROM events")
def new_id(spark, root):
    return spark.table("events").select(
        "event_id",
        T.new_id("art").rlike("^art_[0-9a-f]{32}$").alias("shaped"),
        T.stable_id("item", F.col("event_id")).alias("stable"),
    )


@query("api_key_digest", sql="SELECT event_id, sha256(props) AS digest FROM events")
def api_key_digest(spark, root):
    return spark.table("events").select("event_id", T.api_key_digest(F.col("props")).alias("digest"))


@query(
    "request_id_truncate",
    sql="""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN concat('req_', doc_id) ELSE text[1:128] END AS request_id FROM documents""",
)
def request_id_truncate(spark, root):
    given = F.when(F.col("doc_id") % 10 == 0, "").when(F.col("doc_id") % 5 != 0, F.col("text"))
    fallback = F.concat(F.lit("req_"), F.col("doc_id").cast("string"))
    return spark.table("documents").select("doc_id", T.request_id_or(given, fallback).alias("request_id"))


@query(
    "domain_policy_apply",
    "f_requests",
    sql=f"""WITH p AS (SELECT DISTINCT {DOMAIN} AS domain FROM pages),
q AS (SELECT domain, CASE length(domain) % 3 WHEN 0 THEN 'browser' WHEN 1 THEN 'http' END AS mode,
 CASE length(domain) % 2 WHEN 0 THEN 'direct' END AS proxy_policy, CASE length(domain) % 4 WHEN 1 THEN 5 END AS max_attempts FROM p)
SELECT request_id, r.domain, coalesce(q.mode, r.mode) AS mode, coalesce(q.proxy_policy, r.proxy_policy) AS proxy_policy,
 coalesce(q.max_attempts, 3) AS max_attempts FROM (SELECT *, {DOMAIN} AS domain FROM f_requests) r LEFT JOIN q ON q.domain = r.domain""",
)
def domain_policy_apply(spark, root):
    domains = spark.table("pages").select(U.domain_of(F.col("url")).alias("domain")).distinct()
    length = F.length("domain")
    policies = domains.select(
        "domain",
        F.when(length % 3 == 0, "browser").when(length % 3 == 1, "http").alias("mode"),
        F.when(length % 2 == 0, "direct").alias("proxy_policy"),
        F.when(length % 4 == 1, 5).alias("max_attempts"),
        F.lit(None).cast("bigint").alias("interval_us"),
    )
    return R.domain_policy_apply(spark.table("f_requests"), policies).select(
        "request_id", "domain", "mode", "proxy_policy", "max_attempts"
    )


@query(
    "client_quota",
    "f_requests",
    sql="""SELECT client_id, epoch_us(date_trunc('minute', ts)) AS minute_us, count(*) AS n, count(*) > 1 AS over_quota
FROM f_requests GROUP BY 1, 2""",
)
def client_quota(spark, root):
    counted = R.client_quota(spark.table("f_requests"), quota=1)
    return counted.select("client_id", T.micros(F.col("minute")).alias("minute_us"), "n", "over_quota")


@query(
    "host_selector_match",
    "f_profile_pages",
    sql="""SELECT page_id, CASE page_id % 4 WHEN 0 THEN '.con|.cnt_box' WHEN 1 THEN '.p_content|.rm_txt_con|.text_con'
 WHEN 2 THEN '#detail|.main-aticle|.xl-main-content|.article' END AS selectors FROM f_profile_pages""",
)
def host_selector_match(spark, root):
    hosts = spark.table("f_profile_pages").select("page_id", U.domain_of(F.col("url")).alias("host"))
    return E.site_selectors(hosts, E.known_sites(spark)).select("page_id", F.array_join("selectors", "|").alias("selectors"))


_HOST_NAME = r"regexp_replace(lower(host), '\.+$', '')"


@query(
    "domain_rule_longest",
    "f_hosts",
    "f_policies",
    sql=rf"""WITH h AS (SELECT row_id, {_HOST_NAME} AS name FROM f_hosts),
p AS (SELECT policy_id, mode, regexp_replace(lower(domain), '\.+$', '') AS name FROM f_policies WHERE domain <> '')
SELECT row_id, any_value(h.name) AS name, arg_max(policy_id, length(p.name)) AS policy_id, arg_max(p.name, length(p.name)) AS rule_domain
FROM h LEFT JOIN p ON h.name = p.name OR (NOT regexp_matches(h.name, '^[0-9.]+$') AND ends_with(h.name, concat('.', p.name))) GROUP BY row_id""",
)
def domain_rule_longest(spark, root):
    """Which of thousands of nested domain rules holds for each host."""
    found = N.longest_rule(spark.table("f_hosts"), spark.table("f_policies"))
    return found.select("row_id", N.plain_name(F.col("host")).alias("name"), F.col("rule.policy_id").alias("policy_id"), N.plain_name(F.col("rule.domain")).alias("rule_domain"))


@query(
    "site_rules_nested",
    "f_hosts",
    "f_policies",
    sql=rf"""WITH h AS (SELECT row_id, {_HOST_NAME} AS name FROM f_hosts),
p AS (SELECT policy_id, mode, regexp_replace(lower(domain), '\.+$', '') AS name FROM f_policies WHERE domain <> ''),
m AS (SELECT row_id, arg_max(policy_id, length(p.name)) AS policy_id FROM h JOIN p ON h.name = p.name OR (NOT regexp_matches(h.name, '^[0-9.]+$') AND ends_with(h.name, concat('.', p.name))) GROUP BY row_id)
SELECT row_id, CASE WHEN policy_id IS NOT NULL THEN concat('#site', policy_id, '|.text') END AS selectors FROM h LEFT JOIN m USING (row_id)""",
)
def site_rules_nested(spark, root):
    """Containers by a table of thousands of sites in place of the known ones."""
    sites = spark.table("f_policies").select("domain", F.array(F.concat(F.lit("#site"), F.col("policy_id").cast("string")), F.lit(".text")).alias("selectors"))
    return E.site_selectors(spark.table("f_hosts"), sites).select("row_id", F.array_join("selectors", "|").alias("selectors"))


@query(
    "domain_policy_nested",
    "f_hosts",
    "f_policies",
    sql=rf"""WITH h AS (SELECT row_id, {_HOST_NAME} AS name FROM f_hosts),
p AS (SELECT mode, proxy_policy, max_attempts, regexp_replace(lower(domain), '\.+$', '') AS name FROM f_policies WHERE domain <> ''),
m AS (SELECT row_id, unnest(arg_max({{'mode': p.mode, 'proxy_policy': p.proxy_policy, 'max_attempts': p.max_attempts}}, length(p.name))) FROM h
 JOIN p ON h.name = p.name OR (NOT regexp_matches(h.name, '^[0-9.]+$') AND ends_with(h.name, concat('.', p.name))) GROUP BY row_id)
SELECT row_id, coalesce(m.mode, 'auto') AS mode, coalesce(m.proxy_policy, 'auto') AS proxy_policy, CAST(coalesce(m.max_attempts, 3) AS INTEGER) AS max_attempts FROM h LEFT JOIN m USING (row_id)""",
)
def domain_policy_nested(spark, root):
    """Strategy, proxy and attempts of requests to hosts below nested policies."""
    auto = F.lit("auto")
    requests = spark.table("f_hosts").select("row_id", F.concat(F.lit("http://"), "host", F.lit("/x")).alias("url"), auto.alias("mode"), auto.alias("proxy_policy"))
    policies = spark.table("f_policies").drop("policy_id").withColumn("interval_us", F.lit(None).cast("bigint"))
    return R.domain_policy_apply(requests, policies).select("row_id", "mode", "proxy_policy", F.col("max_attempts").cast("int").alias("max_attempts"))


@query(
    "request_prepare",
    "f_raw_requests",
    sql=f"""SELECT request_id, CASE WHEN url IS NULL OR url LIKE 'ftp%' OR mode = 'magic' OR profile LIKE '%!' OR proxy_policy = 'tunnel'
 OR cache_ttl < 0 OR cache_ttl > 2592000 OR timeout_seconds <= 0 OR timeout_seconds > 300 OR length(required_selector) > 500
 THEN 'INVALID_REQUEST' END AS error, CASE WHEN url IS NOT NULL THEN {_KEY.format(headers='{}')} END AS fetch_key,
 coalesce(cache_ttl, 3600) AS ttl FROM (SELECT * REPLACE (coalesce(mode, 'auto') AS mode, coalesce(profile, 'anonymous') AS profile,
 coalesce(proxy_policy, 'auto') AS proxy_policy, url AS url) FROM f_raw_requests)""",
)
def request_prepare(spark, root):
    """Defaults, rules, guard syntax, keys and lifetimes together: one projection, no shuffle."""
    return R.prepare(spark.table("f_raw_requests")).select("request_id", "error", "fetch_key", F.col("ttl").cast("bigint").alias("ttl"))


