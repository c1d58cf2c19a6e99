"""Recorded traffic derived from the base tables.

Each view is one SQL text that both Spark and the SQL oracle run unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .tables import TABLES, table

VIEWS: dict[str, str] = {
    "f_requests": """
SELECT e.event_id AS request_id, e.user_id % 5 AS client_id, e.ts AS ts, p.page_id AS page_id, p.url AS url,
 CASE e.event_id % 5 WHEN 0 THEN 'browser' WHEN 1 THEN 'http' ELSE 'auto' END AS mode,
 CASE WHEN e.user_id % 10 = 0 THEN 'member' ELSE 'anonymous' END AS profile,
 CASE e.user_id % 4 WHEN 0 THEN 'proxy' WHEN 1 THEN 'direct' ELSE 'auto' END AS proxy_policy,
 CASE e.user_id % 3 WHEN 0 THEN NULL WHEN 1 THEN TRUE ELSE FALSE END AS save_artifact,
 CASE e.event_id % 7 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE 172800 END AS cache_ttl,
 (e.event_id % 11 = 0) AS force_refresh,
 CASE WHEN e.event_type = 'error' THEN (CASE e.event_id % 4 WHEN 0 THEN 403 WHEN 1 THEN 429 WHEN 2 THEN 503 ELSE 404 END)
      WHEN e.event_id % 13 = 0 THEN 301 ELSE 200 END AS status_code,
 CAST(floor(e.value * 10) AS BIGINT) AS elapsed_ms
FROM events e CROSS JOIN (SELECT count(*) AS n FROM pages) c
JOIN pages p ON p.page_id = (e.user_id * 7 + e.event_id % 3) % c.n""",
    "f_attempts": """
SELECT e.event_id AS request_id, k.seq AS sequence,
 CASE (e.event_id * 7 + k.seq * 13) % 10 WHEN 0 THEN 503 WHEN 1 THEN 429 WHEN 2 THEN 500 WHEN 3 THEN 404 ELSE 200 END AS status_code,
 (e.event_id * 31 + k.seq * 17) % 900 AS elapsed_ms,
 CASE e.event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '0' WHEN 2 THEN '900' ELSE 'soon' END AS retry_after
FROM events e CROSS JOIN (SELECT 1 AS seq UNION ALL SELECT 2 UNION ALL SELECT 3) k""",
    # where each page redirects to; beyond the last page nothing is recorded
    "f_redirects": """
SELECT page_id AS src, CASE WHEN page_id BETWEEN 20 AND 39 THEN page_id + 1 WHEN page_id % 32 = 18 THEN c.n + page_id
 WHEN page_id % 16 = 0 THEN (page_id + 1) % c.n WHEN page_id % 16 = 1 THEN page_id - 1
 WHEN page_id % 4 = 2 THEN (page_id * 7 + 3) % c.n END AS dst
FROM pages CROSS JOIN (SELECT count(*) AS n FROM pages) c""",
    # the same as recorded responses: every 23rd page on a refused host, locations in four spellings
    "f_hops": """
SELECT concat('HTTP://', CASE WHEN src % 23 = 7 THEN 'Blocked0.example.org' ELSE 'site.example.org:80' END, '/d/p', src) AS url,
 CASE WHEN dst IS NULL THEN 200 WHEN src % 2 = 0 THEN 302 ELSE 308 END AS status_code,
 CASE WHEN dst IS NULL THEN CASE WHEN src % 5 = 0 THEN '/unused' END
  WHEN dst % 23 = 7 THEN concat('http://blocked0.example.org/d/p', dst)
  WHEN src % 23 = 7 OR src % 4 = 0 THEN concat('http://Site.example.org:80/d/p', dst, '#top') WHEN src % 4 = 1 THEN concat('/d/p', dst)
  WHEN src % 4 = 2 THEN concat('p', dst, '#part') ELSE concat('../d/./p', dst) END AS location
FROM f_redirects""",
    # address literals as hosts
    "f_literal_urls": """
SELECT page_id + 1000000 AS page_id, CASE page_id % 6 WHEN 0 THEN concat('http://10.0.0.', page_id % 250, '/') WHEN 1 THEN 'http://[::1]/x'
 WHEN 2 THEN 'https://[2606:4700::1]:8443/' WHEN 3 THEN 'http://[fd00::5]/' WHEN 4 THEN 'http://192.168.1.1/' ELSE 'http://93.184.216.34/' END AS url
FROM pages""",
    "f_addresses6": """
SELECT page_id, CASE page_id % 8 WHEN 0 THEN concat('2606:4700::', page_id % 10000) WHEN 1 THEN '::1' WHEN 2 THEN 'fe80::1' WHEN 3 THEN 'fd00::5'
 WHEN 4 THEN '2001:db8::1' WHEN 5 THEN 'ff02::1' WHEN 6 THEN '::ffff:10.0.0.1' ELSE '::' END AS address FROM pages""",
    "f_addresses": """
SELECT page_id, CASE page_id % 9 WHEN 0 THEN concat('10.', page_id % 256, '.0.1') WHEN 1 THEN '127.0.0.1' WHEN 2 THEN '169.254.169.254'
 WHEN 3 THEN concat('172.', 16 + page_id % 32, '.0.1') WHEN 4 THEN '192.168.1.1' WHEN 5 THEN '100.64.0.1' WHEN 6 THEN '224.0.0.1'
 WHEN 7 THEN '0.0.0.0' ELSE concat('93.184.', page_id % 256, '.34') END AS address
FROM pages""",
    "f_urls": """
SELECT page_id, CASE page_id % 8 WHEN 0 THEN url WHEN 1 THEN concat('ftp://h', page_id, '.example.org/x')
 WHEN 2 THEN concat('https://user:pw@h', page_id, '.example.org/') WHEN 3 THEN concat('HTTPS://H', page_id, '.Example.ORG.:443/A?b=C#d')
 WHEN 4 THEN concat('http://h', page_id, '.example.org:8080') WHEN 5 THEN concat('http://blocked', page_id % 3, '.example.org/')
 WHEN 6 THEN concat('https://a_b.example.net/p', page_id) ELSE 'http:///nohost' END AS url
FROM pages""",
    "f_header_rows": """
SELECT r.event_id AS request_id, h.name AS name, concat(h.prefix, r.user_id) AS value
FROM events r JOIN (SELECT 0 AS k, 'Accept' AS name, 'text/' AS prefix UNION ALL SELECT 1, 'Authorization', 'Bearer '
 UNION ALL SELECT 2, 'Host', 'evil' UNION ALL SELECT 3, 'Cookie', 'sid=' UNION ALL SELECT 4, 'Content-Length', ''
 UNION ALL SELECT 5, 'X-Other', 'v') h ON (r.event_id + h.k) % 4 = 0""",
    # items with traces of earlier claims and outcomes
    "f_job_items": """
SELECT i.*, CASE WHEN state <> 'queued' THEN concat('w', item_id % 3) END AS worker_id,
 CASE WHEN state = 'running' THEN next_run_at + INTERVAL 120 SECOND END AS leased_until,
 CASE WHEN state = 'succeeded' THEN concat('old_', item_id) END AS request_id,
 CASE WHEN state = 'succeeded' THEN concat('{"n":', item_id, '}') END AS result,
 CASE WHEN state = 'failed' OR attempts = 2 THEN 'DNS_FAILED' END AS error_code,
 CASE WHEN state = 'failed' OR attempts = 2 THEN 'no address' END AS error_message
FROM (SELECT o_orderkey AS item_id, o_orderkey - o_orderkey % 10 AS job_id, CAST(o_orderkey % 10 AS INT) AS position,
 (o_orderkey - o_orderkey % 10) % 7 AS client_id,
 CASE WHEN o_orderkey % 40 < 10 THEN 'succeeded' ELSE CASE (o_orderkey * 13 + o_custkey) % 7 WHEN 0 THEN 'queued'
  WHEN 1 THEN 'running' WHEN 2 THEN 'failed' WHEN 3 THEN 'cancelled' ELSE 'succeeded' END END AS state,
 CASE o_custkey % 3 WHEN 0 THEN 'http' ELSE 'browser' END AS queue, CAST(o_custkey % 4 AS INT) AS attempts,
 o_orderdate AS next_run_at, o_orderpriority AS priority
FROM orders) i""",
    "f_jobs": """
SELECT job_id, min(client_id) AS client_id, CASE job_id % 20 WHEN 0 THEN 'queued' ELSE 'running' END AS prior_state,
 min(next_run_at) AS created_at
FROM f_job_items GROUP BY job_id""",
    "f_artifacts": """
SELECT doc_id AS artifact_no, source, lang, text AS body FROM documents""",
    "f_timeline_lines": """
SELECT o_orderkey AS line_id, CASE o_orderkey % 6 WHEN 0 THEN concat(1950 + o_orderkey % 60, '－', 1955 + o_orderkey % 60, '年　职务', o_custkey)
 WHEN 1 THEN concat(1990 + o_orderkey % 30, '－　委员', o_custkey) WHEN 2 THEN concat(1973 + o_orderkey % 30, '年8月起先后任', o_custkey)
 WHEN 3 THEN concat(2014, '.06 主任', o_custkey) WHEN 4 THEN concat(1980, '年-', 1990, ' 书记', o_custkey)
 ELSE concat('现任顾问', o_custkey) END AS line
FROM orders""",
    "f_http_log": """
SELECT event_id, ts, CASE event_type WHEN 'signup' THEN 'POST' WHEN 'purchase' THEN 'POST' ELSE 'GET' END AS method,
 CASE event_type WHEN 'signup' THEN '/v1/jobs' WHEN 'purchase' THEN '/v1/fetch' WHEN 'view' THEN '/v1/artifacts/{id}'
  WHEN 'click' THEN '/v1/jobs/{id}' ELSE '/v1/extract' END AS path,
 CASE event_id % 9 WHEN 0 THEN 422 WHEN 1 THEN 404 ELSE 200 END AS status, value / 20 AS seconds
FROM events""",
    # responses with short, scripted and plain bodies
    "f_responses": """
SELECT page_id, url, CASE page_id % 5 WHEN 0 THEN 'browser' WHEN 1 THEN 'http' ELSE 'auto' END AS mode,
 CASE page_id % 10 WHEN 0 THEN 403 WHEN 1 THEN 503 WHEN 2 THEN 404 WHEN 3 THEN 302 ELSE 200 END AS status_code,
 CASE page_id % 6 WHEN 0 THEN 'application/json' WHEN 1 THEN 'text/HTML; charset=UTF-8' WHEN 2 THEN NULL ELSE 'text/html' END AS content_type,
 CASE page_id % 8 WHEN 3 THEN concat('<html><p>', page_id, '</p></html>') WHEN 4 THEN concat(html, '<noscript>Please Enable JavaScript</noscript>') ELSE html END AS body,
 CASE page_id % 3 WHEN 0 THEN 'article h1' WHEN 1 THEN '#missing' END AS required_selector
FROM pages""",
    # requests as a caller may send them: missing and wrong values
    "f_raw_requests": """
SELECT request_id, CASE request_id % 12 WHEN 0 THEN NULL WHEN 1 THEN 'ftp://x.example.org/' ELSE url END AS url,
 CASE request_id % 10 WHEN 3 THEN 'magic' WHEN 4 THEN NULL ELSE mode END AS mode,
 CASE request_id % 9 WHEN 0 THEN 'bad profile!' WHEN 1 THEN NULL ELSE profile END AS profile,
 CASE request_id % 14 WHEN 5 THEN 'tunnel' WHEN 6 THEN NULL ELSE proxy_policy END AS proxy_policy,
 CASE request_id % 8 WHEN 0 THEN -1 WHEN 1 THEN 3000000 WHEN 2 THEN NULL ELSE cache_ttl END AS cache_ttl,
 CASE WHEN request_id % 11 = 1 THEN NULL ELSE force_refresh END AS force_refresh, save_artifact,
 CASE request_id % 6 WHEN 0 THEN CAST(0 AS DOUBLE) WHEN 1 THEN CAST(301 AS DOUBLE) WHEN 2 THEN CAST(300 AS DOUBLE) END AS timeout_seconds,
 CASE request_id % 13 WHEN 0 THEN repeat('x', 501) END AS required_selector
FROM f_requests""",
    # biography pages in the layouts of three sites and one unknown site
    "f_profile_pages": """
SELECT line_id AS page_id, CASE line_id % 4 WHEN 0 THEN 'http://www.cppcc.gov.cn/p.html' WHEN 1 THEN 'http://finance.people.com.cn/p.html'
  WHEN 2 THEN 'https://www.news.cn/p.html' ELSE 'https://other.example.org/p' END AS url,
 CASE line_id % 3 WHEN 0 THEN '张三' WHEN 1 THEN '王小明' ELSE '欧阳文华' END AS person, line,
 concat('<html><head><title>', CASE WHEN line_id % 7 > 0 AND line_id % 5 = 0
   THEN concat(CASE line_id % 3 WHEN 0 THEN '张三' WHEN 1 THEN '王小明' ELSE '欧阳文华' END, CASE line_id % 3 WHEN 0 THEN '简历' ELSE '同志简历' END) ELSE '人物' END,
  '</title></head><body><div class="navigation">无关导航</div><div ', CASE line_id % 4 WHEN 0 THEN 'class="con"'
   WHEN 1 THEN 'class="p_content clearfix"' WHEN 2 THEN 'id="detail"' ELSE 'class="text"' END, '>',
  CASE WHEN line_id % 7 = 0 THEN '<p>空白</p>' ELSE concat('<p>', CASE line_id % 3 WHEN 0 THEN '张三' WHEN 1 THEN '王小明' ELSE '欧阳文华' END,
   '，男，汉族。</p><script>x("<p>")</script><p>现任职务', line_id, '</p><p>', line, '</p>') END, '</div></body></html>') AS html
FROM f_timeline_lines""",
    # outcomes reported for running items: every third one twice, a failed attempt and a later one
    "f_outcomes": """
SELECT item_id, CAST(attempts + t.n AS INT) AS attempt, next_run_at + INTERVAL 10 SECOND AS reported_at, concat('req_', 9 - t.n, '_', item_id) AS request_id,
 CASE WHEN t.n = 1 AND item_id % 5 IN (0, 4) THEN concat('{"page":', item_id, '}') END AS result,
 CASE WHEN t.n = 0 THEN 'INVALID_REQUEST' ELSE CASE item_id % 5 WHEN 1 THEN 'READ_TIMEOUT' WHEN 2 THEN 'INVALID_REQUEST' WHEN 3 THEN 'CRASH' END END AS error_code,
 CASE WHEN t.n = 0 OR item_id % 5 IN (1, 2, 3) THEN concat('attempt ', t.n) END AS error_message,
 CASE item_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 30 END AS retry_after_seconds
FROM f_job_items JOIN (SELECT 0 AS n UNION ALL SELECT 1) t ON t.n = 1 OR item_id % 3 = 0 WHERE state = 'running'""",
    # hosts below listed and unlisted domains, spelt in several ways, and address literals
    "f_hosts": """
SELECT o_orderkey AS row_id, CASE o_orderkey % 8 WHEN 0 THEN concat('c', o_custkey, '.shop.example.org') WHEN 1 THEN concat('WWW.C', o_custkey, '.Shop.Example.org.')
 WHEN 2 THEN concat('x.y.c', o_custkey, '.example.net') WHEN 3 THEN concat('c', o_custkey, '.example.net') WHEN 4 THEN concat('my-shop.example.org')
 WHEN 5 THEN concat('10.0.', o_custkey % 200, '.1') WHEN 6 THEN concat('c', o_custkey, 'shop.example.org') ELSE concat('other', o_custkey, '.test') END AS host
FROM orders""",
    # one rule or more for every customer's domain, and rules for the domains above them
    "f_policies": """
SELECT CASE c_custkey % 4 WHEN 0 THEN concat('c', c_custkey, '.shop.example.org') WHEN 1 THEN concat('y.c', c_custkey, '.example.net')
  WHEN 2 THEN concat('C', c_custkey, '.example.NET.') ELSE concat('www.c', c_custkey, '.shop.example.org') END AS domain, c_custkey AS policy_id,
 CASE c_custkey % 3 WHEN 0 THEN 'browser' WHEN 1 THEN 'http' END AS mode, CASE c_custkey % 2 WHEN 0 THEN 'direct' END AS proxy_policy,
 CASE WHEN c_custkey % 5 = 1 THEN 5 END AS max_attempts FROM customer
UNION ALL SELECT concat('c', c_custkey, '.example.net'), c_custkey + 10000000, 'http', NULL, 2 FROM customer WHERE c_custkey % 4 = 1
UNION ALL SELECT k.domain, k.policy_id, k.mode, 'proxy', k.policy_id - 20000000 FROM (SELECT 'Example.ORG' AS domain, 20000001 AS policy_id, 'http' AS mode
  UNION ALL SELECT 'shop.example.org.', 20000002, 'browser' UNION ALL SELECT '0.1', 20000003, 'http' UNION ALL SELECT '', 20000004, 'http') k""",
    # recorded addresses of the hops' pages: some have none, some a second one that is refused
    "f_hop_addresses": """
SELECT page_id, CASE WHEN page_id % 29 = 3 THEN '10.0.0.1' WHEN page_id % 31 = 5 THEN '::1' ELSE concat('93.184.', page_id % 256, '.34') END AS address
FROM pages WHERE page_id % 37 <> 11
UNION ALL SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '127.0.0.1' ELSE '2606:4700::1' END FROM pages WHERE page_id % 19 = 4""",
    # queue view of the items
    "f_queue": """
SELECT *, next_run_at - INTERVAL 1 DAY AS created_at FROM f_job_items""",
}

_NEEDS = {
    "f_hops": ("f_redirects",),
    "f_raw_requests": ("f_requests",),
    "f_profile_pages": ("f_timeline_lines",),
    "f_jobs": ("f_job_items",),
    "f_outcomes": ("f_job_items",),
    "f_queue": ("f_job_items",),
}


def _ordered(names: tuple[str, ...]) -> list[str]:
    order: list[str] = []
    for name in names:
        for needed in (*_NEEDS.get(name, ()), name):
            if needed not in order:
                order.append(needed)
    return order


def register(spark: SparkSession, root: str, *names: str) -> None:
    """Temp views of the base tables and of the named derived views."""
    for base in TABLES:
        table(spark, root, base).createOrReplaceTempView(base)
    for name in _ordered(names):
        spark.sql(VIEWS[name]).createOrReplaceTempView(name)


def view(spark: SparkSession, root: str, name: str) -> DataFrame:
    register(spark, root, name)
    return spark.table(name)


def with_views(sql: str, *names: str, recursive: bool = False) -> str:
    """The same views as leading CTEs of an oracle query."""
    ctes = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in _ordered(names))
    body = sql.strip()
    word = "WITH RECURSIVE" if recursive else "WITH"
    if body.upper().startswith("WITH "):
        body = body[5:]
        return f"{word} {ctes + ', ' if ctes else ''}{body}"
    return f"{word} {ctes}\n{body}" if ctes else body
