"""Column functions against plain Python on many inputs."""

from __future__ import annotations

import hashlib
import ipaddress
import json
import re
from urllib.parse import urljoin, urlsplit, urlunsplit

import pytest
from pyspark.sql import functions as F

from pageloom.functions import addresses as A
from pageloom.functions import headers as H
from pageloom.functions import text as X
from pageloom.functions import timing as T
from pageloom.functions import urls as U
from pageloom.operators import guard as G
from pageloom.sources import tables


def apply(spark, rows, schema, **columns):
    frame = spark.createDataFrame([(n, *(row if isinstance(row, tuple) else (row,))) for n, row in enumerate(rows)], "n int, " + schema)
    return frame.select("n", *[value.alias(name) for name, value in columns.items()]).orderBy("n").collect()


URLS = [
    "http://example.com", "HTTPS://Example.COM./A/B?x=Y#f", "https://h:443/", "https://h:8443/p", "http://h:80", "http://h:0/", "http://h:/x",
    "ftp://h/x", "http://u:p@h/", "http://u@h/", "http://@h/", "http://:@h/", "http:///x", "//h/x", "h/x", "", "http://h?q", "http://h#f",
    "http://a_b.example/x", "http://[::1]:8080/x", "http://[2001:db8::1]/", "http://h/a//b/../c", "http://h/?#", "http://h:99999/", "http://h:x/",
    "https://中文.example/路径", "mailto:a@b",
]


def plain_guard(url):
    parts = urlsplit(url)
    if parts.scheme.lower() not in ("http", "https") or not parts.hostname or parts.username or parts.password:
        return "INVALID_REQUEST", None, None, None
    try:
        port = parts.port
    except ValueError:
        return "INVALID_REQUEST", None, None, None
    host = parts.hostname.lower().rstrip(".")
    usual = 443 if parts.scheme.lower() == "https" else 80
    port = port or usual
    place = host if port == usual else f"{host}:{port}"
    return None, host, port, urlunsplit((parts.scheme.lower(), place, parts.path or "/", parts.query, ""))


def test_guard_and_domain(spark):
    frame = spark.createDataFrame(list(enumerate(URLS)), "n int, url string").withColumn("d", U.domain_of(F.col("url")))
    rows = G.guard_syntax(frame).orderBy("n").collect()
    for url, row in zip(URLS, rows):
        assert (row.code, row.host, row.port, row.normalized) == plain_guard(url), url
        assert row.d == (urlsplit(url).hostname or "").lower(), url


def test_blocked_host_comes_before_the_port(spark):
    frame = spark.createDataFrame([("http://Bad.example.:x/",)], "url string")
    assert G.guard_syntax(frame, ["bad.example"]).first().code == "DOMAIN_NOT_ALLOWED"


def test_url_join(spark):
    bases = ["https://h.example/a/b?q=1#f", "http://h.example", "http://h.example/a/", ""]
    hrefs = ["/x", "/x/../y", "/x?a#b", "/x#", "x", "../x", "./x", "?q", "#f", "", "//o/y", "https://o/z", "https://o/z?", "mailto:a@b", "/a.b", "/x/.", "HTTP://O/z"]
    cases = [(base, href) for base in bases for href in hrefs]
    rows = apply(spark, cases, "base string, href string", j=U.url_join(F.col("base"), F.col("href")))
    for (base, href), row in zip(cases, rows):
        assert row.j == urljoin(base, href), (base, href)


TEXTS = ["  a \u00a0b\u3000 c\t\n", "x", "", "\u2003wide\u2009thin ", "a\x1cb\x1d c", "line\r\nnext\x85more\u2028end\x0bv\x0cf", "\u200bzero", "\n\n"]


def test_whitespace(spark):
    rows = apply(spark, TEXTS, "t string", c=X.collapse_ws(F.col("t")), s=X.strip(F.col("t")), l=X.split_lines(F.col("t")))
    for text, row in zip(TEXTS, rows):
        assert row.c == " ".join(text.split())
        assert row.s == text.strip()
        assert list(row.l) == [line for line in text.splitlines() if line.strip()]


LINES = [
    "1973－1976年　知青", "2018－　十三届全国政协副主席", "1973年8月起先后为知青，", "2014.06 副主任", "1980年-1990 书记", "1999—2001", "1999–  x",
    "1973年起任", "1973 任", "1973.8任", "1973.8月起x", "1973.123 x", "现任", "19733－1 x", "２０１４－2015 x", "2001-2002年年初", "2014年 06 x", "",
]


def plain_timeline(line):
    bounded = re.match(r"^(\d{4})年?\s*[－—–-]\s*(\d{4})?年?\s*(.+)$", line)
    if bounded:
        return f"{bounded[1]}－{bounded[2] or ''}", bounded[3].strip()
    point = re.match(r"^(\d{4}(?:[.年]\d{1,2}月?)?)(?:起|\s+)(.+)$", line)
    return (point[1], point[2].strip()) if point else None


def test_timeline(spark):
    rows = apply(spark, LINES, "l string", i=X.timeline_item(F.col("l")), t=X.timeline(F.array("l", F.lit("没有"), "l")))
    for line, row in zip(LINES, rows):
        want = plain_timeline(line)
        assert (tuple(row.i) if row.i else None) == want, line
        assert [tuple(item) for item in row.t] == [want, want] * bool(want), line


def test_profile_name(spark):
    cases = [("何小明简历", []), ("天津何小明同志简历", []), ("人物", ["x", "王小明，男，汉族", "李四，女，"]), ("", ["王小明，男"]), ("Bio", [])]
    rows = apply(spark, cases, "t string, l array<string>", name=X.profile_name(F.col("t"), F.col("l")))
    for (title, lines), row in zip(cases, rows):
        found = re.search("([\u4e00-\u9fff]{2,4})(?:同志)?简历", title)
        by_line = [match[1] for line in lines if (match := re.match("([\u4e00-\u9fff]{2,4})，(?:男|女)，", line))]
        assert row.name == (found[1] if found else (by_line or [""])[0])


@pytest.mark.parametrize("kind,charset", [("text/html; charset=GBK", "gbk"), ("text/html;charset=gb18030 ; x=1", "gb18030"), ("text/html", "utf-8"), ('a; charset="utf-8"', None), ("a; charset=nope", None), ("CHARSET=Latin-1", "latin-1")])
def test_charset_decode(spark, kind, charset):
    body = "简历 é".encode("gb18030" if charset in ("gbk", "gb18030") else "utf-8") + b"\xff"
    frame = spark.createDataFrame([(bytearray(body), kind)], "body binary, kind string")
    found = frame.select(X.decode_body(F.col("body"), X.header_charset(F.col("kind"))).alias("t")).first().t
    assert found == body.decode(charset or "utf-8", errors="replace")


def plain_key(url, mode, profile, policy, save, headers):
    kept = {}
    for name, value in headers.items():
        if name.lower() in ("authorization", "cookie", "x-api-key"):
            kept[name.lower()] = "sha256:" + hashlib.sha256(value.encode()).hexdigest()
        elif name.lower() in ("accept", "accept-language", "content-type"):
            kept[name.lower()] = value
    document = {"method": "GET", "url": url, "mode": mode, "profile": profile, "proxy_policy": policy, "headers": kept, "save_artifact": save}
    return hashlib.sha256(json.dumps(document, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_fetch_key(spark):
    cases = [
        ("https://h/", "auto", "anonymous", "auto", None, {}),
        ("https://h/", "auto", "anonymous", "auto", False, {}),
        ("https://h/", "auto", "anonymous", "auto", True, {}),
        ("https://h/", "http", "anonymous", "auto", True, {"Authorization": "s1", "X-Other": "v"}),
        ("https://h/", "http", "anonymous", "auto", True, {"Authorization": "s2", "Accept": "a\"b\\c\n\t\x01é中😀\x7f"}),
        ("https://h/é", "browser", "m", "proxy", None, {"accept-language": "zh", "Content-Type": "x", "Cookie": "c"}),
    ]
    key = H.fetch_key(*[F.col(name) for name in ("url", "mode", "profile", "policy", "save", "headers")])
    schema = "url string, mode string, profile string, policy string, save boolean, headers map<string,string>"
    rows = apply(spark, cases, schema, k=key)
    assert [row.k for row in rows] == [plain_key(*case) for case in cases]
    assert len({row.k for row in rows}) == len(cases)


def test_header_maps(spark):
    headers = {"Host": "x", "Accept": "1", "accept": "2", "SET-Cookie": "s", "X-Api-Key": "k", "Connection": "c"}
    row = apply(
        spark, [(headers,)], "h map<string,string>",
        f=H.forbidden_header(F.col("h")), r=H.redact_headers(F.col("h")), l=H.lower_header_keys(F.col("h")), c=H.content_type(F.col("h")),
    )[0]
    assert row.f == "connection"
    assert row.r == {**headers, "SET-Cookie": "[REDACTED]", "X-Api-Key": "[REDACTED]"}
    assert row.l == {"host": "x", "accept": "2", "set-cookie": "s", "x-api-key": "k", "connection": "c"}
    assert row.c == "application/octet-stream"


def test_retry_delay(spark):
    cases = {
        None: 0.5, "": 0.5, "0": 0.0, " 7 ": 7.0, "1e2": 100.0, "900": 300.0, "-5": -5.0, "soon": 0.5, "1d": 0.5,
        "Wed, 21 Oct 2026 07:28:00 GMT": 60.0, "Wed, 21 Oct 2026 06:00:00 GMT": 0.0, "Thu, 22 Oct 2026 07:28:00 GMT": 300.0,
        "Wed, 21 Oct 2026 09:28:00 +0200": 60.0, "Wed, 21 Oct 2026 07:28:00 -0000": 0.5, "Wed, 99 Oct 2026 07:28:00 GMT": 0.5,
    }
    now = F.lit("2026-10-21 07:27:00").cast("timestamp")
    rows = apply(spark, list(cases), "r string", d=T.retry_delay(F.lit(2), F.col("r"), now))
    assert {value: row.d for value, row in zip(cases, rows)} == cases


def test_jitter_stays_small(spark):
    delays = [row.d for row in spark.range(50).select(T.backoff_delay(F.lit(1), jitter=True).alias("d")).collect()]
    assert all(0.25 <= delay <= 0.35 for delay in delays) and len(set(delays)) > 1


def test_addresses(spark):
    texts = [f"{a}.{b}.{c}.{d}" for a in (0, 1, 10, 100, 127, 169, 172, 192, 198, 203, 224, 239, 240, 255) for b in (0, 16, 18, 31, 32, 51, 64, 88, 168, 254, 255) for c in (0, 2, 113) for d in (0, 9, 10, 170, 255)]
    texts += ["::1", "::", "fe80::1", "fc00::1", "2001:db8::1", "2606:4700::1111", "ff02::1", "::ffff:10.0.0.1", "64:ff9b::1", "bogus", "1.2.3", "256.1.1.1"]
    rows = apply(spark, texts, "a string", strict=A.address_allowed(F.col("a")), lax=A.address_allowed(F.col("a"), True))
    for text, row in zip(texts, rows):
        try:
            ip = ipaddress.ip_address(text)
        except ValueError:
            assert row.strict is False and row.lax is False
            continue
        basic = ip.is_loopback or ip.is_link_local or ip.is_multicast or ip.is_unspecified
        assert row.lax == (not basic), text
        assert row.strict == (not (basic or ip.is_private or ip.is_reserved)), text


def test_payloads(spark):
    cases = ['{"url":"u"}', '{"url":"u","mode":"http","save_artifact":false,"headers":{"A":"b"},"cache_ttl":0,"zzz":1}', "not json"]
    rows = apply(spark, cases, "p string", r=tables.parse_payload(F.col("p")))
    assert rows[0].r.asDict() == {
        "url": "u", "mode": "auto", "profile": "anonymous", "proxy_policy": "auto", "headers": {}, "cache_ttl": None,
        "force_refresh": False, "save_artifact": None, "timeout_seconds": None, "required_selector": None,
    }
    assert (rows[1].r.mode, rows[1].r.save_artifact, rows[1].r.headers, rows[1].r.cache_ttl) == ("http", False, {"A": "b"}, 0)
    assert rows[2].r is None or rows[2].r.url is None


def test_small_functions(spark):
    row = spark.range(1).select(
        T.elapsed_ms(F.lit(1.0), F.lit(1.0019)).alias("e"),
        T.request_id_or(F.lit("x" * 200), F.lit("f")).alias("cut"),
        T.request_id_or(F.lit(""), F.lit("f")).alias("new"),
        T.item_backoff(F.lit(1), F.lit(0)).alias("zero"),
        T.item_backoff(F.lit(3), F.lit(None)).alias("none"),
        T.item_backoff(F.lit(3), F.lit(30)).alias("given"),
        T.new_id("req").alias("id"),
        X.first_match(F.array(F.lit("a"), F.lit("bc")), lambda line: line.startswith("b")).alias("first"),
        X.first_match(F.array(F.lit("a")), lambda line: line.startswith("b")).alias("nothing"),
        X.meta_charset(F.lit("<meta CHARSET = 'GBK'>")).alias("meta"),
    ).first()
    assert (row.e, len(row.cut), row.new, row.zero, row.none, row.given) == (1, 128, "f", 2.0, 8.0, 30.0)
    assert re.fullmatch("req_[0-9a-f]{32}", row.id) and (row.first, row.nothing, row.meta) == ("bc", "", "GBK")
