"""Limits, defaults and lookup values shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Results depend on them being exactly these.
# ---------------------------------------------------------------------------
MODES = ("auto", "http", "browser")
PROXY_POLICIES = ("auto", "direct", "proxy")
PRIORITIES = ("low", "normal", "high")
TERMINAL_STATES = ("succeeded", "failed", "cancelled")

PROFILE_PATTERN = r"^[a-zA-Z0-9_.-]+\z"
MAX_CACHE_TTL = 2_592_000
MAX_BATCH = 1000

FORBIDDEN_HEADERS = ("connection", "content-length", "host", "proxy-authorization")
REDACTED_HEADERS = ("authorization", "cookie", "proxy-authorization", "set-cookie", "x-api-key")
KEY_DIGEST_HEADERS = ("authorization", "cookie", "x-api-key")
KEY_PLAIN_HEADERS = ("accept", "accept-language", "content-type")

RETRYABLE_STATUS = (408, 425, 429, 500, 502, 503, 504)
REDIRECT_STATUS = (301, 302, 303, 307, 308)
TRANSPORT_ERRORS = ("READ_TIMEOUT", "CONNECT_FAILED")
UPGRADE_STATUS = (403, 429, 503)
CHALLENGE_MARKERS = ("enable javascript", "javascript is required", "cf-chl-", "just a moment...")

DEFAULT_CONTENT_TYPE = "application/octet-stream"
HISTOGRAM_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)

# code, HTTP status, retryable
ERRORS = (
    ("INVALID_REQUEST", 422, False),
    ("AUTHENTICATION_FAILED", 401, False),
    ("DOMAIN_NOT_ALLOWED", 403, False),
    ("DNS_FAILED", 502, True),
    ("READ_TIMEOUT", 504, True),
    ("CONNECT_FAILED", 504, True),
    ("REDIRECT_LOOP", 502, False),
    ("TOO_MANY_REDIRECTS", 502, False),
    ("RESPONSE_TOO_LARGE", 413, False),
    ("BROWSER_UNAVAILABLE", 503, False),
    ("BROWSER_FAILED", 502, True),
    ("PARSE_FAILED", 422, False),
    ("ADAPTER_NOT_FOUND", 404, False),
    ("ARTIFACT_NOT_FOUND", 404, False),
    ("JOB_NOT_FOUND", 404, False),
    ("QUEUE_UNAVAILABLE", 503, True),
    ("STORAGE_UNAVAILABLE", 503, False),
    ("INTERNAL_ERROR", 500, True),
)

# IPv4 ranges per address class (first, last)
LOOPBACK_V4 = (("127.0.0.0", "127.255.255.255"),)
LINK_LOCAL_V4 = (("169.254.0.0", "169.254.255.255"),)
MULTICAST_V4 = (("224.0.0.0", "239.255.255.255"),)
UNSPECIFIED_V4 = (("0.0.0.0", "0.0.0.0"),)
RESERVED_V4 = (("240.0.0.0", "255.255.255.255"),)
PRIVATE_V4 = (
    ("0.0.0.0", "0.255.255.255"),
    ("10.0.0.0", "10.255.255.255"),
    ("127.0.0.0", "127.255.255.255"),
    ("169.254.0.0", "169.254.255.255"),
    ("172.16.0.0", "172.31.255.255"),
    ("192.0.0.0", "192.0.0.8"),
    ("192.0.0.11", "192.0.0.255"),
    ("192.0.2.0", "192.0.2.255"),
    ("192.168.0.0", "192.168.255.255"),
    ("198.18.0.0", "198.19.255.255"),
    ("198.51.100.0", "198.51.100.255"),
    ("203.0.113.0", "203.0.113.255"),
    ("240.0.0.0", "255.255.255.255"),
)

# biography sites: domain and its container selectors, in order of preference
PROFILE_SITES = (
    ("cppcc.gov.cn", (".con", ".cnt_box")),
    ("people.com.cn", (".p_content", ".rm_txt_con", ".text_con")),
    ("news.cn", ("#detail", ".main-aticle", ".xl-main-content", ".article")),
)
PROFILE_FALLBACK = ("article", "main", ".content", ".text")

# fixed values: biography line patterns (Java syntax)
BOUNDED_PERIOD = r"(?U)^(\d{4})(?:年)?\s*[－—–-]\s*(\d{4})?年?\s*(.+)$"
POINT_PERIOD = r"(?U)^(\d{4}(?:[.年]\d{1,2}(?:月)?)?)(?:起|\s+)(.+)$"
TITLE_NAME = r"([\u4e00-\u9fff]{2,4})(?:同志)?简历"
LINE_NAME = r"^([\u4e00-\u9fff]{2,4})，(?:男|女)，"

# retention by record class, in days
RETENTION_DAYS = {"success": 180, "failure": 90, "raw": 30, "evidence": 90, "audit": 365}


@dataclass(frozen=True)
class Limits:
    """Default knobs; pass a changed copy to an operator to override."""

    max_attempts: int = 3
    max_redirects: int = 10
    max_body_bytes: int = 10_485_760
    cache_ttl: int = 3600
    cache_entries: int = 1024
    domain_interval_us: int = 1_000_000
    domain_concurrency: int = 4
    min_html_chars: int = 300
    retry_base_seconds: float = 0.25
    retry_cap_seconds: float = 300.0
    lease_seconds: int = 120
    tmp_age_seconds: int = 3600


DEFAULTS = Limits()
