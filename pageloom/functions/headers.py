"""Header map functions and the fetch key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import settings as S


def _lowered_entries(headers: Column) -> Column:
    """Entries with lower-case keys; of equal keys the last one is kept."""
    lowered = F.transform(
        F.map_entries(headers), lambda entry: F.struct(F.lower(entry["key"]).alias("key"), entry["value"].alias("value"))
    )

    def last_of_key(entry: Column, index: Column) -> Column:
        later = F.slice(lowered, index + 2, F.size(lowered) + 1)
        return ~F.exists(later, lambda other: other["key"] == entry["key"])

    return F.filter(lowered, last_of_key)


def lower_header_keys(headers: Column) -> Column:
    return F.map_from_entries(_lowered_entries(headers))


def forbidden_header(headers: Column) -> Column:
    """Alphabetically first header a caller may not set, or NULL."""
    names = F.transform(F.map_keys(headers), lambda name: F.lower(name))
    return F.array_min(F.array_intersect(names, F.array(*[F.lit(name) for name in S.FORBIDDEN_HEADERS])))


def redact_headers(headers: Column) -> Column:
    return F.transform_values(
        headers, lambda name, value: F.when(F.lower(name).isin(*S.REDACTED_HEADERS), "[REDACTED]").otherwise(value)
    )


def header_digest(value: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(value, 256))


def content_type(headers: Column) -> Column:
    return F.coalesce(F.try_element_at(headers, F.lit("content-type")), F.lit(S.DEFAULT_CONTENT_TYPE))


def _unit_escape(code: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(code), 4, "0")))


def _json_char(char: Column) -> Column:
    point = F.ascii(char)
    above = point - 0x10000
    pair = F.concat(
        _unit_escape(F.lit(0xD800) + F.floor(above / 1024)), _unit_escape(F.lit(0xDC00) + F.pmod(above, F.lit(1024)))
    )
    return (
        F.when(char == '"', '\\"')
        .when(char == "\\", "\\\\")
        .when(char == "\n", "\\n")
        .when(char == "\r", "\\r")
        .when(char == "\t", "\\t")
        .when(char == "\b", "\\b")
        .when(char == "\f", "\\f")
        .when(point > 0xFFFF, pair)
        .when((point < 32) | (point > 126), _unit_escape(point))
        .otherwise(char)
    )


def json_string(text: Column) -> Column:
    """ASCII JSON string literal; plain text takes the short way."""
    escaped = F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), 0), _json_char), "")
    odd = text.rlike(r'[^\x20-\x7e]|["\\]')
    return F.concat(F.lit('"'), F.when(odd, escaped).otherwise(text), F.lit('"'))


def key_headers_json(headers: Column) -> Column:
    """The headers that change a response, as sorted JSON; secrets only as digests."""
    kept = F.filter(
        _lowered_entries(headers), lambda entry: entry["key"].isin(*S.KEY_DIGEST_HEADERS, *S.KEY_PLAIN_HEADERS)
    )
    parts = F.transform(
        F.array_sort(kept),
        lambda entry: F.concat(
            json_string(entry["key"]),
            F.lit(":"),
            json_string(
                F.when(entry["key"].isin(*S.KEY_DIGEST_HEADERS), header_digest(entry["value"])).otherwise(
                    entry["value"]
                )
            ),
        ),
    )
    return F.concat(F.lit("{"), F.coalesce(F.array_join(parts, ","), F.lit("")), F.lit("}"))


def fetch_key(
    url: Column, mode: Column, profile: Column, proxy_policy: Column, save_artifact: Column, headers: Column | None = None
) -> Column:
    """SHA-256 of the request's canonical JSON; ``save_artifact`` has three values."""
    fields = [
        ("headers", F.lit("{}") if headers is None else key_headers_json(headers)),
        ("method", F.lit('"GET"')),
        ("mode", json_string(mode)),
        ("profile", json_string(profile)),
        ("proxy_policy", json_string(proxy_policy)),
        ("save_artifact", F.coalesce(save_artifact.cast("string"), F.lit("null"))),
        ("url", json_string(url)),
    ]
    parts: list[Column] = []
    for position, (name, value) in enumerate(fields):
        parts += [F.lit(("{" if position == 0 else ",") + f'"{name}":'), value]
    return F.sha2(F.concat(*parts, F.lit("}")), 256)
