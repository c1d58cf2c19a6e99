"""URL functions that stay inside codegen.

One regular expression takes a URL apart; everything else works on its parts. Each
function takes the URL, or the parts made before by :func:`url_parts`: put these in a
column of their own where several functions read the same URL.
"""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# scheme, user information, host (in brackets or plain), port, path, query
_SHAPE = (
    r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?"
    r"(?://(?:([^/?#]*)@)?(?:[^/?#@\[]*\[([^/?#@\]]*)\]?[^/?#@:]*|([^/?#@:\[]*))(?::([^/?#@]*))?)?"
    r"([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
)


def url_parts(url: Column) -> Column:
    """Array of scheme, user information, host, port text, path and query, by one expression."""
    # tabs and line ends do not count in a URL, so a line end can divide the parts
    plain = F.translate(url, "\t\r\n", "")
    return F.split(F.regexp_replace(plain, _SHAPE, "$1\n$2\n$3$4\n$5\n$6\n$7"), "\n")


def _parts(url: Column | None, parts: Column | None) -> Column:
    return url_parts(url) if parts is None else parts


def scheme_of(url: Column | None = None, parts: Column | None = None) -> Column:
    return F.lower(_parts(url, parts)[0])


def has_user_info(url: Column | None = None, parts: Column | None = None) -> Column:
    return ~_parts(url, parts)[1].isin("", ":")


def domain_of(url: Column | None = None, parts: Column | None = None) -> Column:
    """Lower-case host name, or an empty string."""
    return F.coalesce(F.lower(_parts(url, parts)[2]), F.lit(""))


def port_text(url: Column | None = None, parts: Column | None = None) -> Column:
    """What stands where the port belongs; empty when there is none."""
    return _parts(url, parts)[3]


def port_number(text: Column, scheme: Column) -> Column:
    """Port from its text, or the scheme's; NULL when the text is no valid port."""
    # no text and zero both mean the usual port; a leading zero makes "" a number
    number = F.when(text.rlike("^[0-9]*$"), F.concat(F.lit("0"), text)).try_cast("int")
    usual = F.when(scheme == "https", 443).otherwise(80)
    return F.when(number == 0, usual).when(number <= 65535, number)


def port_of(url: Column | None = None, parts: Column | None = None) -> Column:
    """Explicit port or the scheme's; NULL when the port is no valid number."""
    return port_number(port_text(url, parts), scheme_of(url, parts))


def guard_host(url: Column | None = None, parts: Column | None = None) -> Column:
    return F.regexp_replace(domain_of(url, parts), r"\.+$", "")


def assemble(scheme: Column, host: Column, port: Column, parts: Column) -> Column:
    """``scheme://host[:port]path?query``: default port and fragment dropped."""
    usual = ((scheme == "https") & (port == 443)) | ((scheme == "http") & (port == 80))
    return F.concat(
        scheme,
        F.lit("://"),
        host,
        F.when(usual, "").otherwise(F.concat(F.lit(":"), port.cast("string"))),
        F.when(parts[4] == "", "/").otherwise(parts[4]),
        F.when(parts[5] != "", F.concat(F.lit("?"), parts[5])).otherwise(""),
    )


def url_canonical(url: Column) -> Column:
    """The URL as typed requests hold it: lower-case scheme and host, no default port, a path; the rest is kept.

    What is no http or https URL stays as it is.
    """
    parts = url_parts(url)
    scheme, host, port = scheme_of(parts=parts), domain_of(parts=parts), port_of(parts=parts)
    info = F.when(parts[1] != "", F.concat(parts[1], F.lit("@"))).otherwise("")
    fragment = F.regexp_extract(url, r"(?s)^[^#]*(#.*)$", 1)
    known = F.coalesce(scheme.isin("http", "https") & (host != "") & port.isNotNull(), F.lit(False))
    bracketed = F.when(host.contains(":"), F.concat(F.lit("["), host, F.lit("]"))).otherwise(host)
    return F.when(known, F.concat(assemble(scheme, F.concat(info, bracketed), port, parts), fragment)).otherwise(url)


def url_normalize(url: Column) -> Column:
    parts = url_parts(url)
    return assemble(scheme_of(parts=parts), guard_host(parts=parts), port_of(parts=parts), parts)


def with_normalized(df: DataFrame, url: str, name: str) -> DataFrame:
    """Add the normalised URL. Its parts are columns of their own on the way, so each is computed once."""
    split = df.withColumn("_url_parts", url_parts(F.col(url)))
    parts = F.col("_url_parts")
    pieces = {"_url_scheme": scheme_of(parts=parts), "_url_host": guard_host(parts=parts), "_url_port": port_of(parts=parts)}
    made = split.withColumns(pieces).withColumn(name, assemble(F.col("_url_scheme"), F.col("_url_host"), F.col("_url_port"), parts))
    return made.drop("_url_parts", *pieces)


@F.pandas_udf(T.StringType())
def _join_general(base: pd.Series, href: pd.Series) -> pd.Series:
    def one(b, h):
        if h is None:
            return None
        try:
            return urljoin(b or "", h)
        except ValueError:
            return h

    return pd.Series([one(b, h) for b, h in zip(base, href)], dtype=object)


def url_join(base: Column, href: Column) -> Column:
    """Resolve a reference against its base; an empty base leaves it as it is.

    Absolute references and rooted paths without dot segments are resolved in the
    JVM; Python sees only the rest (the others are sent as NULL).
    """
    tidy = ~href.rlike(r"[?#]$|\?#|[\t\r\n]|^[\x00-\x20]")
    absolute = tidy & href.rlike(r"^https?://[^/?#]")
    rooted = tidy & href.rlike(r"^/(?!/)") & ~href.rlike(r"(^|/)\.\.?(/|$|[?#])") & base.rlike(r"^https?://[^/?#]")
    origin = F.regexp_replace(base, r"(?s)^(https?://[^/?#]+).*$", "$1")
    easy = F.coalesce(absolute | rooted, F.lit(False))
    general = _join_general(F.when(~easy, base), F.when(~easy, href))
    return (
        F.when(F.coalesce(base, F.lit("")) == "", href)
        .when(absolute, href)
        .when(rooted, F.concat(origin, href))
        .otherwise(general)
    )
