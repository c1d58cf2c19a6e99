"""IP address classes."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import settings as S

_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_V4 = rf"^{_OCTET}(\.{_OCTET}){{3}}\z"


def _as_int(dotted: str) -> int:
    return int(ipaddress.IPv4Address(dotted))


def is_ipv4(address: Column) -> Column:
    return address.rlike(_V4)


def ipv4_number(address: Column) -> Column:
    """Dotted address as BIGINT, NULL for anything else."""
    octets = F.transform(F.split(address, r"\."), lambda octet: octet.try_cast("bigint"))
    return F.when(is_ipv4(address), F.aggregate(octets, F.lit(0).cast("bigint"), lambda sofar, octet: sofar * 256 + octet))


def _merged(ranges) -> list[tuple[int, int]]:
    """The ranges as numbers, in order; touching and overlapping ones are one."""
    out: list[tuple[int, int]] = []
    for first, last in sorted((_as_int(first), _as_int(last)) for first, last in ranges):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def _within(number: Column, ranges) -> Column:
    """Whether the number is in one of the ranges. The number is bound once, however many ranges there are."""

    def tested(value: Column) -> Column:
        hit = F.lit(False)
        for first, last in _merged(ranges):
            hit = hit | value.between(first, last)
        return hit

    return F.transform(F.array(number), tested)[0]


def _v6_rule(allow_private: bool):
    @F.pandas_udf(T.BooleanType())
    def allowed(address: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return None
            try:
                ip = ipaddress.ip_address(text)
            except ValueError:
                return False
            denied = ip.is_loopback or ip.is_link_local or ip.is_multicast or ip.is_unspecified
            if not allow_private:
                denied = denied or ip.is_private or ip.is_reserved
            return not denied

        return pd.Series([one(text) for text in address], dtype=object)

    return allowed


def address_allowed(address: Column, allow_private: bool = False) -> Column:
    """May a fetch connect to this address? Allow-lists are applied by the caller.

    IPv4 is range arithmetic in the JVM; only other texts go to Python.
    """
    number = ipv4_number(address)
    ranges = S.LOOPBACK_V4 + S.LINK_LOCAL_V4 + S.MULTICAST_V4 + S.UNSPECIFIED_V4
    if not allow_private:
        ranges += S.PRIVATE_V4 + S.RESERVED_V4
    other = _v6_rule(allow_private)(F.when(~is_ipv4(address), address))
    return F.coalesce(~_within(number, ranges), other)


@F.pandas_udf(T.BinaryType())
def _v6_bytes(address: pd.Series) -> pd.Series:
    def one(text):
        try:
            return None if text is None else ipaddress.IPv6Address(text).packed
        except ValueError:
            return None

    return pd.Series([one(text) for text in address], dtype=object)


def address_bytes(address: Column) -> Column:
    """Family (4 or 6) and address as bytes, so that ranges of either family compare; NULL for anything else.

    IPv4 stays in the JVM; only texts with a colon go to Python.
    """
    v4 = F.unhex(F.concat(F.lit("04"), F.lpad(F.hex(ipv4_number(address)), 8, "0")))
    v6 = _v6_bytes(F.when(address.contains(":"), address))
    return F.when(is_ipv4(address), v4).when(v6.isNotNull(), F.concat(F.unhex(F.lit("06")), v6))


def is_address(host: Column) -> Column:
    """A host that is an address literal and its own resolution."""
    return F.coalesce(address_bytes(host).isNotNull(), F.lit(False))


@F.pandas_udf(T.StructType([T.StructField("lo", T.BinaryType()), T.StructField("hi", T.BinaryType())]))
def cidr_bounds(cidr: pd.Series) -> pd.DataFrame:
    """First and last address of a network of either family, as :func:`address_bytes` writes them.

    A text that is no network has no bounds. Networks are configuration, so few.
    """
    rows = []
    for text in cidr:
        try:
            net = ipaddress.ip_network(text, strict=False)
        except ValueError:
            rows.append((None, None))
            continue
        family = bytes([net.version])
        rows.append((family + net[0].packed, family + net[-1].packed))
    return pd.DataFrame(rows, columns=["lo", "hi"])
