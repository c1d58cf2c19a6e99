"""URL and address safety."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import addresses as A
from ..functions import urls as U
from ..plans.running import range_places
from ..session import shared_root


def within_networks(addresses: DataFrame, networks: DataFrame) -> DataFrame:
    """Addresses (``address``) of either family inside any network (``cidr``).

    The range join is an equi-join on the family and the first 16 bits: a network wider
    than that is spread over the blocks it covers, a narrower one lies in one block.
    """

    def block(value):
        return F.conv(F.hex(F.substring(value, 1, 3)), 16, 10).cast("int")

    ranges = (
        networks.select(A.cidr_bounds(F.col("cidr")).alias("net"))
        .select("net.lo", "net.hi")
        .where("lo is not null")
        .distinct()
        .withColumn("block", F.explode(F.sequence(block(F.col("lo")), block(F.col("hi")))))
    )
    numbered = addresses.withColumn("_ip", A.address_bytes(F.col("address")))
    inside = (block(numbered["_ip"]) == ranges["block"]) & numbered["_ip"].between(ranges["lo"], ranges["hi"])
    return numbered.join(ranges, inside, "left_semi").drop("_ip")


def blocked(urls: DataFrame, hosts: DataFrame) -> DataFrame:
    """URL rows whose host is on the block list (``host``)."""
    names = hosts.select(F.regexp_replace(F.lower("host"), r"\.+$", "").alias("_host")).distinct()
    return (
        urls.withColumn("_name", U.guard_host(F.col("url")))
        .join(names, F.col("_name") == F.col("_host"), "left_semi")
        .drop("_name")
    )


def addresses_sorted(addresses: DataFrame, key: str = "host") -> DataFrame:
    """Distinct addresses per host with their place in text order, one row each.

    Places come from a sort by ranges of (host, address), so a host with very many addresses is
    numbered by many tasks.
    """
    shared_root(addresses.sparkSession)
    found = addresses.select(key, "address").where(F.col(key).isNotNull() & F.col("address").isNotNull()).distinct()
    return range_places(found, [key], ["address"])


def address_verdicts(
    addresses: DataFrame,
    key: str,
    allow_private: bool = False,
    networks: DataFrame | None = None,
    allowed_hosts: list[str] | None = None,
) -> DataFrame:
    """Per key: ``n_addresses`` and ``allowed`` (every address passes)."""
    verdict = A.address_allowed(F.col("address"), allow_private)
    if allowed_hosts and "host" in addresses.columns:
        verdict = F.col("host").isin(*sorted({name.lower().rstrip(".") for name in allowed_hosts})) | verdict
    judged = addresses.withColumn("_ok", verdict)
    if networks is not None:
        trusted = within_networks(addresses.select("address").distinct(), networks).withColumn("_in", F.lit(True))
        judged = judged.join(trusted, "address", "left").withColumn(
            "_ok", F.col("_ok") | F.coalesce("_in", F.lit(False))
        )
    return judged.groupBy(key).agg(
        F.count_distinct("address").alias("n_addresses"), F.bool_and("_ok").alias("allowed")
    )


def guard_syntax(urls: DataFrame, blocked_hosts: list[str] | None = None, url: str = "url") -> DataFrame:
    """Add ``code`` (NULL = passed), ``host``, ``port`` and ``normalized`` by URL syntax.

    The first broken rule names the code. The parts of a URL are columns of their own
    between the steps, so each is computed once.
    """
    parts = F.col("_parts")
    split = urls.withColumn("_parts", U.url_parts(F.col(url))).withColumns(
        {
            "_scheme": U.scheme_of(parts=parts),
            "_host": U.guard_host(parts=parts),
            "_port": U.port_text(parts=parts),
            "_info": U.has_user_info(parts=parts),
        }
    )
    host, scheme = F.col("_host"), F.col("_scheme")
    numbered = split.withColumn("_port", U.port_number(F.col("_port"), scheme))
    known = F.coalesce(scheme.isin("http", "https"), F.lit(False))
    code = F.when(~known, "INVALID_REQUEST").when((host == "") | F.col("_info"), "INVALID_REQUEST")
    if blocked_hosts:
        names = sorted({name.lower().rstrip(".") for name in blocked_hosts})
        code = code.when(host.isin(*names), "DOMAIN_NOT_ALLOWED")
    code = code.when(F.col("_port").isNull(), "INVALID_REQUEST")
    judged = numbered.withColumn("code", code)
    passed = F.col("code").isNull()
    return judged.withColumns(
        {
            "host": F.when(passed, host),
            "port": F.when(passed, F.col("_port")),
            "normalized": F.when(passed, U.assemble(scheme, host, F.col("_port"), parts)),
        }
    ).drop("_parts", "_scheme", "_host", "_port", "_info")


def guard_urls(
    urls: DataFrame,
    addresses: DataFrame,
    key: str,
    blocked_hosts: list[str] | None = None,
    allow_private: bool = False,
    networks: DataFrame | None = None,
    allowed_hosts: list[str] | None = None,
) -> DataFrame:
    """Full verdict: syntax, block list, then resolved addresses. NULL code = allowed.

    ``addresses`` holds the recorded resolution (``key``, ``address``) of host names; ``key`` is unique in ``urls``.
    """
    checked = guard_syntax(urls, blocked_hosts)
    # a literal resolves to itself; from there on all addresses take one way
    hosts = checked.where(F.col("host").isNotNull()).select(key, "host")
    named = hosts.join(addresses.select(key, "address"), key).where(~A.is_address(F.col("host")))
    literals = hosts.where(A.is_address(F.col("host"))).withColumn("address", F.col("host"))
    verdicts = address_verdicts(named.unionByName(literals), key, allow_private, networks, allowed_hosts)
    code = (
        F.when(F.col("code").isNotNull(), F.col("code"))
        .when(F.coalesce("n_addresses", F.lit(0)) == 0, "DNS_FAILED")
        .when(~F.col("allowed"), "DOMAIN_NOT_ALLOWED")
    )
    return checked.join(verdicts, key, "left").withColumn("code", code).drop("n_addresses", "allowed")
