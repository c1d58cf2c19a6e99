"""Registration of queries and oracle texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import fixtures

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, *views: str, sql: str | None = None, recursive: bool = False, oracle_views: tuple[str, ...] | None = None):
    """Register ``fn(spark, root)``; the named derived views exist when it runs."""

    def add(fn: Query) -> Query:
        def run(spark: SparkSession, root: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            fixtures.register(spark, root, *views)
            return fn(spark, root)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = fixtures.with_views(sql, *(views if oracle_views is None else oracle_views), recursive=recursive)
        return fn

    return add


# SQL texts used by several oracles
DOMAIN = "lower(regexp_extract(url, '^https?://([^/?#:]+)', 1))"
SPACE = r"[\s\x{00A0}\x{3000}]"


def unescape(text: str) -> str:
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        text = f"replace({text}, '{name}', '{char}')"
    return text
