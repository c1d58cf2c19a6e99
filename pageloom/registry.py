"""Extraction adapters by name and version, and extraction requests with their results."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import elements as C
from .functions import urls as U
from .operators import extract as E

PROFILE_FIELDS = ("name", "title", "summary", "current_position", "timeline", "source_url", "source_host")


@dataclass(frozen=True)
class Adapter:
    """How an adapter makes a document of a page: ``document()`` gives the struct that becomes its JSON.

    It chooses from the columns ``elements``, ``pieces`` and ``body_from`` of the page (see
    ``functions/elements.py``); ``attributes`` are those that it needs of the elements. With
    ``profile`` it is a biography, whose fields column expressions read from its lines.
    """

    document: Callable[[], Column] | None = None
    attributes: tuple[str, ...] = ()
    profile: bool = False


def _article() -> Column:
    return F.struct(*[value.alias(name) for name, value in C.article().items()])


def _links() -> Column:
    return F.struct(C.links().alias("links"))


class Adapters:
    """Registered adapters; ``latest`` is the numerically highest version."""

    def __init__(self) -> None:
        self._known: dict[tuple[str, str], Adapter] = {}
        self.register("generic.article", "1", Adapter(_article, C.ARTICLE_ATTRIBUTES))
        self.register("generic.links", "1", Adapter(_links, C.LINK_ATTRIBUTES))
        self.register("china.official-profile", "1", Adapter(attributes=C.PROFILE_ATTRIBUTES, profile=True))

    def register(self, name: str, version: str, adapter: Adapter) -> None:
        self._known[(name, version)] = adapter

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(sorted(self._known), "name string, version string")

    def items(self):
        return sorted(self._known.items())


def read_pages(pages: DataFrame, adapters: Adapters) -> DataFrame:
    """``source_id, base, adapter, version, data, error``: one document for each wanted adapter of a page.

    ``pages``: source_id, base, html, wanted (array of name and version). Each page is parsed
    once, whatever is asked of it. A page without content, or whose key fields are missing,
    gives PARSE_FAILED.
    """
    known = adapters.items()

    def asked(name: str, version: str) -> Column:
        return F.exists("wanted", lambda w: (w["name"] == name) & (w["version"] == version))

    biographies = [asked(*key) for key, adapter in known if adapter.profile]
    located = pages.withColumns({"url": F.col("base"), "source_url": F.col("base"), "_host": U.domain_of(F.col("base"))})
    selectors = C.container_selectors(F.col("_host"))
    located = located.withColumn("_selectors", F.when(reduce(or_, biographies, F.lit(False)), selectors))
    attributes = tuple(dict.fromkeys(name for _, adapter in known for name in adapter.attributes))
    found = E.page_arrays(located, ["source_id", "base", "wanted", "source_url", "_selectors"], attributes)
    arrays = ["source_id", "base", "wanted", "elements", "pieces", "body_from", "empty"]
    filled = E.profile_fields(E.profile_lines(found), arrays)
    biography = F.to_json(F.struct(*PROFILE_FIELDS), {"ignoreNullFields": "false"})

    def made(name: str, version: str, adapter: Adapter) -> Column:
        document = biography if adapter.profile else F.to_json(adapter.document(), {"ignoreNullFields": "false"})
        failed = F.col("error") if adapter.profile else F.when(F.col("empty"), "PARSE_FAILED")
        fields = F.struct(
            F.lit(name).alias("adapter"), F.lit(version).alias("version"), F.when(failed.isNull(), document).alias("data"), failed.alias("error")
        )
        return F.when(asked(name, version), fields)

    # the documents are made first, so that no row of them carries the page's arrays
    documents = F.array_compact(F.array(*[made(*key, adapter) for key, adapter in known]))
    return filled.select("source_id", "base", F.explode(documents).alias("_made")).select("source_id", "base", "_made.*")


def resolve(requests: DataFrame, adapters: DataFrame) -> DataFrame:
    """Add ``resolved_version`` and ``error`` to rows with (adapter, adapter_version)."""
    latest = adapters.groupBy("name").agg(F.max(F.col("version").cast("int")).cast("string").alias("_latest"))
    wanted = F.when(F.col("adapter_version") == "latest", F.col("_latest")).otherwise(F.col("adapter_version"))
    known = adapters.select(F.col("name").alias("_name"), F.col("version").alias("_version"))
    asked = requests.join(latest, F.col("adapter") == latest["name"], "left").withColumn("_wanted", wanted).drop("name")
    return (
        asked.join(known, (F.col("adapter") == F.col("_name")) & (F.col("_wanted") == F.col("_version")), "left")
        .withColumn("resolved_version", F.col("_version"))
        .withColumn("error", F.when(F.col("_version").isNull(), "ADAPTER_NOT_FOUND"))
        .drop("_latest", "_wanted", "_name", "_version")
    )


def extract_join(requests: DataFrame, artifacts: DataFrame, adapters: Adapters) -> DataFrame:
    """Extraction requests with their results: one row for each request.

    ``requests``: request_id, url, artifact_id, adapter, adapter_version.
    ``artifacts``: artifact_id, url, body and, where a url has several, saved_at. Exactly one of url and artifact_id names
    the page. An artifact is read without a base URL, so its links stay relative.
    """
    from .operators.requests import extract_xor

    spark = requests.sparkSession
    checked = requests.withColumn("_xor", extract_xor(F.col("url"), F.col("artifact_id")))
    resolved = resolve(checked, adapters.table(spark)).withColumn("error", F.coalesce("_xor", "error")).drop("_xor")
    # one list of needed pages: by artifact id, or the newest artifact of the url
    newest = F.max_by("artifact_id", "saved_at") if "saved_at" in artifacts.columns else F.max("artifact_id")
    by_url = artifacts.groupBy("url").agg(newest.alias("_by_url"))
    located = (
        resolved.join(by_url, "url", "left")
        .withColumn("_given", F.nullif("artifact_id", F.lit("")))
        .withColumn("source_id", F.coalesce("_given", "_by_url"))
        .withColumn("_base", F.when(F.col("_given").isNull(), F.col("url")).otherwise(""))
    )
    ids = artifacts.select(F.col("artifact_id").alias("_id"))
    located = (
        located.join(ids, F.col("source_id") == F.col("_id"), "left")
        .withColumn("error", F.coalesce("error", F.when(F.col("_id").isNull(), "ARTIFACT_NOT_FOUND")))
        .drop("_id", "_by_url", "_given")
    )
    good = located.where(F.col("error").isNull())
    # what is asked of a page, together: its body is joined and parsed once
    wanted = good.groupBy("source_id", F.col("_base").alias("base")).agg(
        F.sort_array(F.collect_set(F.struct(F.col("adapter").alias("name"), F.col("resolved_version").alias("version")))).alias("wanted")
    )
    pages = wanted.join(artifacts.select(F.col("artifact_id").alias("source_id"), F.col("body").alias("html")), "source_id")
    results = read_pages(pages, adapters).select(
        "source_id", F.col("base").alias("_base"), "adapter", F.col("version").alias("resolved_version"), "data", F.col("error").alias("_failed")
    )
    answered = good.join(results, ["source_id", "_base", "adapter", "resolved_version"], "left")
    columns = ["request_id", "adapter", F.col("resolved_version").alias("adapter_version"), F.col("source_id").alias("artifact_id")]
    failed = located.where(F.col("error").isNotNull()).select(
        *columns, F.lit(None).cast("string").alias("data"), "error"
    )
    return answered.select(*columns, "data", F.col("_failed").alias("error")).unionByName(failed)
