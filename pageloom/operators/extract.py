"""Page extraction jobs: articles, link edges, biographies.

Pages are independent rows, so each job is one pass of ``mapInArrow`` over a scan of just
the key columns, the URL and the HTML, which gives each page's elements and text pieces.
What is taken from them is said in column expressions. Nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .. import settings as S
from ..functions import elements as E
from ..functions import text as X
from ..functions import urls as U
from ..html import extract as H
from .domains import longest_rule


def page_text(pages: DataFrame) -> Column:
    """The page as text; bytes are decoded by the charset that they name, before the page reader."""
    html = F.col("html")
    if isinstance(pages.schema["html"].dataType, BinaryType):
        return X.decode_body(html, X.meta_charset(F.decode(F.substring(html, 1, 4096), "ISO-8859-1")))
    return html


def page_arrays(
    pages: DataFrame,
    keep: list[str],
    attributes: tuple[str, ...],
    tags: tuple[str, ...] | None = None,
    marks: tuple[str, ...] = (),
    base: bool = True,
    facts: tuple[str, ...] | None = None,
) -> DataFrame:
    """Kept columns with ``elements``, ``pieces``, ``body_from`` and ``empty`` of each page, one row for each.

    Elements carry the named ``attributes``, ``href`` resolved against the URL unless ``base`` is off. With ``tags`` only
    elements of these tags, or with an attribute of ``marks``, are listed. ``facts`` names the fields that
    are needed of elements and pieces, all if not given. A page without html is empty.
    """
    url = F.coalesce("url", F.lit("")) if base else F.lit("")
    narrow = pages.select(*keep, url.alias("_url"), page_text(pages).alias("_html"))
    run = H.arrays_of(attributes, None if tags is None else frozenset(tags), frozenset(marks), facts)
    return narrow.mapInArrow(run, H.arrays_schema([pages.schema[name] for name in keep], attributes, facts))


def article_extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """title, content, author, date per page; ``error`` for an empty document."""
    found = page_arrays(pages, list(keep), E.ARTICLE_ATTRIBUTES, E.ARTICLE_TAGS, E.ARTICLE_MARKS)
    fields = [F.when(~F.col("empty"), value).alias(name) for name, value in E.article().items()]
    return found.select(*keep, *fields, F.when(F.col("empty"), "PARSE_FAILED").alias("error"))


def links_extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id",), base: bool = True) -> DataFrame:
    """Edge rows (pos, text, href) in document order; relative when ``base`` is off."""
    found = page_arrays(pages, list(keep), E.LINK_ATTRIBUTES, E.LINK_TAGS, base=base)
    edge = F.transform(
        E.links(), lambda e, pos: F.struct(pos.alias("pos"), e["text"].alias("text"), e["href"].alias("href"), F.lit(None).cast("string").alias("error"))
    )
    none = F.lit(None).cast("string")
    failed = F.array(F.struct(F.lit(-1).alias("pos"), none.alias("text"), none.alias("href"), F.lit("PARSE_FAILED").alias("error")))
    # the list of edges is made first, so that no row of it carries the page's arrays
    rows = found.select(*keep, F.explode(F.when(F.col("empty"), failed).otherwise(edge)).alias("_edge"))
    return rows.select(*keep, "_edge.pos", "_edge.text", "_edge.href", "_edge.error")


def profile_extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id",), base: bool = True) -> DataFrame:
    """Biography per page: name, title, summary, current position and timeline.

    The container, its paragraphs and the fields are all chosen by column expressions; ``error`` marks
    pages without text, or with neither summary nor timeline.
    """
    url = F.coalesce("url", F.lit("")) if base else F.lit("")
    found = page_arrays(
        pages.withColumn("source_url", url), [*keep, "source_url"], E.PROFILE_ATTRIBUTES, E.PROFILE_TAGS, E.PROFILE_MARKS, base, E.PROFILE_FACTS
    )
    # the selectors are many values: they are named behind the reader, which has no use for them
    found = found.withColumn("_host", U.domain_of(F.col("source_url"))).withColumn("_selectors", E.container_selectors(F.col("_host")))
    return profile_fields(profile_lines(found), list(keep))


def profile_lines(found: DataFrame) -> DataFrame:
    """Add ``title`` and ``lines`` to the arrays of pages that hold ``_selectors``."""
    shown = ~F.col("empty") & F.col("_selectors").isNotNull()
    lines = X.profile_lines(E.profile_texts(F.col("_selectors")))
    return found.withColumns(
        {
            "title": F.when(shown, E.profile_title()),
            "lines": F.coalesce(F.when(shown, lines), F.array().cast("array<string>")),
        }
    )


def profile_fields(lines: DataFrame, keep: list[str]) -> DataFrame:
    """The fields read from a title and the page's lines."""
    all_lines = F.col("lines")
    named = lines.withColumn("name", X.profile_name(F.coalesce("title", F.lit("")), all_lines))
    opening = F.concat(F.col("name"), F.lit("，"))
    filled = named.withColumns(
        {
            "summary": F.when(
                F.col("name") != "", X.first_match(all_lines, lambda line: line.startswith(opening))
            ).otherwise(""),
            "current_position": X.first_match(all_lines, lambda line: line.startswith("现任")),
            "timeline": X.timeline(all_lines),
            "source_host": U.domain_of(F.col("source_url")),
        }
    )
    empty = (F.size("lines") == 0) | ((F.col("summary") == "") & (F.size("timeline") == 0))
    return filled.select(
        *keep,
        "name",
        "title",
        "summary",
        "current_position",
        "timeline",
        "source_url",
        "source_host",
        F.when(empty, "PARSE_FAILED").alias("error"),
    )


def schema_check(extracted: DataFrame) -> DataFrame:
    """Add ``failed``: rows whose key fields are missing. Write by it to split good rows from bad in one pass."""
    return extracted.withColumn("failed", F.col("error").isNotNull())


def known_sites(spark: SparkSession) -> DataFrame:
    """The biography sites that the library knows, as a table that a user can add to."""
    return spark.createDataFrame([(domain, list(selectors)) for domain, selectors in S.PROFILE_SITES], "domain string, selectors array<string>")


def site_selectors(hosts: DataFrame, sites: DataFrame) -> DataFrame:
    """Rows with ``host`` plus the selectors of the site it belongs to (NULL = none).

    ``sites``: domain, selectors. Of nested sites the one of the longest domain counts.
    """
    return longest_rule(hosts, sites.select("domain", "selectors")).withColumn("selectors", F.col("rule.selectors")).drop("rule")


def largest_container(nodes: DataFrame) -> DataFrame:
    """Per page the node with the longest text; the first one on ties (ord ascending)."""
    return nodes.groupBy("page_id").agg(
        F.max_by("text", F.struct(F.length("text"), -F.col("ord"))).alias("text"),
        F.max(F.length("text")).alias("n_chars"),
    )
