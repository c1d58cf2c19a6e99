"""Page extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import extract as E
from ..operators import fetchlog as L
from ..registry import Adapters, extract_join, read_pages, resolve
from ..sources.fixtures import VIEWS
from .book import SPACE, query, unescape
from .lake import lake, now

_BODY = "regexp_extract(html, '(?s)<article>(.*?)</article>', 1)"
_BARE = (
    f"regexp_replace(regexp_replace(regexp_replace({_BODY}, '(?s)<!--.*?-->', '', 'g'), "
    "'(?s)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '<[^>]*>', '', 'g')"
)
_ARTICLE_TITLE = f"trim({unescape(f'regexp_extract({_BODY}, $$<h1>([^<]*)$$, 1)')})"
_ARTICLE = f"trim(regexp_replace({unescape(_BARE)}, '{SPACE}+', ' ', 'g'))"


@query(
    "article_extract",
    sql=f"SELECT page_id, {_ARTICLE_TITLE} AS title, {_ARTICLE} AS content, '' AS author, '' AS date FROM pages",
)
def article_extract(spark, root):
    return E.article_extract(spark.table("pages")).select("page_id", "title", "content", "author", "date")


_LINKS = f"""SELECT page_id, CAST(pos - 1 AS INTEGER) AS pos, trim(regexp_replace({unescape('text')}, '{SPACE}+', ' ', 'g')) AS text,
 concat(regexp_extract(url, '^(https?://[^/]+)', 1), {unescape('href')}) AS href
FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS href,
 unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS text,
 unnest(range(1, 1 + len(regexp_extract_all(html, '<a href="([^"]*)">', 1)))) AS pos FROM pages)"""


@query("links_extract", sql=_LINKS)
def links_extract(spark, root):
    return E.links_extract(spark.table("pages")).select("page_id", "pos", "text", "href")


# what a biography line says, by the shape of the test lines
_PERIOD = """CASE line_id % 6 WHEN 0 THEN concat(1950 + line_id % 60, '－', 1955 + line_id % 60) WHEN 1 THEN concat(1990 + line_id % 30, '－')
 WHEN 2 THEN concat(1973 + line_id % 30, '年8月') WHEN 3 THEN '2014.06' WHEN 4 THEN '1980－1990' END"""
_POSITION = """CASE line_id % 6 WHEN 0 THEN concat('职务', o_custkey) WHEN 1 THEN concat('委员', o_custkey) WHEN 2 THEN concat('先后任', o_custkey)
 WHEN 3 THEN concat('主任', o_custkey) WHEN 4 THEN concat('书记', o_custkey) END"""
_LINE = "(SELECT o_orderkey AS line_id, o_custkey FROM orders)"


@query("timeline_parse", "f_timeline_lines", sql=f"SELECT line_id, {_PERIOD} AS period, {_POSITION} AS position FROM {_LINE}")
def timeline_parse(spark, root):
    return spark.table("f_timeline_lines").withColumn("item", X.timeline_item(F.col("line"))).select(
        "line_id", "item.period", "item.position"
    )


def profile_pages(spark):
    """The pages are made up from the rows of one file; the narrow rows are dealt out before."""
    lines = spark.table("f_timeline_lines").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "line_id")
    lines.createOrReplaceTempView("f_timeline_lines")
    return spark.sql(VIEWS["f_profile_pages"])


_PERSON = "CASE line_id % 3 WHEN 0 THEN '张三' WHEN 1 THEN '王小明' ELSE '欧阳文华' END"


@query(
    "profile_extract",
    "f_profile_pages",
    sql=f"""SELECT line_id AS page_id, CASE WHEN bad THEN '' ELSE {_PERSON} END AS name,
 CASE WHEN NOT bad AND line_id % 5 = 0 THEN concat({_PERSON}, CASE line_id % 3 WHEN 0 THEN '简历' ELSE '同志简历' END) ELSE '人物' END AS title,
 CASE WHEN bad THEN '' ELSE concat({_PERSON}, '，男，汉族。') END AS summary,
 CASE WHEN bad THEN '' ELSE concat('现任职务', line_id) END AS current_position,
 CASE WHEN NOT bad AND {_PERIOD} IS NOT NULL THEN concat({_PERIOD}, '=', {_POSITION}) ELSE '' END AS timeline,
 CASE line_id % 4 WHEN 0 THEN 'www.cppcc.gov.cn' WHEN 1 THEN 'finance.people.com.cn' WHEN 2 THEN 'www.news.cn' ELSE 'other.example.org' END AS source_host,
 CASE WHEN bad THEN 'PARSE_FAILED' END AS error
FROM (SELECT *, line_id % 7 = 0 AS bad FROM {_LINE})""",
)
def profile_extract(spark, root):
    found = E.profile_extract(profile_pages(spark))
    entries = F.transform("timeline", lambda e: F.concat(e["period"], F.lit("="), e["position"]))
    return found.select(
        "page_id",
        "name",
        "title",
        "summary",
        "current_position",
        F.array_join(entries, "|").alias("timeline"),
        "source_host",
        "error",
    )


@query(
    "profile_lines",
    sql=rf"""SELECT doc_id, array_to_string(list_filter(l, lambda x, i: x <> '' AND list_position(l, x) = i), '|') AS lines
FROM (SELECT doc_id, list_transform(string_split_regex(concat(text, chr(10), '  x', chr(12288), 'y ', chr(10), text), '[\n\r\v\f]'),
 lambda x: trim(regexp_replace(x, '{SPACE}+', ' ', 'g'))) AS l FROM documents)""",
)
def profile_lines(spark, root):
    texts = F.array("text", F.lit("  x　y "), "text")
    return spark.table("documents").select("doc_id", F.array_join(X.profile_lines(texts), "|").alias("lines"))


@query(
    "profile_name",
    "f_timeline_lines",
    sql=f"SELECT line_id, CASE line_id % 4 WHEN 3 THEN '' ELSE {_PERSON} END AS name FROM {_LINE}",
)
def profile_name(spark, root):
    person = F.expr(_PERSON)
    kind = F.col("line_id") % 4
    honoured = (kind == 0) & (F.length(person) > 2)
    title = F.when(honoured, F.concat(person, F.lit("同志简历"))).when(kind < 2, F.concat(person, F.lit("简历"))).otherwise("")
    line = F.when(kind == 2, F.concat(person, F.lit("，女，汉族"))).otherwise(F.lit("李四，男"))
    return spark.table("f_timeline_lines").select(
        "line_id", X.profile_name(title, F.array("line", line)).alias("name")
    )


@query(
    "selector_present",
    sql="""SELECT page_id, CASE page_id % 5 WHEN 0 THEN CASE WHEN regexp_matches(html, '<article>\\s*<h1') THEN 'present' ELSE 'missing' END
 WHEN 1 THEN 'missing' WHEN 2 THEN CASE WHEN html LIKE '%<div class="ad">%' THEN 'present' ELSE 'missing' END
 WHEN 3 THEN 'unsupported' WHEN 4 THEN CASE WHEN html LIKE '%<li><a href%' THEN 'present' ELSE 'missing' END END AS verdict FROM pages""",
)
def selector_present(spark, root):
    names = ["article h1", "#missing", "div.ad", "a[href]", "nav ul li a"]
    selector = F.element_at(F.array(*[F.lit(name) for name in names]), (F.col("page_id") % 5 + 1).cast("int"))
    return spark.table("pages").select("page_id", L.selector_present(F.col("html"), selector).alias("verdict"))


@query(
    "schema_check",
    "f_profile_pages",
    sql=f"""SELECT line_id % 7 = 0 AS failed, count(*) AS pages FROM {_LINE} GROUP BY 1""",
)
def schema_check(spark, root):
    checked = E.schema_check(E.profile_extract(profile_pages(spark)))
    return checked.groupBy("failed").agg(F.count("*").alias("pages"))


_NODES = """SELECT line_id - line_id % 8 AS page_id, line_id % 8 AS ord, line AS text FROM f_timeline_lines"""


@query(
    "largest_container",
    "f_timeline_lines",
    sql=f"""SELECT page_id, text, length(text) AS n_chars FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length(text) DESC, ord) AS rn
FROM ({_NODES})) WHERE rn = 1""",
)
def largest_container(spark, root):
    return E.largest_container(spark.sql(_NODES)).select("page_id", "text", F.col("n_chars").cast("bigint"))


_ASKED = """SELECT page_id AS request_id, CASE WHEN page_id % 4 = 1 THEN '' ELSE url END AS url,
 CASE WHEN page_id % 4 IN (1, 2) THEN concat('art_', md5(CAST(page_id AS VARCHAR(20)))) WHEN page_id % 4 = 3 THEN NULL END AS artifact_id,
 CASE page_id % 5 WHEN 0 THEN 'generic.links' WHEN 1 THEN 'china.official-profile' WHEN 2 THEN 'no.such' ELSE 'generic.article' END AS adapter,
 CASE page_id % 3 WHEN 0 THEN '1' WHEN 1 THEN 'latest' ELSE CASE WHEN page_id % 2 = 0 THEN '9' ELSE '1' END END AS adapter_version FROM pages"""
# some of the addresses and artifacts were never stored
_LOST = f"""SELECT request_id, CASE WHEN request_id % 7 = 3 AND url <> '' THEN concat(url, '#lost') ELSE url END AS url,
 CASE WHEN request_id % 7 = 3 AND artifact_id IS NOT NULL THEN concat(artifact_id, '0') ELSE artifact_id END AS artifact_id, adapter, adapter_version FROM ({_ASKED})"""
_MISSING = "adapter = 'no.such' OR adapter_version = '9'"


@query(
    "adapter_resolve",
    sql=f"""SELECT request_id, CASE WHEN {_MISSING} THEN NULL ELSE '1' END AS resolved_version,
 CASE WHEN {_MISSING} THEN 'ADAPTER_NOT_FOUND' END AS error FROM ({_ASKED})""",
)
def adapter_resolve(spark, root):
    return resolve(spark.sql(_ASKED), Adapters().table(spark)).select("request_id", "resolved_version", "error")


# documents as the adapters write them
_ARTICLE_DOC = f"""CAST(json_object('title', {_ARTICLE_TITLE}, 'content', {_ARTICLE}, 'author', '', 'date', '') AS VARCHAR)"""
_LINK_TEXT = f"trim(regexp_replace({unescape('m.text')}, '{SPACE}+', ' ', 'g'))"
_LINKS_DOC = f"""(SELECT CAST(json_object('links', to_json(coalesce(list({{'text': {_LINK_TEXT}, 'href': concat(base_of, {unescape('m.href')})}} ORDER BY m.at), []))) AS VARCHAR) FROM
 (SELECT unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS href, unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS text,
  unnest(range(len(regexp_extract_all(html, '<a href="')))) AS at) m)"""


@query(
    "extract_join",
    sql=f"""WITH q AS (SELECT a.*, p.html, a.request_id % 4 AS kind, CASE WHEN a.request_id % 4 = 1 THEN '' ELSE regexp_extract(p.url, '^(https?://[^/]+)', 1) END AS base_of,
  concat('art_', md5(CAST(p.page_id AS VARCHAR))) AS own FROM ({_LOST}) a JOIN pages p ON p.page_id = a.request_id),
e AS (SELECT *, CASE WHEN kind = 2 THEN 'INVALID_REQUEST' WHEN {_MISSING} THEN 'ADAPTER_NOT_FOUND' WHEN request_id % 7 = 3 THEN 'ARTIFACT_NOT_FOUND'
  WHEN adapter = 'china.official-profile' THEN 'PARSE_FAILED' END AS error FROM q)
SELECT request_id, adapter, CASE WHEN {_MISSING} THEN NULL ELSE '1' END AS adapter_version, error,
 CASE WHEN error IS NULL THEN CASE adapter WHEN 'generic.links' THEN {_LINKS_DOC} ELSE {_ARTICLE_DOC} END END AS data FROM e""",
)
def extract_join_query(spark, root):
    """Every seventh request names an address or an artifact that was never stored; some pages were stored more than once."""
    pages = spark.table("pages").select(
        F.concat(F.lit("art_"), F.md5(F.col("page_id").cast("string"))).alias("artifact_id"), F.col("page_id").alias("artifact_no"), "url", F.col("html").alias("body"),
        F.lit("text/html").alias("content_type"), now().alias("saved_at"),
    )
    return extract_join(spark.sql(_LOST), lake(spark, pages), Adapters()).select("request_id", "adapter", "adapter_version", "error", "data")


@query(
    "adapter_registry",
    sql="""SELECT 'generic.article' AS adapter, count(*) AS documents, 0 AS errors, 0 AS links FROM pages UNION ALL
SELECT 'generic.links', count(*), 0, CAST(sum(len(regexp_extract_all(html, '<a href="'))) AS BIGINT) FROM pages UNION ALL
SELECT 'china.official-profile', count(*), count(*), 0 FROM pages""",
)
def adapter_registry(spark, root):
    """All registered adapters over all pages, each parsed once."""
    known = Adapters()
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(version).alias("version")) for (name, version), _ in known.items()])
    pages = spark.table("pages").select(F.col("page_id").alias("source_id"), F.col("url").alias("base"), "html", wanted.alias("wanted"))
    found = read_pages(pages, known)
    links = F.size(F.from_json("data", "links array<struct<href:string>>")["links"])
    return found.groupBy("adapter").agg(
        F.count("*").alias("documents"), F.count_if(F.col("error").isNotNull()).alias("errors"),
        F.sum(F.greatest(F.when(F.col("adapter") == "generic.links", F.coalesce(links, F.lit(0))).otherwise(0), F.lit(0))).alias("links"),
    )
