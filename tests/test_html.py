"""Reading single pages."""

from __future__ import annotations

import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pageloom.functions import elements as C
from pageloom.html.extract import arrays_of, joiner
from pageloom.html.parse import Page, compile_selector, has_match
from pageloom.operators import extract as E


def page(spark, html, url=""):
    return spark.createDataFrame([(1, url, html)], "page_id int, url string, html string")


@pytest.fixture
def article(spark):
    return lambda html: E.article_extract(page(spark, html)).select("title", "content", "author", "date").first()


def links(spark, html, url):
    return [tuple(row) for row in E.links_extract(page(spark, html, url)).orderBy("pos").select("text", "href").collect()]


def texts(spark, html, host):
    asked = page(spark, html).withColumn("_selectors", C.container_selectors(F.lit(host)))
    found = E.page_arrays(asked, ["_selectors"], C.PROFILE_ATTRIBUTES)
    return tuple(found.select(C.profile_title(), C.profile_texts(F.col("_selectors"))).first())


def test_article_fields_and_links(spark, article):
    html = (
        "<!doctype html><head><meta content='Bo Vinter' name=author><title>Harbour notes - daily</title></head>"
        "<body><header>Sections</header><main><h1>Tides this week</h1><ol><li>High at six</li><li>Low at noon</li></ol>"
        '<footer>imprint</footer>See <a href="../charts?day=2">the charts</a>.</main></body>'
    )
    assert article(html) == ("Tides this week", "Tides this weekHigh at sixLow at noonSee the charts.", "Bo Vinter", "")
    assert links(spark, html, "https://port.example/news/today") == [("the charts", "https://port.example/charts?day=2")]


def test_text_around_dropped_parts_is_one_piece(article):
    assert article("<h1>A<script>x</script>B</h1>")[0] == "AB"
    assert article("<h1>A</q>B</h1>")[0] == "AB"
    assert article("<h1>A<!-- c -->B</h1>")[0] == "A"
    assert article("<h1>A<i>q</i>B</h1>")[0] == "A"


@pytest.mark.parametrize("unit", ["<b>x</i>", "<i rel=author>x", "<p>x", "<time>", '<div class="text"><p>x</p>', "<h1>x", "<title>x</title>"])
def test_choices_end_on_long_pages(spark, unit):
    html = unit * (300_000 // len(unit))
    began = time.perf_counter()
    fields = E.article_extract(page(spark, html)).first()
    assert fields.error is None and texts(spark, html, "x.example")[1]
    assert time.perf_counter() - began < 60


@pytest.mark.parametrize(
    "unit",
    ["<a ", '<p title="x>y ', '<a ">" ', "<b>x</i>", '<div class="text"><p>x</p>', '<div class="text">x', "<", "<!-", "<!x", "<h1>x", "<a a   ="],
)
def test_time_grows_with_the_page(unit):
    def seconds(size):
        html = unit * (size // len(unit))
        best = 1e9
        for _ in range(2):
            began = time.process_time()
            batch = pa.RecordBatch.from_pydict({"_url": ["http://h.example/"], "_html": [html]})
            list(arrays_of(("class", "href"), None, frozenset())([batch]))
            has_match(html, "article h1 b")
            best = min(best, time.process_time() - began)
        return best

    small, large = seconds(125_000), seconds(1_000_000)
    assert large < 6 and (large < 0.5 or large < 24 * small)


def test_no_separator_at_tags_and_collapsed_blanks(article):
    assert article("<body><p>A</p><p>B</p>\n　 <p>C D</p></body>")[1] == "AB C D"


def test_pruned_subtrees_keep_the_text_behind_them(article):
    assert article("<body>a<script>x</script>b<footer>f</footer>c<noscript>n</noscript>d</body>")[1] == "abcd"


def test_container_order(article):
    assert article("<body>x<main>m</main><article>a</article></body>")[1] == "a"
    assert article("<body>x<main>m</main></body>")[1] == "m"
    assert article("<title>T</title><p>root")[1] == "root"
    assert article("<body><nav><article>hidden</article></nav>rest</body>")[1] == "rest"


def test_title_falls_back_when_the_first_heading_text_is_blank(article):
    assert article("<title> T </title><body><h1>\n<span>x</span></h1></body>")[0] == "T"
    assert article("<body><h1><span>in</span> out</h1></body>")[0] == "in"


def test_author_and_date_by_document_order(article):
    assert article('<body><a rel="author">Bob</a><meta name="author" content="Al"></body>')[2] == "Bob"
    assert article('<meta name="author" content=""><body><a rel="author">Bob</a></body>')[2] == ""
    assert article('<body><time datetime="2020-01-01">x</time><meta property="article:published_time" content="2019">')[3] == "2020-01-01"
    assert article('<body><nav><time datetime="no">x</time></nav><time datetime="yes">y</time>')[3] == "yes"
    assert article("<body><time>no attribute</time>")[3] == ""


def test_markup_noise(article):
    html = '<body><!-- <h1>no</h1> --><p title="a > b">1 < 2 &amp; 3<br>4<script>var t="</p><b>";</script></body>'
    assert article(html)[1] == "1 < 2 & 34"
    assert article("<body><article><p>one<p><b>two</article>after</body>")[1] == "onetwo"
    assert article("<p>open <a href='x")[1].startswith("open")


def test_empty_documents():
    for html in ("", "  \n", "<!-- only -->", "<!DOCTYPE html>"):
        assert Page(html).empty
    assert not Page("text").empty


def test_links_keep_everything(spark):
    html = '<nav><a href="/n">n</a></nav><a>none</a><a href="#f">f</a><a href="mailto:a@b.c">m</a><a href="#f">f</a><a href>e</a>'
    found = links(spark, html, "https://h.example/a/b?q=1")
    assert [href for _, href in found] == [
        "https://h.example/n",
        "https://h.example/a/b?q=1#f",
        "mailto:a@b.c",
        "https://h.example/a/b?q=1#f",
        "https://h.example/a/b?q=1",
    ]
    assert links(spark, '<a href="x/y">t</a>', "") == [("t", "x/y")]


def test_link_joins_agree_with_the_general_rule():
    from urllib.parse import urljoin

    for base in ("https://H.example:8/a/b/?q#f", "http://h.example", ""):
        join = joiner(base)
        for href in ("/x", "/x/../y", "/x?a=1#b", "/x#", "/x?", "/./x", "//o/y", "/a.b/c", "/ x", "z", ""):
            assert join(href) == urljoin(base, href), (base, href)


def test_selectors():
    html = '<div class="a b" id="i"><p><em class="c">x</em></p></div>'
    for selector in ("div", ".a", ".a.b", "#i", "div.a em", "div p .c", "table, em", "*"):
        assert has_match(html, selector) == "present", selector
    for selector in ("table", ".z", "#j", "p div", "em.a"):
        assert has_match(html, selector) == "missing", selector
    for selector in ("a[href]", "p > em", "p:first-child", "p + em"):
        assert has_match(html, selector) == "unsupported", selector
    assert has_match("", "p") == "unparsable"
    assert compile_selector("") is None


def test_profile_container_choice(spark):
    html = "<title>人物</title><div class=con>短</div><div class=con><p>长一些的正文</p></div><article>别处</article>"
    assert texts(spark, html, "www.cppcc.gov.cn") == ("人物", ["长一些的正文"])
    assert texts(spark, html, "notcppcc.gov.cn") == ("人物", ["别处"])
    assert texts(spark, "<div id=detail>细<script>x</script>节</div>", "news.cn")[1] == ["细节"]


def test_bytes_name_their_charset(spark):
    from pageloom.operators.extract import article_extract

    pages = ['<meta charset="gbk"><p>简历</p>'.encode("gbk"), "<p>é</p>".encode(), b"<meta charset=nope><p>x</p>"]
    frame = spark.createDataFrame([(n, "http://x/", bytearray(p)) for n, p in enumerate(pages)], "page_id int, url string, html binary")
    assert [row.content for row in article_extract(frame).orderBy("page_id").collect()] == ["简历", "é", "x"]


def test_a_slice_of_pages_keeps_its_rows(spark, monkeypatch):
    """Pages are sent on in slices by the length of their texts; no row is lost or exchanged."""
    monkeypatch.setattr("pageloom.html.extract.SLICE_CHARS", 20)
    run = arrays_of((), None, frozenset())
    texts_ = ["", "<p>ab</p>", "x" * 50, None, "<b>c</b>" * 4, "d"]
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(6)), "_url": [""] * 6, "_html": texts_})
    made = list(run([batch]))
    rows = [row for part in made for row in part.to_pylist()]
    assert len(made) > 1 and [row["page_id"] for row in rows] == list(range(6))
    assert ["".join(piece["text"] for piece in row["pieces"]) for row in rows] == ["", "ab", "x" * 50, "", "cccc", "d"]
    assert [row["empty"] for row in rows] == [True, False, False, True, False, False]


def test_choices_agree_with_a_walk_over_the_page(spark):
    """Random pages: title, container text and links against a walk over the reader's own lists."""
    import random

    tags = ["p", "b", "h1", "main", "article", "nav", "script", "title", "i rel=author", "a href=/x", "time datetime=1"]
    chance = random.Random(5)
    htmls = []
    for _ in range(120):
        parts = [chance.choice(["t", " ", "u v", "<!-- -->", "</q>", *[f"<{t}>" for t in tags], *[f"</{t.split()[0]}>" for t in tags]]) for _ in range(30)]
        htmls.append("".join(part + str(n) if part in "tu v" and part.strip() else part for n, part in enumerate(parts)))
    frame = spark.createDataFrame(list(enumerate(htmls)), "page_id int, html string").withColumn("url", F.lit(""))
    found = {row.page_id: row for row in E.article_extract(frame).collect()}
    edges: dict[int, list] = {}
    for row in E.links_extract(frame).orderBy("page_id", "pos").collect():
        edges.setdefault(row.page_id, []).append(row.text)
    for number, html in enumerate(htmls):
        walked = Page(html)
        if walked.empty:
            assert found[number].error == "PARSE_FAILED"
            continue
        live = [e for e in walked.elements if not e.pruned]
        box = next((e for tag in ("article", "main", "body") for e in live if e.tag == tag), None)
        start, stop = (box.start, box.stop) if box else (walked.body_from or 0, len(walked.texts))
        shown = [at for at in range(start, stop) if walked.parents[at] is None or not walked.parents[at].pruned]
        assert found[number].content == " ".join("".join(walked.texts[at] for at in shown).split()), html
        anchors = [e for e in walked.elements if e.tag == "a"]
        assert edges.get(number, []) == [" ".join("".join(walked.texts[e.start : e.stop]).split()) for e in anchors], html
        heads, seen = [], set()
        for e in live:
            if e.tag == "h1" and e.parent not in seen:
                heads.append(e)
            if e.tag == "h1":
                seen.add(e.parent)
        begin = next((at for e in heads for at in range(e.start, e.stop) if walked.parents[at] is None or not walked.parents[at].pruned), None)
        if begin is not None and walked.texts[begin].strip():
            assert found[number].title.startswith(walked.texts[begin].strip().split()[0]), html


def test_the_reader_sends_only_the_facts_that_are_asked_for(spark):
    """A biography needs neither the other facts of a page nor its selectors carried through the reader."""
    html = "<title>t</title><div class='x y'><b>a</b><p>one</p><script>s</script></div><p>two</p>"
    found = E.page_arrays(page(spark, html), [], C.PROFILE_ATTRIBUTES, C.PROFILE_TAGS, C.PROFILE_MARKS, facts=C.PROFILE_FACTS)
    assert found.schema["pieces"].dataType.elementType.names == ["at", "tag", "dropped", "text"]
    row = found.first()
    assert [(e.tag, e.at, e["class"]) for e in row.elements] == [("div", 1, "x y"), ("p", 3, None), ("p", 5, None)]
    assert texts(spark, html, "x.example")[1] == ["one", "two"]
    plan = E.profile_extract(page(spark, html, "http://www.news.cn/"))._jdf.queryExecution().optimizedPlan().toString()
    reader = next(line for line in plan.splitlines() if "MapInArrow" in line)
    assert "_selectors" not in reader


def test_profile_pages_are_dealt_out_before_they_are_read(spark, data):
    """schema_check read all pages of a file of few row groups in as few tasks."""
    from pageloom.catalog import QUERIES

    plan = QUERIES["schema_check"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan[plan.index("MapInArrow"):]


def test_classes_between_any_blanks(spark):
    html = "<div class='　a  text\tb'><p>held</p></div><p class=text2>out</p>"
    assert texts(spark, html, "x.example")[1] == ["held"]
