"""What an extraction takes from a page: choices among its elements and text pieces.

The functions work on the columns ``elements``, ``pieces`` and ``body_from`` that
:func:`pageloom.operators.extract.page_arrays` makes of a page. Each one reads the
arrays a fixed number of times.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import settings as S
from ..html.parse import compile_selector
from . import text as X

#: What the choices need of a page: elements of which tags or with which attributes, and which attributes.
ARTICLE_TAGS, ARTICLE_MARKS = ("title", "h1", "meta", "time", "article", "main", "body"), ("rel",)
ARTICLE_ATTRIBUTES = ("rel", "name", "property", "content", "datetime")
LINK_TAGS, LINK_ATTRIBUTES = ("a",), ("href",)
PROFILE_ATTRIBUTES = PROFILE_MARKS = ("class", "id")
_CONTAINERS = [*S.PROFILE_FALLBACK, *(name for _, own in S.PROFILE_SITES for name in own)]
#: Tags that name a container without a class or an id; None stands for any.
_BARE = {tag for name in _CONTAINERS for group in compile_selector(name) or () for tag, classes, ids in group if not classes and not ids}
PROFILE_TAGS = None if None in _BARE else ("h1", "p", *sorted(_BARE))
PROFILE_FACTS = ("tag", "at", "start", "stop", "last", "dropped", "chars", "text")


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, also where ``use`` needs it within a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def text_between(start: Column, stop: Column, hidden: str | None = None) -> Column:
    """Text of a range of pieces; ``hidden`` names the flag of the pieces that are left out."""
    part = F.slice(F.col("pieces"), start + 1, stop - start)
    shown = part if hidden is None else F.filter(part, lambda piece: ~piece[hidden])
    return F.array_join(shown["text"], "")


def _run_text(run: Column) -> Column:
    """Text of one run of pieces, or an empty string without a run."""
    found = bind(run, lambda wanted: F.filter("pieces", lambda piece: (piece["run"] == wanted) & ~piece["pruned"])["text"])
    return F.array_join(F.coalesce(found, F.array().cast("array<string>")), "")


def live(fits: Callable[[Column], Column]) -> Column:
    """Elements outside pruned subtrees that fit."""
    return F.filter("elements", lambda element: ~element["pruned"] & F.coalesce(fits(element), F.lit(False)))


def first_children(elements: Column) -> Column:
    """Of elements of one kind, those that are the first one below their parent."""
    placed = F.sort_array(F.transform(elements, lambda e: F.struct(e["parent"].alias("parent"), e["at"].alias("at"), e.alias("element"))))

    def leads(ordered: Column) -> Column:
        return F.filter(ordered, lambda e, i: F.coalesce(F.get(ordered, i - 1)["parent"] != e["parent"], F.lit(True)))["element"]

    return bind(placed, leads)


def _earliest(*choices: Column) -> Column:
    """Text of the choice that comes first in the page: a run of pieces, or a value of its own."""
    best = F.array_min(F.concat(*choices))
    return X.strip(bind(best, lambda choice: F.when(choice["value"].isNotNull(), choice["value"]).otherwise(_run_text(choice["run"]))))


def _by_run(elements: Column) -> Column:
    """Choices by the first text below each element."""
    shown = F.filter(elements, lambda e: e["first"].isNotNull())
    return F.transform(shown, lambda e: F.struct(e["at"].alias("at"), e["first"].alias("run"), F.lit(None).cast("string").alias("value")))


def _by_value(elements: Column, attribute: str) -> Column:
    """Choices by an attribute of each element."""
    given = F.filter(elements, lambda e: e[attribute].isNotNull())
    return F.transform(given, lambda e: F.struct(e["at"].alias("at"), F.lit(None).cast("int").alias("run"), e[attribute].alias("value")))


def article() -> dict[str, Column]:
    """title, content, author and date; empty where the page has none."""
    # the first title that has text of its own, and the first such text
    titles = F.filter("pieces", lambda piece: F.coalesce(piece["tag"] == "title", F.lit(False)) & ~piece["pruned"])
    first_title = F.array_min(F.transform(titles, lambda p: F.struct(p["parent"].alias("parent"), p["run"].alias("run"))))["run"]
    heading = _earliest(_by_run(first_children(live(lambda e: e["tag"] == "h1"))))
    title = X.strip(_run_text(first_title))
    author = _earliest(
        _by_run(first_children(live(lambda e: e["rel"] == "author"))),
        _by_value(live(lambda e: (e["tag"] == "meta") & (e["name"] == "author")), "content"),
    )
    date = _earliest(
        _by_value(first_children(live(lambda e: e["tag"] == "time")), "datetime"),
        _by_value(live(lambda e: (e["tag"] == "meta") & (e["property"] == "article:published_time")), "content"),
    )
    containers = [F.get(live(lambda e, tag=tag: e["tag"] == tag), F.lit(0)) for tag in ("article", "main", "body")]
    whole = F.struct(F.coalesce("body_from", F.lit(0)).alias("start"), F.size("pieces").alias("stop"))
    ranges = [F.when(c.isNotNull(), F.struct(c["start"].alias("start"), c["stop"].alias("stop"))) for c in containers]
    content = bind(F.coalesce(*ranges, whole), lambda r: X.collapse_ws(text_between(r["start"], r["stop"], "pruned")))
    none = F.lit("")
    return {
        "title": bind(F.coalesce(heading, none), lambda h: F.when(h != "", h).otherwise(F.coalesce(title, none))),
        "content": F.coalesce(content, none),
        "author": F.coalesce(author, none),
        "date": F.coalesce(date, none),
    }


def links() -> Column:
    """Text and target of every anchor with a target, in document order."""
    anchors = F.filter("elements", lambda e: (e["tag"] == "a") & e["href"].isNotNull())
    return F.transform(
        anchors, lambda e: F.struct(X.collapse_ws(text_between(e["start"], e["stop"])).alias("text"), e["href"].alias("href"))
    )


def _selector(name: str, own: bool) -> Column:
    groups = compile_selector(name)
    if groups is None or any(len(compounds) != 1 for compounds in groups):
        raise ValueError(f"a container is named by tags, classes and ids, not by {name!r}")

    def names(values: set[str]) -> Column:
        return F.array(*[F.lit(value) for value in sorted(values)]).cast("array<string>")

    fits = [
        F.struct(F.lit(tag).cast("string").alias("tag"), names(classes).alias("classes"), names(ids).alias("ids"))
        for ((tag, classes, ids),) in groups
    ]
    return F.struct(F.lit(own).alias("own"), F.array(*fits).alias("fits"))


def container_selectors(host: Column) -> Column:
    """Where a host's biographies stand: the site's own selectors before the common ones."""
    common = [_selector(name, False) for name in S.PROFILE_FALLBACK]
    found = F.array(*common)
    for domain, own in reversed(S.PROFILE_SITES):
        below = (host == domain) | host.endswith(f".{domain}")
        found = F.when(below, F.array(*[_selector(name, True) for name in own], *common)).otherwise(found)
    return found


def _fits(element: Column, compound: Column) -> Column:
    by_tag = compound["tag"].isNull() | (compound["tag"] == element["tag"])
    by_class = (F.size(compound["classes"]) == 0) | F.coalesce(F.size(F.array_except(compound["classes"], element["classes"])) == 0, F.lit(False))
    by_id = (F.size(compound["ids"]) == 0) | (compound["ids"] == F.array(element["id"]))
    return by_tag & by_class & F.coalesce(by_id, F.lit(False))


def profile_title() -> Column:
    """The first text that stands in a title or below an h1."""
    titles = F.filter("pieces", lambda piece: F.coalesce(piece["tag"] == "title", F.lit(False)))["at"]
    headings = F.filter("elements", lambda e: (e["tag"] == "h1") & (e["start"] < e["stop"]))["start"]
    place = F.array_min(F.concat(titles, headings))
    return F.coalesce(X.collapse_ws(bind(place, lambda at: F.get(F.col("pieces"), at)["text"])), F.lit(""))


def profile_texts(selectors: Column) -> Column:
    """The raw texts of the biography's paragraphs, or its whole text.

    Every match of every selector is ranked once: first by the selector's place in the list,
    then a site's own by the longest text, then by place in the document.
    """

    def box(e: Column, place: Column, size: Column) -> Column:
        return F.struct(place.alias("place"), size.alias("size"), *[e[name].alias(name) for name in ("at", "start", "stop", "last")])

    # only elements that a container's name can fit are looked at, and their classes are told apart once for all selectors
    bare = F.lit(True) if None in _BARE else F.lit(False)

    def named(e: Column) -> Column:
        return bare | e["class"].isNotNull() | e["id"].isNotNull() | e["tag"].isin(*sorted(_BARE - {None}))

    marked = F.transform(F.filter("elements", named), lambda e: e.withField("classes", F.when(e["class"].isNotNull(), X.split_all(e["class"], f"{X.BLANK}+", " "))))

    def matches(elements: Column, selector: Column, place: Column) -> Column:
        found = F.filter(elements, lambda e: F.exists(selector["fits"], lambda compound: _fits(e, compound)))
        return F.transform(found, lambda e: box(e, place, F.when(selector["own"], -e["chars"]).otherwise(0)))

    page = F.struct(F.lit(-1).alias("at"), F.lit(0).alias("start"), F.size("pieces").alias("stop"), F.lit(2**31 - 1).alias("last"))
    found = bind(marked, lambda elements: F.flatten(F.transform(selectors, lambda selector, place: matches(elements, selector, place))))
    best = F.coalesce(F.array_min(found), box(page, F.lit(0), F.lit(0)))

    def texts(box: Column) -> Column:
        paragraphs = F.filter(
            "elements", lambda e: (e["tag"] == "p") & ~e["dropped"] & (e["at"] > box["at"]) & (e["at"] <= box["last"])
        )
        split = F.transform(paragraphs, lambda e: text_between(e["start"], e["stop"], "dropped"))
        return bind(split, lambda parts: F.when(F.size(parts) > 0, parts).otherwise(F.array(text_between(box["start"], box["stop"], "dropped"))))

    return bind(best, texts)
