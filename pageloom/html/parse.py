"""A flat view of an HTML page: elements and text pieces in document order.

An element knows the range of text pieces and of elements below it, so the text of any
element is a slice; no tree is built. The page is read once from front to back, and no
step looks further back or ahead than it moves on, so time grows with the page. Used
inside Arrow tasks, one page at a time; what an extraction takes from the page is chosen by
column functions (``functions/elements.py``).
"""

from __future__ import annotations

import re
from functools import cached_property, lru_cache
from html import unescape
from itertools import accumulate
from operator import attrgetter

# Void elements, subtrees without article text, and which open element
# a start tag closes when it stands directly inside it.
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
PRUNED = frozenset("script style noscript nav footer".split())
DROPPED = frozenset("script style noscript".split())
HEAD_ONLY = frozenset("html head title meta link script style base noscript".split())
_BLOCKS = frozenset(
    "address blockquote center dd div dl dt fieldset form h1 h2 h3 h4 h5 h6 hr li ol p pre table tbody td tfoot th"
    " thead tr ul".split()
)
CLOSED_BY = {
    "p": _BLOCKS,
    "a": frozenset({"a", "fieldset", "table", "td", "th"}),
    "b": frozenset({"center", "p", "td", "th"}),
    "li": frozenset({"li"}),
    "dt": frozenset({"dd", "dt"}),
    "dd": frozenset({"dd", "dt"}),
    "option": frozenset({"optgroup", "option"}),
    "td": frozenset({"tbody", "td", "tfoot", "th", "tr"}),
    "th": frozenset({"tbody", "td", "tfoot", "th", "tr"}),
    "tr": frozenset({"tbody", "tfoot", "tr"}),
    "head": frozenset({"a", "abbr", "article", "b", "body", "br", "form", "main", "section", "span"}) | _BLOCKS,
}


_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*+")
# a name and what follows it up to the ">" that ends the tag; quoted attribute values may hide others
_TAG = re.compile(rf"""({_NAME.pattern})([^>=]*+(?:=\s*+(?:"[^"]*+"|'[^']*+')?+[^>=]*+)*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_RAW_END = {tag: re.compile(f"</{tag}(?=[\\s/>])", re.IGNORECASE) for tag in ("script", "style")}


class Element:
    __slots__ = ("tag", "raw", "parent", "start", "stop", "pruned", "dropped", "index", "last", "_attrs")

    def __init__(self, tag, raw, parent, start, index):
        self.tag, self.raw, self.parent = tag, raw, parent
        self.start = self.stop = start
        self.pruned = tag in PRUNED or (parent is not None and parent.pruned)
        self.dropped = tag in DROPPED or (parent is not None and parent.dropped)
        self.index = index
        self.last = index  # the last element below it
        self._attrs = None

    @property
    def attrs(self) -> dict[str, str]:
        """Attributes, read when first asked for; of equal names the first counts."""
        if self._attrs is None:
            self._attrs = {}
            for match in _ATTRIBUTE.finditer(self.raw):
                name, *quoted = match.groups()
                value = next((text for text in quoted if text is not None), "")
                self._attrs.setdefault(name.lower(), unescape(value))
        return self._attrs


class Page:
    def __init__(self, html: str):
        self.elements: list[Element] = []
        self.texts: list[str] = []
        self.parents: list[Element | None] = []
        # elements started before each text piece, and whether a comment stands right before it
        self.after: list[int] = []
        self.broken: list[bool] = []
        self.body_from: int | None = None
        self._open: list[Element] = []
        self._names: dict[str, int] = {}  # how often each tag is open
        self._comment = False
        self._glue = False
        self._read(html)
        while self._open:
            self._close_top()

    @property
    def empty(self) -> bool:
        return not self.elements and not any(text.strip() for text in self.texts)

    def _read(self, html: str):
        at, size = 0, len(html)
        last_end = html.rfind(">")  # behind it nothing can be a tag
        text_from = at
        while (open_ := html.find("<", at)) != -1 and open_ < last_end:
            mark = html[open_ + 1]
            if mark == "!" and html.startswith("<!--", open_):
                stop = html.find("-->", open_ + 4)
                self._text(html[text_from:open_])
                self._comment = True
                at = text_from = size if stop == -1 else stop + 3
                continue
            if mark == "!" or mark == "?":
                self._text(html[text_from:open_])
                self._comment = True
                at = text_from = html.find(">", open_) + 1
                continue
            found = _TAG.match(html, open_ + 1)
            if found is None:
                if _NAME.match(html, open_ + 1):  # unterminated: the rest is text
                    break
                at = open_ + 1
                continue
            if open_ > text_from:
                self._text(html[text_from:open_])
            at = text_from = found.end()
            tag, raw = found.groups()
            tag = tag.lower()
            if tag[0] == "/":
                self._end(tag[1:])
                continue
            self._start(tag, raw)
            if raw.endswith("/") and tag not in VOID:
                self._close_top()
            elif tag in _RAW_END:
                end = _RAW_END[tag].search(html, at)
                stop = end.start() if end else size
                self._text(html[at:stop], plain=True)
                at = text_from = stop
        self._text(html[text_from:])

    def _start(self, tag: str, raw: str):
        while self._open and tag in CLOSED_BY.get(self._open[-1].tag, ()):
            self._close_top()
        parent = self._open[-1] if self._open else None
        element = Element(tag, raw, parent, len(self.texts), len(self.elements))
        self.elements.append(element)
        self._glue = False
        if self.body_from is None and tag not in HEAD_ONLY:
            self.body_from = len(self.texts)
        if tag not in VOID:
            self._open.append(element)
            self._names[tag] = self._names.get(tag, 0) + 1

    def _end(self, tag: str):
        if not self._names.get(tag):
            # an unknown end tag does not part the text around it
            self._glue = bool(self.texts) and not self._comment and self.parents[-1] is (self._open[-1] if self._open else None) and self.after[-1] == len(self.elements)
            return
        while self._close_top().tag != tag:
            pass

    def _close_top(self) -> Element:
        element = self._open.pop()
        element.stop = len(self.texts)
        element.last = len(self.elements) - 1
        self._names[element.tag] -= 1
        self._glue = False
        return element

    def _text(self, text: str, plain: bool = False):
        if not text:
            return
        if "&" in text and not plain:
            text = unescape(text)
        parent = self._open[-1] if self._open else None
        if self.body_from is None and (parent is None or parent.tag in ("html", "head")) and text.strip():
            self.body_from = len(self.texts)
        if self._glue:
            self._glue = False
            self.texts[-1] += text
            return
        self.texts.append(text)
        self.parents.append(parent)
        self.after.append(len(self.elements))
        self.broken.append(self._comment)
        self._comment = False

    # -- what stands where ----------------------------------------------------
    def element_facts(self, name: str, elements: list[Element]):
        """One fact of each element: its place, range or flag, its first text that is not pruned, or its length."""
        if name == "parent":
            return [-1 if e.parent is None else e.parent.index for e in elements]
        if name == "chars":
            chars = [0, *accumulate(map(len, self.texts))]
            return [chars[e.stop] - chars[e.start] for e in elements]
        if name == "first":
            shown = len(self.texts)
            following = [shown] * (shown + 1)  # the next piece that is not pruned
            for at in range(shown - 1, -1, -1):
                parent = self.parents[at]
                following[at] = following[at + 1] if parent is not None and parent.pruned else at
            return [self.runs[following[e.start]] if following[e.start] < e.stop else None for e in elements]
        return map(attrgetter("index" if name == "at" else name), elements)

    def piece_facts(self, name: str):
        """One fact of each piece: its place, run or text, or its parent's place, tag or flag."""
        if name == "at":
            return range(len(self.texts))
        if name == "run":
            return self.runs
        if name == "text":
            return self.texts
        if name == "parent":
            return [-1 if parent is None else parent.index for parent in self.parents]
        none = None if name == "tag" else False
        return [none if parent is None else getattr(parent, name) for parent in self.parents]

    @cached_property
    def runs(self) -> list[int]:
        """For each piece the place of the first piece of its run.

        Pieces of one parent that only pruned subtrees part are one run, as they are then neighbours.
        """
        live = [0, *accumulate(not element.pruned for element in self.elements)]
        runs: list[int] = []
        held, cut = None, False  # the last piece that is not pruned, and whether a comment came after it
        for at, parent in enumerate(self.parents):
            cut = cut or self.broken[at]
            if parent is not None and parent.pruned:
                runs.append(at)
                continue
            near = held is not None and not cut and self.parents[held] is parent and live[self.after[held]] == live[self.after[at]]
            runs.append(runs[held] if near else at)
            held, cut = at, False
        return runs


# -- selectors: tag, .class, #id, compounds of these, and descendants ---------
_COMPOUND = re.compile(r"^(\*|[a-zA-Z][\w-]*)?((?:[.#][\w-]+)*)$")


@lru_cache(maxsize=256)
def compile_selector(selector: str) -> list[list[tuple]] | None:
    """Alternatives of compound lists, or None when the selector needs more than that."""
    groups = []
    for group in selector.split(","):
        compounds = []
        for part in group.split():
            match = _COMPOUND.match(part)
            if not match or not part:
                return None
            marks = re.findall(r"([.#])([\w-]+)", match.group(2))
            tag = match.group(1)
            compounds.append(
                (
                    None if tag in (None, "*") else tag.lower(),
                    {name for sign, name in marks if sign == "."},
                    {name for sign, name in marks if sign == "#"},
                )
            )
        if not compounds:
            return None
        groups.append(compounds)
    return groups


def _fits(element: Element, compound: tuple) -> bool:
    tag, classes, ids = compound
    if tag and element.tag != tag:
        return False
    if not element.raw:
        return not classes and not ids
    if classes and not classes <= set((element.attrs.get("class") or "").split()):
        return False
    return not ids or ids == {element.attrs.get("id")}


def select(page: Page, groups: list[list[tuple]]) -> list[Element]:
    """Elements that match, in document order: one pass, with what each element's ancestors have matched."""
    found = [False] * len(page.elements)
    for compounds in groups:
        need = len(compounds) - 1
        passed = [0] * len(page.elements)  # leading compounds matched from the root down to each element
        for element in page.elements:
            above = passed[element.parent.index] if element.parent is not None else 0
            if above == need and _fits(element, compounds[-1]):
                found[element.index] = True
            passed[element.index] = above + (above < need and _fits(element, compounds[above]))
    return [element for element in page.elements if found[element.index]]


def has_match(html: str, selector: str) -> str:
    groups = compile_selector(selector)
    if groups is None:
        return "unsupported"
    page = Page(html)
    if page.empty:
        return "unparsable"
    return "present" if select(page, groups) else "missing"
