"""Pages as arrays: what the page reader finds, in columns that DataFrame functions choose from."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import types as T

from .parse import Element, Page

#: Place of an element or a text piece among all of the page; ``parent`` -1 is the page itself.
ELEMENT = {
    "tag": "string", "at": "int", "parent": "int", "start": "int", "stop": "int", "last": "int",
    "pruned": "boolean", "dropped": "boolean", "first": "int", "chars": "int",
}
PIECE = {"at": "int", "run": "int", "parent": "int", "tag": "string", "pruned": "boolean", "dropped": "boolean", "text": "string"}
#: Pages whose arrays are sent together: so many characters of HTML, or a page more.
SLICE_CHARS = 4 << 20

_ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
_ORIGIN = re.compile(r"(?i)^(https?://)([^/?#\s]+)")
_ROOTED = re.compile(r"^(?!.*/\.)/(?!/)(?!.*\?#)[^\x00-\x20]*$")


def joiner(base: str) -> Callable[[str], str]:
    """Resolver for one page: rooted paths without dot segments need no parsing."""
    origin = _ORIGIN.match(base)

    def join(href: str) -> str:
        if origin and _ROOTED.match(href) and href[-1] not in "?#":
            return origin.group(1).lower() + origin.group(2) + href
        try:
            return urljoin(base, href)
        except ValueError:
            return href

    return join


def _listed(fields: dict[str, str], columns: dict[str, list], ends: list[int]) -> pa.Array:
    values = [pa.array(columns[name], _ARROW[kind]) for name, kind in fields.items()]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(values, names=list(fields)))


def _named(fields: dict[str, str], facts: tuple[str, ...] | None) -> dict[str, str]:
    return {name: kind for name, kind in fields.items() if facts is None or name in facts}


def arrays_schema(keep: list[T.StructField], attributes: tuple[str, ...], facts: tuple[str, ...] | None = None) -> T.StructType:
    """Kept columns, then ``elements``, ``pieces``, ``body_from`` and ``empty``."""

    def listed(fields: dict[str, str]) -> T.ArrayType:
        return T.ArrayType(T._parse_datatype_string(", ".join(f"`{name}` {kind}" for name, kind in fields.items())))

    made = [
        T.StructField("elements", listed({**_named(ELEMENT, facts), **dict.fromkeys(attributes, "string")})),
        T.StructField("pieces", listed(_named(PIECE, facts))),
        T.StructField("body_from", T.IntegerType()),
        T.StructField("empty", T.BooleanType()),
    ]
    return T.StructType([*keep, *made])


def arrays_of(attributes: tuple[str, ...], tags: frozenset[str] | None, marks: frozenset[str], facts: tuple[str, ...] | None = None):
    """A ``mapInArrow`` function; its input ends with the page's URL and its text.

    ``attributes`` become fields of the elements, ``href`` resolved against the URL. With ``tags`` only the elements
    of these tags are listed, and those with one of the attributes ``marks``. ``facts`` names the fields of elements and
    pieces that are made, all if not given.
    """
    of_elements, of_pieces = _named(ELEMENT, facts), _named(PIECE, facts)
    fields = {**of_elements, **dict.fromkeys(attributes, "string")}

    def attribute(name: str, listed: list[Element], base: str) -> list[str | None]:
        values = [element.attrs.get(name) if element.raw else None for element in listed]
        if name != "href":
            return values
        join = joiner(base)
        return [None if value is None else join(value) for value in values]

    def shown(element: Element) -> bool:
        return element.tag in tags or bool(element.raw and not marks.isdisjoint(element.attrs))

    def made(batch: pa.RecordBatch, pages: list[tuple[str | None, str]]) -> pa.RecordBatch:
        elements, pieces = {name: [] for name in fields}, {name: [] for name in of_pieces}
        n_elements = n_pieces = 0
        element_ends, piece_ends, body_from, empty = [0], [0], [], []
        for base, html in pages:
            page = Page(html or "")
            if not page.empty:
                listed = page.elements if tags is None else [element for element in page.elements if shown(element)]
                for name in of_elements:
                    elements[name].extend(page.element_facts(name, listed))
                for name in attributes:
                    elements[name].extend(attribute(name, listed, base or ""))
                for name in of_pieces:
                    pieces[name].extend(page.piece_facts(name))
                n_elements += len(listed)
                n_pieces += len(page.texts)
            element_ends.append(n_elements)
            piece_ends.append(n_pieces)
            body_from.append(page.body_from)
            empty.append(page.empty)
        kept = batch.columns[:-2]
        arrays = [_listed(fields, elements, element_ends), _listed(of_pieces, pieces, piece_ends), pa.array(body_from, pa.int32()), pa.array(empty)]
        return pa.RecordBatch.from_arrays([*kept, *arrays], names=[*batch.schema.names[:-2], "elements", "pieces", "body_from", "empty"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bases, texts = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            start, held, chars = 0, [], 0
            for at in range(batch.num_rows):
                held.append((bases[at].as_py(), texts[at].as_py()))
                chars += len(held[-1][1] or "")
                if chars >= SLICE_CHARS or at + 1 == batch.num_rows:
                    yield made(batch.slice(start, len(held)), held)
                    start, held, chars = at + 1, [], 0

    return run
