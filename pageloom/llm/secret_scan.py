"""Secret scan: single credentials by pattern, and multipart ones by linking parts that stand near each other.

Parts are linked inside one document only, so the interval join of identifiers, proofs and
endpoints is a sorted look-up in the scan of its text: nothing is shuffled, and masks are put in
on the same way.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import slices, utf8

#: The single credentials, in the order in which ties are listed.
KINDS = ("assign", "access", "hex", "id", "weak", "endpoint")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Parts that mean nothing alone: named identifiers, opaque mixed strings, short assignments and network endpoints.
IDENTIFIER = re.compile(r"(?:client|account|tenant|user|key|app)_?id[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9_.@-]{4,})", re.I | re.A)
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]*[0-9])(?=[A-Za-z0-9+/_=-]*[a-z])(?=[A-Za-z0-9+/_=-]*[A-Z])[A-Za-z0-9+/_=-]{16,}")
URL = re.compile(r"(?:https?|ftp|postgres|mysql|redis|amqp)://([A-Za-z0-9.-]+(?::[0-9]+)?)?[^\s\"'<>]*", re.A)
PROVIDER = re.compile(r"\.(?:amazonaws|azure|googleapis)\.com\b", re.A)
HOST = "abcdefghijklmnopqrstuvwxyz0123456789.-"
#: Cheap signs without which a text holds none of the above.
SIGNS = re.compile(rb"pass|secret|token|api_?key|_?id[\"']?\x20*[:=]|akia|[0-9a-f]{16}|[a-z0-9+/_=-]{16}|://|amazonaws|azure|googleapis")
SCOPE = 200
#: What a part contributes: who asks, where it is used; everything else is a proof.
ROLES = {"access": "who", "id": "who", "endpoint": "where"}
SPANS = "array<struct<kind:string,start:int,end:int>>"
SPANS_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


class Part(NamedTuple):
    """A span of a text; ``value`` is where the value begins, behind a name."""

    kind: str
    start: int
    end: int
    value: int

    @property
    def role(self) -> str:
        return ROLES.get(self.kind, "proof")


def in_order(parts: Iterable[Part]) -> list[Part]:
    return sorted(parts, key=lambda p: (p.start, KINDS.index(p.kind), p.end))


def base_spans(text: str) -> list[Part]:
    """The single credentials of a text: leftmost matches of each kind, failing ones dropped."""
    found = [Part("assign", *m.span(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [Part("access", *m.span(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return in_order([*found, *(Part("hex", *m.span(), m.start()) for m in HEX.finditer(text))])


def weak_parts(text: str, base: list[Part]) -> list[Part]:
    """Parts that count only beside a complementary part; an opaque string inside a URL, an identifier's value or a single credential is none."""
    named = [Part("id", *m.span(), m.start(1)) for m in IDENTIFIER.finditer(text)]
    urls = [m for m in URL.finditer(text) if m[1]]
    hosts = [Part("endpoint", m.start(), m.end(1), m.start()) for m in urls]
    done = 0
    for m in PROVIDER.finditer(text):
        head = text[done : m.start()]
        name = head[len(head.rstrip(HOST)) :].rpartition("..")[2].lstrip(".")
        if name:
            hosts.append(Part("endpoint", m.start() - len(name), m.end(), m.start() - len(name)))
        done = m.end()
    taken = sorted([(m.start(), m.end()) for m in urls] + [(p.start, p.end) for p in [*named, *base]])
    begins = [s for s, _ in taken]
    ends = [0]
    for _, e in taken:
        ends.append(max(ends[-1], e))  # the furthest end of the first so many
    opaque = [Part("weak", *m.span(), m.start()) for m in OPAQUE.finditer(text) if ends[bisect_left(begins, m.end())] <= m.start()]
    return [*(Part("weak", *m.span(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) < 12), *named, *opaque, *_apart(hosts)]


def _apart(parts: list[Part]) -> list[Part]:
    """Of overlapping parts the first."""
    out: list[Part] = []
    for p in sorted(parts, key=lambda p: (p.start, -p.end)):
        if not out or p.start >= out[-1].end:
            out.append(p)
    return out


class Side:
    """The parts of one role, sorted for look-up of the nearest on either side."""

    def __init__(self, parts: list[Part]):
        self.ends = sorted(p.end for p in parts)
        parts = sorted(parts, key=lambda p: p.start)
        self.starts = [p.start for p in parts]
        self.values = [p.value for p in parts]
        for i in range(len(parts) - 2, -1, -1):
            self.values[i] = min(self.values[i], self.values[i + 1])

    def near(self, part: Part, scope: int) -> bool:
        """Whether a part that shares no character with this one has its value within ``scope`` characters of this one's."""
        before = bisect_right(self.ends, part.start)
        after = bisect_left(self.starts, part.end)
        return (before > 0 and part.value - self.ends[before - 1] <= scope) or (after < len(self.starts) and self.values[after] - part.end <= scope)


def linked(base: list[Part], weak: list[Part], scope: int = SCOPE) -> list[Part]:
    """The weak parts that a complementary part stands near: a proof needs someone or somewhere, an identifier or endpoint a proof."""
    sides = {role: Side([p for p in [*base, *weak] if p.role == role]) for role in ("who", "where", "proof")}
    needs = {"proof": ("who", "where"), "who": ("proof",), "where": ("proof",)}
    return [p for p in weak if any(sides[role].near(p, scope) for role in needs[p.role])]


def scan(raw: bytes, scope: int = SCOPE) -> tuple[str | None, list[Part], list[Part]]:
    """The text, its single credentials, and these with all linked parts; without any cheap sign the text is not decoded."""
    if not SIGNS.search(raw.lower()):
        return None, [], []
    text = raw.decode("utf-8", "replace")
    base = base_spans(text)
    return text, base, in_order({*base, *linked(base, weak_parts(text, base), scope)})


def _rows(column: pa.Array) -> Iterator[bytes]:
    data, bounds = utf8(column)
    for a, b in slices(bounds):
        part = data[bounds[a] : bounds[b]].tobytes()
        yield from (part[bounds[i] - bounds[a] : bounds[i + 1] - bounds[a]] for i in range(a, b))


def secret_spans(documents: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``doc_id``, ``base`` and ``spans`` (arrays of kind, start, end; code points, end exclusive), one row per document.

    One narrow scan. A null text has no spans, a null id is kept; repeated rows are reported as
    often as they occur; time grows with a text's length. No rows give no rows; other columns
    are not looked at.
    """
    plain = lambda parts: [{"kind": p.kind, "start": p.start, "end": p.end} for p in parts]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(raw, scope)[1:] for raw in _rows(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([plain(f[i]) for f in found], SPANS_TYPE) for i in (0, 1))], ["doc_id", "base", "spans"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(find, f"doc_id {kind}, base {SPANS}, spans {SPANS}")


def _text(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda p: F.concat_ws(":", p["kind"], p["start"].cast("string"), p["end"].cast("string"))), ",")


def report(documents: DataFrame) -> DataFrame:
    """Counts of the single credentials, their digest and all spans; cases as in :func:`secret_spans`."""
    found = secret_spans(documents)
    count = lambda kind: F.size(F.filter("base", lambda p: p["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(_text("base"), 256).alias("base_sha256"), _text("spans").alias("spans"),
    )


def mask(documents: DataFrame, with_text: str, scope: int = SCOPE) -> DataFrame:
    """The documents, all columns kept, with ``with_text`` in place of each secret (and ``n_chars`` set anew where one was).

    Single credentials and linked proofs are secrets, identifiers and endpoints stay. Null and
    empty texts stay as they are, repeated rows are masked alike, no rows give no rows.
    """
    names = documents.columns
    place, size = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def hide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            hidden = {}
            for i, raw in enumerate(_rows(columns[place])):
                text, _, parts = scan(raw, scope)
                spans = [(p.start, p.end) for p in parts if p.kind not in ("id", "endpoint")]
                if spans:
                    hidden[i] = _masked(text, spans, with_text)
            if hidden:
                values = columns[place].to_pylist()
                columns[place] = pa.array([hidden.get(i, v) for i, v in enumerate(values)], columns[place].type)
                if size is not None:
                    columns[size] = pa.array([len(hidden[i]) if i in hidden else n for i, n in enumerate(columns[size].to_pylist())], columns[size].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return documents.mapInArrow(hide, documents.schema)


def _masked(text: str, spans: list[tuple[int, int]], with_text: str) -> str:
    """Overlapping spans are one."""
    out, done = [], 0
    for start, end in sorted(spans):
        if start >= done:
            out += [text[done:start], with_text]
        done = max(done, end)
    return "".join([*out, text[done:]])
