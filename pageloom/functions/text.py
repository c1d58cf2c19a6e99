"""Whitespace, line and charset functions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import settings as S

# The characters a plain whitespace split treats as blank, and line ends.
BLANK = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
META_CHARSET = r"(?i)charset\s*=\s*['\"]?([a-zA-Z0-9._-]+)"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def collapse_ws(text: Column) -> Column:
    """Runs of Unicode whitespace become one space; ends are trimmed.

    Visible ASCII, and a single space before it, are passed by at once: nothing is to be replaced there.
    """
    return F.trim(F.regexp_replace(text, f"(?![!-~]| [!-~]){BLANK}+", " "))


def split_all(text: Column, pattern: str, mark: str) -> Column:
    """Parts of a text between the matches of a pattern, one of which is the character ``mark``.

    A pattern is read once for a replacement but for every row of a split, so the matches become the mark first.
    """
    return F.split(F.regexp_replace(text, pattern, mark), mark)


def split_lines(text: Column) -> Column:
    """Non-blank lines of a text."""
    return F.filter(split_all(text, LINE_END, "\n"), lambda line: collapse_ws(line) != "")


def lines_first_seen(lines: Column) -> Column:
    return F.array_distinct(lines)


def first_match(lines: Column, predicate: Callable[[Column], Column]) -> Column:
    """First line that fits, else an empty string."""
    return F.coalesce(F.try_element_at(F.filter(lines, predicate), F.lit(1)), F.lit(""))


def profile_lines(texts: Column) -> Column:
    """Lines of all texts: collapsed, non-empty, each kept at its first place."""
    def lines(text: Column) -> Column:
        return F.filter(F.transform(split_all(text, LINE_END, "\n"), collapse_ws), lambda line: line != "")

    return lines_first_seen(F.flatten(F.transform(texts, lines)))


def profile_name(title: Column, lines: Column) -> Column:
    by_line = F.transform(lines, lambda line: F.regexp_extract(line, S.LINE_NAME, 1))
    return F.coalesce(
        F.nullif(F.regexp_extract(title, S.TITLE_NAME, 1), F.lit("")),
        first_match(by_line, lambda name: name != ""),
    )


def _marked(line: Column) -> Column:
    """A period line as newline, period, newline, position; other lines unchanged.

    No line holds a newline, so the mark is safe, and a marked line fits neither
    pattern again.
    """
    bounded = F.regexp_replace(line, S.BOUNDED_PERIOD, "\n$1－$2\n$3")
    return F.regexp_replace(bounded, S.POINT_PERIOD, "\n$1\n$2")


def _unmarked(marked: Column) -> Column:
    parts = F.split(marked, "\n", 3)
    return F.struct(parts[1].alias("period"), strip(parts[2]).alias("position"))


def timeline_item(line: Column) -> Column:
    """``struct(period, position)`` or NULL when the line is no period line."""
    marked = _marked(line)
    return F.when(marked.startswith("\n"), _unmarked(marked))


def timeline(lines: Column) -> Column:
    marked = F.filter(F.transform(lines, _marked), lambda line: line.startswith("\n"))
    return F.transform(marked, _unmarked)


def meta_charset(html: Column) -> Column:
    """Charset named in the first 4096 characters, else utf-8."""
    found = F.regexp_extract(F.substring(html, 1, 4096), META_CHARSET, 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.lit("utf-8"))


def header_charset(content_type: Column) -> Column:
    """What follows ``charset=`` up to ``;``, trimmed and lower-cased (quotes stay)."""
    lowered = F.lower(content_type)
    named = strip(F.regexp_extract(lowered, r"(?s)charset=([^;]*)", 1))
    return F.when(lowered.contains("charset="), named).otherwise(F.lit("utf-8"))


@F.pandas_udf(T.StringType())
def _decode_other(body: pd.Series, charset: pd.Series) -> pd.Series:
    def one(raw, name):
        if raw is None:
            return None
        try:
            return bytes(raw).decode(name, errors="replace")
        except (LookupError, ValueError):
            return bytes(raw).decode("utf-8", errors="replace")

    return pd.Series([one(raw, name) for raw, name in zip(body, charset)], dtype=object)


def decode_body(body: Column, charset: Column) -> Column:
    """Bytes to text. UTF-8 stays in the JVM; only other charsets reach Python."""
    plain = charset.isin("utf-8", "utf8")
    other = _decode_other(F.when(~plain, body), charset)
    return F.when(plain, F.make_valid_utf8(body.cast("string"))).otherwise(other)
