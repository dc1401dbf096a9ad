"""Excerpts of descriptions, and entities."""

import html
import re
from collections.abc import Callable, Iterator
from html.entities import html5

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .markup import plain

#: Characters that take no room.
INVISIBLE = "\u200b\u200c\u200d\ufeff\u00ad"
LIMIT = 220
#: Elements that part paragraphs (fixed values).
BREAKS = frozenset("p div br li ul ol h1 h2 h3 h4 h5 h6 blockquote tr table script style".split())


#: Rows of an Arrow batch that are texts of Python at once.
ROWS = 128


def by_slices(one: Callable[[str], str], batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """``one`` of each text: of a batch's texts only a slice is in Python, and its results leave before the next."""
    for batch in batches:
        for i in range(0, len(batch), ROWS):
            yield pa.array([None if v is None else one(v) for v in batch.slice(i, ROWS).to_pylist()], pa.string())


@F.arrow_udf(StringType())
def html_unescape(x: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Entities, named and numeric, as characters: the standard library's table, in Arrow batches."""
    return by_slices(html.unescape, x)


def _closed(text: str) -> str:
    one = lambda m: html.unescape(m[0]) if m[1][0] == "#" else html5.get(m[1], m[0])
    return re.sub(r"&(#\d+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)", one, text)


@F.arrow_udf(StringType())
def html_text(x: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """A page's text, with an empty line where paragraphs part."""
    return by_slices(lambda v: plain(v, BREAKS), x)


@F.arrow_udf(StringType())
def html_text_closed(x: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The same, but only entities that end with their semicolon are characters: ``&amp`` alone stays."""
    return by_slices(lambda v: plain(v, BREAKS, _closed), x)


@F.pandas_udf(ArrayType(StringType()))
def unescape_all(x: pd.Series) -> pd.Series:
    return x.map(lambda v: [t and html.unescape(t) for t in v], na_action="ignore")


def squeeze(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, r"[ \t\r\n\f\x0B]+", " "))


def strip_invisible(c: Column) -> Column:
    return F.translate(c, INVISIBLE, "")


def strip_markdown(c: Column) -> Column:
    """Links become their labels; leading marks, emphasis and escapes go; blanks collapse."""
    c = F.regexp_replace(c, r"\[([^\]\n]*)\]\([^)\n]*\)", "$1")
    c = F.regexp_replace(c, r"(?m)^[ \t]*(?:#{1,6}|>|[-*+])[ \t]+", "")
    c = F.regexp_replace(c, r"\*\*|__|[*_`]", "")
    c = F.regexp_replace(c, r"\\([!-/:-@\[-`{-~])", "$1")
    return squeeze(c)


def is_mostly_link(c: Column) -> Column:
    link = F.regexp_extract(c, r"http[^ ]*", 0)
    return (link != "") & (F.octet_length(c) - F.octet_length(link) < F.octet_length(link))


def truncate_words(c: Column, limit: int = LIMIT) -> Column:
    """At most ``limit`` bytes, cut at a blank, with an ellipsis; without a blank, before the character that has no room."""
    data = F.encode(c, "UTF-8")
    head = F.coalesce(*(F.try_validate_utf8(F.substring(data, 1, n).cast("string")) for n in range(limit, limit - 4, -1)))
    head = F.regexp_replace(head, r"(?s)^(.+) [^ ]*$", "$1")
    return F.when(F.octet_length(c) <= limit, c).otherwise(F.concat(F.rtrim(head, F.lit(" ,;:.-")), F.lit("\u2026")))


def html_paragraphs(c: Column, text=html_text) -> Column:
    """Texts between block tags, blank lines and lines that begin with a hash, without tags, with entities as characters.

    What a script or style holds is a paragraph of its own, as its tags part it
    from the rest.  Only texts with a tag or an ampersand go through Python, to ``text``.
    """
    c = F.coalesce(text(F.when(c.contains("<") | c.contains("&"), c)), c)
    parts = F.split(F.replace(c, F.lit("\n#"), F.lit("\n\n#")), r"\n[ \t]*\n")
    return F.filter(F.transform(parts, squeeze), lambda p: p != "")


def excerpt(c: Column, text=html_text) -> Column:
    """The first paragraph that is not mostly a link, shortened; null if there is none."""
    c = strip_invisible(c)
    paras = html_paragraphs(c, text)
    paras = F.when(c.rlike(r"<[A-Za-z/][^>]*>"), paras).otherwise(F.transform(paras, strip_markdown))
    return truncate_words(F.get(F.filter(paras, lambda p: (p != "") & ~is_mostly_link(p)), 0))


def display_cut(c: Column, n: int) -> Column:
    return F.when(F.char_length(c) > n, F.concat(F.left(c, F.lit(n - 1)), F.lit("\u2026"))).otherwise(c)


def map_query(name: Column, address: Column, city: Column, state: Column, zip_: Column) -> Column:
    """What a map is asked for: the parts of a place that there are; null without an address."""
    return F.when(F.coalesce(address, F.lit("")) != "", F.concat_ws(", ", *(F.nullif(c, F.lit("")) for c in (name, address, city, state, zip_))))


def place_label(venue: Column, room: Column) -> Column:
    """A venue, and its room if it has one; null without a venue."""
    return F.when(F.coalesce(venue, F.lit("")) != "", F.concat_ws(" \u2014 ", venue, F.nullif(room, F.lit(""))))


def venues_label(names: Column, n: int = 46) -> Column:
    """What a feed said about a place, in a line: one name, or the building and the room, cut."""
    last, first = F.try_element_at(names, F.lit(-1)), F.get(names, F.lit(0))
    return display_cut(F.when(F.coalesce(F.size(names), F.lit(0)) <= 0, F.lit("")).when(F.size(names) == 1, first).otherwise(F.concat(last, F.lit(" / "), first)), n)
