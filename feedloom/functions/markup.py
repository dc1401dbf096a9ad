"""HTML as tokens and as a tree of open elements: forgiving, as pages are.

``tokens`` is one pass of a small machine: attributes in either quotes or none,
raw text, comments.  ``Outline`` keeps the open elements, closes those that a new
one ends by implication, and passes over end tags that match none.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

#: Fixed values of the HTML standard: elements without an end, and those that hold text and no tags (the last two with entities).
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
DECODED = frozenset("textarea title".split())
#: What ends an open p; what else a start tag ends; and what shields the elements outside it from that.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "optgroup": {"option", "optgroup"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tr": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "tbody", "thead", "tfoot"}, "thead": {"tr", "td", "th", "tbody", "thead", "tfoot"}, "tfoot": {"tr", "td", "th", "tbody", "thead", "tfoot"},
}
SHIELDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "optgroup": {"select"}}
TABLE = frozenset(["table", "template"])
#: An end tag of an inline element ends nothing outside the block that it stands in.
BLOCKS = ENDS_P | frozenset("li dt dd td th tr tbody thead tfoot table body html button object template caption select".split())
CELLS = frozenset("td th table caption template object".split())

NAME = re.compile(r"[A-Za-z][^\s/>]*")
ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)|(?=>)))?""")
REST = re.compile(r"[\s/]*(>|$)")


def tokens(page: str) -> Iterator[tuple[str, str, list[tuple[str, str | None]]]]:
    """("text", text, []), ("raw", text, []), ("start", name, attributes as written) and ("end", name, []), in order.

    A tag that the page ends in is dropped, as is a comment; a ``<`` that begins no tag is text.
    """
    at, end = 0, len(page)
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], []
            return
        if lt > at:
            yield "text", page[at:lt], []
        if page.startswith("<!--", lt):
            close = re.compile(r"--!?>").search(page, lt + 2 if page.startswith(("<!-->", "<!--->"), lt) else lt + 4)
            at = close.end() if close else end
            continue
        closing = page.startswith("</", lt)
        name = NAME.match(page, lt + 1 + closing)
        if name is None:
            if page.startswith(("<!", "<?"), lt) or closing and page[lt + 2 : lt + 3]:
                close = page.find(">", lt)
                at = close + 1 if close >= 0 else end
                continue
            yield "text", "<", []
            at = lt + 1
            continue
        tag, pos, found = name[0].lower(), name.end(), []
        while (stop := REST.match(page, pos)) is None:
            a = ATTRIBUTE.match(page, pos)
            found.append((a[1].lower(), next((v for v in a.groups()[1:] if v is not None), None)))
            pos = a.end()
            if pos < end and page[pos] == "=":
                # An opened quote that never closes: the tag runs to the end of the page.
                return
        at = stop.end()
        if not stop[1]:
            return
        yield ("end", tag, []) if closing else ("start", tag, found)
        if not closing and tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(page, at)
            inner = page[at : close.start() if close else end]
            if inner:
                yield ("text" if tag in DECODED else "raw"), inner, []
            at = close.start() if close else end


def plain(page: str, breaks: frozenset[str], decode=html.unescape) -> str:
    """A page's text: an empty line where one of ``breaks`` begins or ends, other tags and comments gone, entities as characters."""
    out = []
    for kind, what, _ in tokens(page):
        if kind == "text":
            out.append(decode(what) if "&" in what else what)
        elif kind == "raw":
            out.append(what)
        elif what in breaks:
            out.append("\n\n")
    return "".join(out)


def targets(page: str) -> list[str]:
    """The ``href`` of each ``a``, as written."""
    return [v or "" for kind, tag, attrs in tokens(page) if kind == "start" and tag == "a" for k, v in attrs if k == "href"]


class Outline:
    """The open elements of a page: ``walk`` calls ``opened``, ``closed`` and ``text`` as they begin, end and go on."""

    def __init__(self):
        self.stack: list[str] = []

    def opened(self, tag: str, attrs: dict[str, str], depth: int) -> None: ...

    def closed(self, depth: int) -> None: ...

    def text(self, data: str) -> None: ...

    def _close_to(self, depth: int) -> None:
        while len(self.stack) >= depth:
            self.closed(len(self.stack))
            self.stack.pop()

    def _outermost(self, names, shields) -> int | None:
        """The depth of the outermost of some elements that is open within the nearest shield."""
        found = None
        for depth in range(len(self.stack), 0, -1):
            if self.stack[depth - 1] in names:
                found = depth
            elif self.stack[depth - 1] in shields:
                break
        return found

    def _start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in ENDS_P and (depth := self._outermost({"p"}, CELLS)):
            self._close_to(depth)
        if tag in ENDS and (depth := self._outermost(ENDS[tag], SHIELDS.get(tag, TABLE))):
            self._close_to(depth)
        if tag in VOID:
            return self.opened(tag, attrs, 0)
        self.stack.append(tag)
        self.opened(tag, attrs, len(self.stack))

    def _end(self, tag: str) -> None:
        inner = tag not in BLOCKS
        for depth in range(len(self.stack), 0, -1):
            here = self.stack[depth - 1]
            if here == tag:
                return self._close_to(depth)
            if inner and here in BLOCKS or here in CELLS and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                return

    def walk(self, page: str) -> None:
        for kind, what, attrs in tokens(page):
            if kind == "start":
                first: dict[str, str] = {}
                for k, v in attrs:
                    first.setdefault(k, html.unescape(v or ""))
                self._start(what, first)
            elif kind == "end":
                self._end(what)
            else:
                self.text(html.unescape(what) if kind == "text" else what)
        self._close_to(1)
