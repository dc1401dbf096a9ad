"""Feeds over HTTP as a Spark data source: four sources at once at most, a failure is a row and never an error.

``spark.dataSource.register(FeedSource)``, then
``spark.read.format("feed").option("sources", json).option("now", iso).load()``
with ``sources`` a JSON list of {url, kind}.  Rows: source_key, uri, kind, body,
error, fetched_at, window_end.  ``window`` and ``pages`` are plain functions, and
``transport`` may be any callable of a URL that gives (status, bytes).
"""

from __future__ import annotations

import html
import importlib
import json
import time
import urllib.request
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from urllib.parse import urlencode, urljoin, urlsplit

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.markup import targets
from .html import event_links

#: Limits of one source.
TIMEOUT, BODY, PAGES, PER_PAGE, PAUSE, IN_FLIGHT = 10, 10 << 20, 20, 100, 2.0, 4
BACK, AHEAD = 2, 60
AGENT = "feedloom/1 (calendar reader)"
SCHEMA = "source_key string, uri string, kind string, body string, error string, fetched_at timestamp, window_end timestamp"

Transport = Callable[[str], tuple[int, bytes]]


def window(now: datetime) -> tuple[datetime, datetime]:
    return now - timedelta(days=BACK), now + timedelta(days=AHEAD)


def over_http(url: str) -> tuple[int, bytes]:
    asked = urllib.request.Request(url, headers={"User-Agent": AGENT})
    with urllib.request.urlopen(asked, timeout=TIMEOUT) as got:  # noqa: S310
        return got.status, got.read(BODY + 1)


def body_of(url: str, transport: Transport) -> str:
    status, body = transport(url)
    if status != 200:
        raise ValueError(f"status {status}")
    if len(body) > BODY:
        raise ValueError(f"more than {BODY} bytes")
    return body.decode("utf-8", "replace")


def _site(url: str) -> tuple[str, str]:
    at = urlsplit(url)
    return at.scheme, at.netloc.lower()


def pages(url: str, now: datetime, transport: Transport) -> Iterator[tuple[str, str | None, str | None]]:
    """A JSON calendar's pages: the server names the next one, which must be on its own site; 20 at most.  What is left out is a row with an error."""
    first, last = window(now)
    at = f"{url}?{urlencode({'start_date': first.date(), 'end_date': last.date(), 'per_page': PER_PAGE, 'status': 'publish', 'page': 1})}"
    for _ in range(PAGES):
        text = body_of(at, transport)
        yield at, text, None
        following = json.loads(text).get("next_rest_url")
        if not following:
            return
        try:
            own = _site(following) == _site(url)
        except ValueError as e:
            yield following, None, str(e)
            return
        if not own:
            yield following, None, "next page is on another site"
            return
        at = following
    yield at, None, f"more than {PAGES} pages"


def crawl(url: str, transport: Transport, pause: Callable[[float], None] = time.sleep) -> Iterator[tuple[str, str | None, str | None]]:
    """A chapter's event pages, one after another, 20 at most; a page that fails, and what is left out, is a row with its error."""
    home = body_of(url, transport)
    found = event_links(url, [html.unescape(h) for h in targets(home)])
    if not found:
        raise ValueError("no event links")
    for i, link in enumerate(found[:PAGES]):
        if i:
            pause(PAUSE)
        try:
            yield link, body_of(link, transport), None
        except Exception as e:  # noqa: BLE001  a failed page is data
            yield link, "", str(e)
    if len(found) > PAGES:
        yield url, None, f"{len(found)} event links, more than {PAGES}"


def fetch_one(source: dict, now: datetime, transport: Transport, pause: Callable[[float], None] = time.sleep) -> list[tuple]:
    """All rows of one source.  If the source fails as a whole, one row with its error and nothing else; rows for what was left out come first."""
    url, kind, end = source["url"], source["kind"], window(now)[1]
    try:
        if kind == "tribe":
            got = list(pages(url, now, transport))
        elif kind == "bevy":
            got = list(crawl(url, transport, pause))
        elif kind in ("ics", "html"):
            got = [(urljoin(url, ""), body_of(url, transport), None)]
        else:
            raise ValueError(f"unknown kind {kind}")
    except Exception as e:  # noqa: BLE001  a failed source is data
        return [(url, url, kind, None, str(e), now, end)]
    got.sort(key=lambda r: r[1] is not None)
    return [(url, u, kind, b, err, now, end) for u, b, err in got]


class _Part(InputPartition):
    def __init__(self, sources: list[dict]):
        self.sources = sources


class FeedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.sources = json.loads(options["sources"])
        self.now = datetime.fromisoformat(options["now"])
        self.transport = options.get("transport", f"{__name__}:over_http")

    def partitions(self):
        return [_Part(self.sources[i::IN_FLIGHT]) for i in range(min(IN_FLIGHT, len(self.sources)))]

    def read(self, partition):
        module, _, name = self.transport.partition(":")
        for source in partition.sources:
            yield from fetch_one(source, self.now, getattr(importlib.import_module(module), name))


class FeedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FeedReader:
        return FeedReader(self.options)


__all__ = ["FeedSource", "crawl", "fetch_one", "pages", "window"]
