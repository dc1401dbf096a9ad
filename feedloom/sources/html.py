"""HTML pages in Arrow batches: links, cards and linked data.

Pages are only taken apart here; what the parts mean is decided by columns.
"""

from __future__ import annotations

import html as entities
import json
import re
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import rfc3339
from ..functions.markup import Outline, targets
from ..functions.names import slugify
from ..functions.urls import clean_url


def links(pages: DataFrame, key: str, body: str) -> DataFrame:
    """Each page's distinct link targets as written, in either quotes or none, with the place of the first."""
    kind = pages.select(key).schema[0].dataType.simpleString()

    def run(batches):
        for b in batches:
            found = [[(h, i + 1) for i, h in reversed(list(enumerate(targets(p or ""))))] for p in b.column(1).to_pylist()]
            rows = [(k, h, i) for k, page in enumerate(found) for h, i in dict(page).items()]
            at, hrefs, places = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(hrefs, pa.string()), pa.array(places, pa.int64())], [key, "href", "pos"])

    return pages.select(key, body).mapInArrow(run, f"{key} {kind}, href string, pos long").groupBy(key, "href").agg(F.min("pos").alias("pos"))


#: Class names of the cards, and the media type of linked data.
CARD, LABEL, PLACE = "meeting-card-compact", "meeting-week", "meeting-location"
LINKED = "application/ld+json"
CARDS = "source_key string, pos int, week string, has_time boolean, datetime string, place string"
ADDRESS = ("streetAddress", "addressLocality", "addressRegion", "postalCode")
LOCATION = pa.struct([("kinds", pa.list_(pa.string())), ("name", pa.string()), ("url", pa.string()), *((a, pa.string()) for a in ADDRESS)])
EVENT = pa.struct([*((f, pa.string()) for f in ("name", "description", "startDate", "endDate", "eventStatus", "eventAttendanceMode")), ("locations", pa.list_(LOCATION))])
EVENT_DDL = "struct<name: string, description: string, startDate: string, endDate: string, eventStatus: string, eventAttendanceMode: string, locations: array<struct<kinds: array<string>, name: string, url: string, streetAddress: string, addressLocality: string, addressRegion: string, postalCode: string>>>"


class _Page(Outline):
    """Cards of one class with their label, place and time, linked-data scripts, and the canonical link.

    What a card holds is its own, also if cards stand in one another; only the
    first label, place and time of a card count.
    """

    def __init__(self):
        super().__init__()
        self.cards, self.scripts, self.canonical = [], [], None
        self.open, self.inside, self.in_script = [], [], 0

    def opened(self, tag, attrs, depth):
        classes = attrs.get("class", "").split()
        if tag == "link" and "canonical" in attrs.get("rel", "").lower().split():
            self.canonical = self.canonical or attrs.get("href")
        if tag == "script" and attrs.get("type", "").strip().lower() == LINKED:
            self.in_script = depth
            self.scripts.append("")
        if CARD in classes and depth:
            self.cards.append({LABEL: None, PLACE: None, "time": None, "has_time": False})
            self.open.append((depth, self.cards[-1]))
        if not self.open:
            return
        card = self.open[-1][1]
        for name in (LABEL, PLACE):
            if name in classes and card[name] is None and depth:
                self.inside.append((depth, card, name))
                card[name] = ""
        if tag == "time" and not card["has_time"]:
            card.update(has_time=True, time=attrs.get("datetime"))

    def closed(self, depth):
        if self.in_script == depth:
            self.in_script = 0
        while self.open and self.open[-1][0] >= depth:
            self.open.pop()
        self.inside = [x for x in self.inside if x[0] < depth]

    def text(self, data):
        if self.in_script:
            self.scripts[-1] += data
        for _, card, name in self.inside:
            card[name] += data


def _parsed(body: str) -> _Page:
    p = _Page()
    p.walk(body or "")
    return p


def _squeezed(text: str | None) -> str | None:
    return " ".join((text or "").split()) or None


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def card_rows(body: str) -> list[tuple]:
    """(pos, week, has_time, datetime, place) of each card of a page."""
    return [(i, _squeezed(c[LABEL]), c["has_time"], c["time"], _squeezed(c[PLACE])) for i, c in enumerate(_parsed(body).cards)]


def cards(pages: DataFrame) -> DataFrame:
    """(source_key, pos, week, has_time, datetime, place) of each card; a page without any is a row without a pos."""
    schema = pa.schema([("source_key", pa.string()), ("pos", pa.int32()), ("week", pa.string()), ("has_time", pa.bool_()), ("datetime", pa.string()), ("place", pa.string())])

    def run(batches):
        for b in batches:
            out = []
            for key, body in zip(*(x.to_pylist() for x in b.columns), strict=True):
                out += [(key, *row) for row in card_rows(body)] or [(key, None, None, None, None, None)]
            yield _batch(out, schema)

    return pages.select("source_key", "body").mapInArrow(run, CARDS)


def decode_cards(pages: DataFrame, title: str, since: Column, to: Column) -> tuple[DataFrame, DataFrame]:
    """(records, skips) of schedule pages: an event a card, called ``title`` and its label, if it starts between two instants.

    A card without a time is a slot without a date and no fault; one without a
    label, or with a time that cannot be read, is a skip; an instant counts once;
    a page without cards has another structure and is a skip of the document.
    """
    c = cards(pages).withColumn("start", rfc3339(F.col("datetime")).cast("timestamp_ntz"))
    no_time = F.coalesce(F.col("datetime"), F.lit("")) == ""
    why = (
        F.when(F.col("pos").isNull(), "no cards").when(F.col("week").isNull(), "no label").when(~F.col("has_time"), "")
        .when(no_time, "time without an instant").when(F.col("start").isNull(), "bad time").when(~F.col("start").between(since.cast("timestamp_ntz"), to.cast("timestamp_ntz")), "")
    )
    c = c.withColumn("reason", why)
    skips = c.filter("reason <> ''").select("source_key", F.coalesce(F.concat(F.lit("card "), F.col("pos").cast("string")), F.lit("document")).alias("ref"), "reason")
    one = c.filter("reason is null").groupBy("source_key", "start").agg(F.min_by(F.struct("week", "place"), "pos").alias("c"))
    venues = F.when(F.col("c.place").isNotNull(), F.array(F.struct(F.col("c.place").alias("name"))))
    uid = F.concat(slugify(F.col("c.week")), F.lit("_"), F.date_format("start", "yyyyMMdd'T'HHmmss'Z'"))
    return one.select("source_key", uid.alias("upstream_id"), F.concat(F.lit(f"{title}, "), "c.week").alias("title"), "start", venues.alias("venues")), skips


def _text(x: object) -> str | None:
    if x is not None and not isinstance(x, str):
        raise ValueError("not a text")
    return x


def _many(x: object) -> list:
    return [] if x is None else x if isinstance(x, list) else [x]


def _location(x: dict) -> dict:
    where = x.get("address")
    if isinstance(where, dict):
        where = {a: _text(where.get(a)) for a in ADDRESS}
    elif isinstance(where, str) and where.strip():
        where = {"streetAddress": where.strip()}
    else:
        where = {}
    name = _text(x.get("name"))
    return {"kinds": [k for k in _many(x.get("@type")) if isinstance(k, str)], "name": name and entities.unescape(name).strip(), "url": _text(x.get("url")), **where}


def _event(scripts: list[str]) -> dict | None:
    """The first Event among a page's blocks; what cannot be decoded is passed over."""
    for text in scripts:
        try:
            got = json.loads(text)
        except ValueError:
            continue
        for x in got if isinstance(got, list) else [got]:
            if not isinstance(x, dict) or "Event" not in _many(x.get("@type")):
                continue
            try:
                out = {f.name: _text(x.get(f.name)) for f in list(EVENT)[:-1]}
                out["name"] = entities.unescape(out["name"]).strip() if out["name"] else None
                return out | {"locations": [_location(p) for p in _many(x.get("location")) if isinstance(p, dict)]}
            except ValueError:
                continue
    return None


def linked_events(pages: DataFrame) -> DataFrame:
    """(source_key, canonical, event): a page's canonical link as written, and the first Event of its linked data."""
    schema = pa.schema([("source_key", pa.string()), ("canonical", pa.string()), ("event", EVENT)])

    def run(batches):
        for b in batches:
            found = [(key, _parsed(body)) for key, body in zip(*(x.to_pylist() for x in b.columns), strict=True)]
            yield _batch([(key, p.canonical, _event(p.scripts)) for key, p in found], schema)

    return pages.select("source_key", "body").mapInArrow(run, f"source_key string, canonical string, event {EVENT_DDL}")


def decode_linked(pages: DataFrame, since: Column, to: Column) -> tuple[DataFrame, DataFrame]:
    """(records, skips) of event pages, one each.

    The id is host and path of the canonical link.  Cancelled events are dropped;
    a page without an event, link, name or start with an offset is a skip; an end
    that cannot be read is absent.  Organizers are never read.
    """
    e = linked_events(pages).withColumn("url", clean_url(F.col("canonical")))
    start, end = (rfc3339(F.col(f"event.{x}")).cast("timestamp_ntz") for x in ("startDate", "endDate"))
    e = e.withColumns({"start": start, "end": end})
    why = (
        F.when(F.col("event").isNull(), "no event").when(F.col("url").isNull(), "no canonical link").when(F.col("event.eventStatus").endswith("/EventCancelled"), "")
        .when(F.coalesce("event.name", F.lit("")) == "", "no name").when(F.col("start").isNull(), "bad start").when(~F.col("start").between(since.cast("timestamp_ntz"), to.cast("timestamp_ntz")), "")
    )
    e = e.withColumn("reason", why)
    skips = e.filter("reason <> ''").select("source_key", F.coalesce("url", F.lit("page")).alias("ref"), "reason")
    where = F.col("event.locations")
    mode = F.coalesce(F.col("event.eventAttendanceMode"), F.lit(""))
    online = F.filter(where, lambda x: F.array_contains(x["kinds"], "VirtualLocation"))
    place = F.filter(where, lambda x: F.array_contains(x["kinds"], "Place") & ~F.array_contains(x["kinds"], "VirtualLocation") & ((F.coalesce(x["name"], F.lit("")) != "") | (F.coalesce(x["streetAddress"], F.lit("")) != "")))
    venues = F.transform(place, lambda x: F.struct(x["name"].alias("name"), x["streetAddress"].alias("address"), x["addressLocality"].alias("city"), x["addressRegion"].alias("state"), x["postalCode"].alias("zip")))
    uid = F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1)
    return e.filter("reason is null").select(
        "source_key", uid.alias("upstream_id"), F.col("event.name").alias("title"), F.col("event.description").alias("description"), "start", "end", "url",
        (mode.rlike("/(Online|Mixed)EventAttendanceMode$") | (F.size(online) > 0)).alias("virtual"), F.get(F.filter(F.transform(online, lambda x: clean_url(x["url"])), lambda u: u.isNotNull()), F.lit(0)).alias("virtual_url"), venues.alias("venues"),
    ), skips


def event_links(base: str, hrefs: list[str], path: str = r"^/events/details/[a-z0-9-]+/$") -> list[str]:
    """Links of the base's own site whose path fits, without query and fragment, once each, in order."""
    home, out = urlsplit(base), {}
    for h in hrefs:
        u = urlsplit(urljoin(base, h))
        if (u.scheme, u.netloc) == (home.scheme, home.netloc) and re.match(path, u.path):
            out[f"{u.scheme}://{u.netloc}{u.path}"] = None
    return list(out)
