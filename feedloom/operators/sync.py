"""A run from end to end: bodies -> records -> events -> the next state -> the exported feed.

Everything up to the state is one lazy plan over the fetched bodies; what a run
needs to say about itself comes from a few aggregates.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.text import excerpt
from ..sources import html, ics, json_calendar
from . import normalize, recurrence, serve, store
from .lineage import settled
from .venues import FIELDS, VENUE, venue_rows

#: What decoders give, and its type where a decoder lacks it.
RECORD = {
    "upstream_id": "string", "title": "string", "description": "string", "start": "timestamp_ntz", "end": "timestamp_ntz", "all_day": "boolean", "url": "string", "register_url": "string",
    "virtual": "boolean", "organizers": "array<string>",
}
PLACES = ("name", "address", "city", "state", "zip", "url")
#: Parts a document from its source in the decoders' key; no link has a blank.
MARK = " "


def shaped(records: DataFrame) -> DataFrame:
    """Records of any decoder with the same columns; ``source_key`` without the document, which is ``unit``."""
    have = dict(records.dtypes)
    cols = [F.col(c).cast(t).alias(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in RECORD.items()]
    if "location" in have:
        places = F.when(F.coalesce(F.btrim("location"), F.lit("")) != "", F.array(F.struct(F.col("location").alias("name"))))
        fields: tuple[str, ...] = ("name",)
    else:
        places, fields = F.col("venues"), tuple(f.name for f in records.schema["venues"].dataType.elementType)
    places = F.transform(places, lambda v: F.struct(*(v[f].alias(f) if f in fields else F.lit(None).cast("string").alias(f) for f in PLACES)).cast(VENUE))
    return records.select(F.col("source_key").alias("unit"), *cols, places.alias("venues"))


def decode(bodies: DataFrame, since: Column, to: Column, title: str) -> tuple[DataFrame, DataFrame]:
    """(records, skips) of fetched bodies (source_key, uri, kind, body) by kind, events that start between two instants.

    ``unit`` is a source and one of its documents.
    """
    docs = bodies.filter(F.coalesce("body", F.lit("")) != "").select(F.concat_ws(MARK, "source_key", "uri").alias("source_key"), "kind", "body")
    of = lambda kind: docs.filter(F.col("kind") == kind).select("source_key", "body")
    calendars, bad = map(settled, ics.decode(of("ics")))
    calendars, refused = map(settled, recurrence.expand(calendars, since, to))
    paged, bad_paged = json_calendar.decode(of("tribe"))
    carded, bad_cards = html.decode_cards(of("html"), title, since, to)
    linked, bad_links = html.decode_linked(of("bevy"), since, to)
    records = reduce(DataFrame.unionByName, map(shaped, (calendars, paged, carded, linked)))
    skips = reduce(DataFrame.unionByName, (bad, refused, bad_paged, bad_cards, bad_links))
    return settled(records), settled(skips.select(F.col("source_key").alias("unit"), "ref", "reason"))


def source_of(unit: Column) -> Column:
    return F.substring_index(unit, MARK, 1)


def source_status(bodies: DataFrame, records: DataFrame, skips: DataFrame) -> DataFrame:
    """(source_key, kind, error, events, skipped, window_end): a source fails as a whole, by a document that cannot be read, or by too many skips.

    A document is a page of a paged calendar, and else all that a source sent:
    one failed page fails its source.  Documents that a fetch left out are skips.
    """
    asked = bodies.groupBy("source_key").agg(
        F.first("kind").alias("kind"), F.max("window_end").alias("window_end"), F.min("error").alias("fetch_error"),
        F.count_if(F.coalesce("body", F.lit("")) != "").alias("read"), F.count_if(F.col("error").isNotNull()).alias("left_out"),
    )
    unit = lambda df: df.withColumn("source_key", source_of(F.col("unit")))
    kinds = bodies.select("source_key", "kind").distinct()
    page = F.when(F.col("kind") == "tribe", F.col("unit")).otherwise(F.col("source_key")).alias("page")
    good = unit(records.select("unit")).join(kinds, "source_key").groupBy("source_key", page).agg(F.count("*").alias("good"))
    bad = unit(skips).join(kinds, "source_key").groupBy("source_key", page).agg(F.count_if(F.col("ref") != "document").alias("bad"), F.bool_or(F.col("ref") == "document").alias("broken"))
    each = good.join(bad, ["source_key", "page"], "full_outer").na.fill(0, ["good", "bad"]).join(kinds, "source_key")
    lost = asked.select("source_key", "left_out")
    extra = F.when(F.col("kind") == "tribe", F.lit(0)).otherwise(F.col("left_out"))
    each = each.join(lost, "source_key").withColumns({"skipped": F.col("bad") + extra, "total": F.col("good") + F.col("bad") + extra})
    each = normalize.skip_breaker(each).groupBy("source_key").agg(F.sum("good").alias("events"), F.sum("bad").alias("bad"), F.bool_or("failed").alias("tripped"), F.bool_or(F.coalesce("broken", F.lit(False))).alias("broken"))
    out = asked.join(each, "source_key", "left")
    error = F.when(F.col("read") == 0, F.coalesce("fetch_error", F.lit("nothing read"))).when(F.col("broken"), "a document cannot be read").when(F.col("tripped"), "too many skips")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return out.select("source_key", "kind", error.alias("error"), F.when(error.isNull(), n("events")).otherwise(0).alias("events"), F.when(F.col("read") > 0, n("bad") + n("left_out")).otherwise(0).cast("long").alias("skipped"), "window_end")


@dataclass
class Run:
    """What a run has concluded: ``events`` to store, ``rejected``, ``problems`` and ``skips`` as rows, ``status`` a row for each source."""

    records: DataFrame
    events: DataFrame
    rejected: DataFrame
    problems: DataFrame
    skips: DataFrame
    status: DataFrame


def conclude(bodies: DataFrame, registry: dict[str, DataFrame], rejects: DataFrame, since: Column, to: Column, title: str = "Schedule") -> Run:
    """Decode, leave failed sources out, normalize, and gate by the groups' verification."""
    records, skips = decode(bodies, since, to, title)
    status = source_status(bodies, records, skips)
    records = normalize.of_successful(records.withColumn("source_key", source_of(F.col("unit"))).drop("unit"), status)
    records = settled(records.withColumn("excerpt", excerpt(F.col("description"))).drop("description"))
    events, gone, problems = normalize.normalize(records, normalize.enabled(registry["sources"]), registry["groups"], rejects, registry["venues"], settled)
    verified = registry["groups"].select(F.col("slug").alias("group_slug"), (F.coalesce(F.btrim("verified_by"), F.lit("")) != "").alias("verified"))
    events = events.join(verified, "group_slug", "left").withColumn("status", store.gate(F.col("verified"))).drop("verified")
    return Run(records, events, gone, problems, skips, status)


def tables_after(run_events: DataFrame, registry: dict[str, DataFrame], snapshots: store.Snapshots) -> dict[str, DataFrame]:
    """The registry's tables after a run: nothing is ever deleted, and venues that the events name are filled in or added."""
    was = lambda table, empty: old if (old := snapshots.read(table)) is not None else empty.limit(0)
    groups = store.groups_by_slug(registry["groups"].drop("pos"))
    sources = registry["sources"]
    curated = registry["venues"].select("slug", "name", *FIELDS)
    venues = store.mirror(was(store.VENUES, curated), curated, "slug")
    return {
        store.GROUPS: store.mirror(was(store.GROUPS, groups), groups, "slug"), store.SOURCES: store.mirror(was(store.SOURCES, sources), sources, "url"),
        store.VENUES: venue_rows(venues, run_events.filter("venue is not null").select("venue.*")),
    }


def save(run: Run, snapshots: store.Snapshots, seen: Column, registry: dict[str, DataFrame] | None = None, batch: tuple[str, int] | None = None) -> dict[str, int]:
    """Write the next state and say what changed; nothing is written if an event breaks the store's rules.

    With the ``registry`` its groups, sources and venues are part of the state,
    and all tables come into force together.  A run without a source that worked
    is a failure, and writes nothing.
    """
    if not run.status.filter("error is null").limit(1).count():
        raise RuntimeError("every source failed")
    old = snapshots.read()
    if old is None:
        old = run.events.limit(0).withColumns({"first_seen": F.lit(None).cast("timestamp_ntz"), "last_seen": F.lit(None).cast("timestamp_ntz")})
    events = snapshots.stage(run.events, "run")  # read back: merging is not computed again for each count
    store.check(events, seen, None if registry is None else registry["sources"].select("kind").distinct())
    got = settled(store.claims(old, events))
    counts = store.save_counts(old, events, got).first().asDict()
    n = events.count()
    counts["merged_records"] = normalize.merged_away(run.records.count(), n, run.rejected.count())
    tables = {store.EVENTS: store.upsert(old, events, seen, got)}
    snapshots.commit(tables | (tables_after(events, registry, snapshots) if registry is not None else {}), batch)
    return counts


def source_lines(status: DataFrame) -> DataFrame:
    """A row for each source: its kind, how many events and skips it had, and why it failed, if it did; failures first."""
    return status.select("source_key", "kind", "events", "skipped", "error").orderBy(F.col("error").isNull(), "source_key")


def store_counts(snapshots: store.Snapshots) -> DataFrame:
    """A row with the state's totals: events and how many of them are published, pending and cancelled; groups, verified ones, venues and sources."""
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    rows = snapshots.read().agg(F.count("*").alias("events"), *map(of, ("published", "pending", "cancelled")))
    for table in (store.GROUPS, store.VENUES, store.SOURCES):
        if (df := snapshots.read(table)) is not None:
            more = [F.count_if(F.coalesce(F.btrim("verified_by"), F.lit("")) != "").alias("verified")] if table == store.GROUPS else []
            rows = rows.unionByName(df.agg(F.count("*").alias(table), *more), allowMissingColumns=True)
    return rows.agg(*(F.max(c).alias(c) for c in rows.columns))  # a row for each table


def report(status: DataFrame) -> DataFrame:
    """A row: sources, how many worked, events, skips, and whether the run failed, which it did if none worked."""
    ok = F.col("error").isNull()
    return status.agg(F.count("*").alias("sources"), F.count_if(ok).alias("ok"), F.coalesce(F.sum("events"), F.lit(0)).alias("events"), F.coalesce(F.sum("skipped"), F.lit(0)).alias("skipped"), (F.count_if(ok) == 0).alias("run_failed"), F.max("window_end").alias("window_end"))


def unreviewed(events: DataFrame) -> DataFrame:
    """Events with neither a venue nor an excerpt: told, never left out."""
    return events.filter("venue is null and excerpt is null")


def export(state: DataFrame, groups: DataFrame, path: str, now: Column, preview: bool = False) -> int:
    """Write the upcoming events as the feed's JSON file, whole or not at all; how many there are.

    Events are put in order by ranges and reach the file a range at a time, so
    neither a task nor the driver holds all of them.
    """
    shown = serve.upcoming(state, now, ("published", "pending") if preview else ("published",))
    at = state.agg(F.max("last_seen").alias("t")).first()["t"]
    stamp = state.sparkSession.range(1).select(dates.to_rfc3339((F.lit(at) if at is not None else now).cast("timestamp_ntz"))).first()[0]
    lines = serve.feed_lines(serve.wire(shown, groups))
    pieces = serve.feed_text((r["line"] for r in lines.toLocalIterator()), stamp, preview)
    return store.write_atomically(path, pieces) - 2  # the frame's head and foot
