"""The state of several tables: one mark, crashes between tables, replayed batches, views."""

import json
from datetime import datetime as T

import pytest
import site_stub
from pyspark.sql import functions as F

from feedloom.operators import store, surface, sync
from feedloom.sources import fetch
from feedloom.streaming import ingest

GROUP = "slug string, name string, url string, category string, aliases array<string>, venue_slug string, verified_by string, verified_at string, pos int"
VENUE = "slug string, name string, aliases array<string>, address string, city string, state string, zip string, url string, pos int"
SOURCE = "url string, group_slug string, kind string, priority int, enabled boolean"
URL = "https://linux.example/cal.ics"


def at(x):
    return F.lit(x).cast("timestamp_ntz")


@pytest.fixture(scope="module")
def registry(spark):
    make = spark.createDataFrame
    return {
        "groups": make([("linux", "Linux People", None, "tech", None, "hall", "me", "2026-01-01", 0)], GROUP), "venues": make([("hall", "Hall", ["The Hall"], "1 Main St", None, None, None, None, 0)], VENUE),
        "sources": make([(URL, "linux", "ics", 10, True), ("https://chap.example/", "linux", "bevy", 10, True)], SOURCE),
    }


def body(n, extra=""):
    lines = ["BEGIN:VCALENDAR", "BEGIN:VEVENT", f"UID:u{n}", f"SUMMARY:Night {n}{extra}", f"DTSTART:2026010{n}T180000Z", f"LOCATION:{'The Hall' if n % 2 else 'Barn'}", "END:VEVENT", "END:VCALENDAR"]
    return {"source_key": URL, "uri": URL, "kind": "ics", "body": "\r\n".join(lines), "error": None}


def test_tables_come_into_force_together(spark, registry, tmp_path):
    snaps = store.Snapshots(spark, str(tmp_path / "state"))
    rows = [(URL, URL, "ics", site_stub.ICS, None, T(2026, 1, 6), T(2026, 3, 1)), *fetch.fetch_one({"url": "https://chap.example/", "kind": "bevy"}, T(2026, 1, 6), site_stub.get, lambda _: None)]
    bodies = spark.createDataFrame(rows, fetch.SCHEMA)
    run = sync.conclude(bodies, registry, spark.createDataFrame([], "fingerprint string"), at("2026-01-04"), at("2026-03-01"))
    assert sync.save(run, snaps, at("2026-01-06"), registry)["inserted"] == 5
    assert {r.slug: (r.name, r.address) for r in snaps.read(store.VENUES).collect()} == {"hall": ("Hall", "1 Main St")}
    assert snaps.read(store.GROUPS).first().verified_at.isoformat() == "2026-01-01" and snaps.read(store.SOURCES).count() == 2
    counts = sync.store_counts(snaps).first()
    assert (counts.events, counts.published, counts.cancelled, counts.groups, counts.verified, counts.venues, counts.sources) == (5, 5, 0, 1, 1, 1, 2)
    assert [r.source_key for r in sync.source_lines(run.status).collect()] == sorted([URL, "https://chap.example/"])

    assert surface.register_views(snaps) == surface.VIEWS
    got = spark.sql("SELECT fingerprint, title, starts_at FROM events ORDER BY starts_at").collect()
    assert [r.title for r in got] == ["Lunch", "Kernel night", "Lunch", "Lunch", "Chapter day"] and got[0].starts_at == T(2026, 1, 5, 18)
    assert spark.sql("SELECT count(*) FROM event_fingerprints JOIN events ON event = events.fingerprint JOIN event_categories c ON c.fingerprint = event WHERE c.name = 'tech'").first()[0] == 5
    surface.register_functions(spark)
    assert spark.sql("SELECT local_day(starts_at) AS d, venue_slug(venue_name) AS v FROM events WHERE title = 'Kernel night'").first() == (T(2026, 1, 7).date(), "hall")


def test_a_crash_between_tables_leaves_the_old_state(spark, tmp_path):
    snaps = store.Snapshots(spark, str(tmp_path / "s"))
    good = lambda x: spark.range(1).select(F.lit(x).alias("x"))
    bad = spark.range(1).select(F.raise_error(F.lit("lost")).cast("string").alias("x"))
    snaps.commit({store.EVENTS: good("old"), store.VENUES: good("old venue")})
    with pytest.raises(Exception, match="lost"):
        snaps.commit({store.EVENTS: good("new"), store.VENUES: bad})
    assert snaps.version() == 1 and snaps.read().first().x == "old" and snaps.read(store.VENUES).first().x == "old venue"
    assert snaps.commit({store.EVENTS: good("newer")}, ("stream", 4)) == 2
    assert snaps.read().first().x == "newer" and snaps.read(store.VENUES) is None
    assert snaps.done("stream", 4) and snaps.done("stream", 3) and not snaps.done("stream", 5) and not snaps.done("other", 0)
    snaps.commit({store.EVENTS: good("last")})
    assert snaps.done("stream", 4)
    snaps.prune(keep=1)
    assert snaps.read().first().x == "last" and not (tmp_path / "s/v=000001").exists() and not (tmp_path / "s/now=2").exists()


def test_bodies_stream_and_a_replayed_batch_makes_no_version(spark, registry, tmp_path):
    (tmp_path / "in").mkdir()
    snaps, cp = store.Snapshots(spark, str(tmp_path / "state")), str(tmp_path / "cp")
    rejects = spark.createDataFrame([], "fingerprint string")

    def go(seen):
        ingest.ingest_bodies(spark, str(tmp_path / "in"), snaps, registry, rejects, at("2026-01-01"), at("2026-03-01"), cp, seen=at(seen)).awaitTermination()

    (tmp_path / "in/a.json").write_text(json.dumps(body(1)) + "\n")
    go("2026-01-02 00:00:00")
    (tmp_path / "in/b.json").write_text(json.dumps(body(2)) + "\n")
    go("2026-01-03 00:00:00")
    state = {r.fingerprint: (r.venue.name, r.status, r.first_seen.day) for r in snaps.read().collect()}
    assert state == {"ics:u1": ("Hall", "published", 2), "ics:u2": ("Barn", "published", 3)} and snaps.version() == 2
    assert sorted(r.slug for r in snaps.read(store.VENUES).collect()) == ["barn", "hall"]
    # As after a crash between the mark and Spark's own: the second batch is not known to be done, and runs again.
    (tmp_path / "cp/commits/1").unlink()
    (tmp_path / "cp/commits/.1.crc").unlink(missing_ok=True)
    go("2026-01-09 00:00:00")
    assert snaps.version() == 2 and {r.last_seen.day for r in snaps.read().collect()} == {2, 3}
    # And as after one before the mark: the batch is written anew, once.
    (tmp_path / "state/now=2").unlink()
    (tmp_path / "state/.now=2.crc").unlink(missing_ok=True)
    (tmp_path / "cp/commits/1").unlink()
    (tmp_path / "cp/commits/.1.crc").unlink(missing_ok=True)
    go("2026-01-05 00:00:00")
    assert snaps.version() == 2 and {r.fingerprint: r.first_seen.day for r in snaps.read().collect()} == {"ics:u1": 2, "ics:u2": 5}
    (tmp_path / "in/c.json").write_text(json.dumps(body(1) | {"body": "", "error": "down"}) + "\n")
    go("2026-01-06 00:00:00")
    assert snaps.version() == 2


def test_table_functions(spark):
    surface.register_functions(spark)
    spark.createDataFrame([(1, "<a href='/x'>1</a><a href=/y>2</a>"), (2, None), (3, "<div class=meeting-card-compact><p class=meeting-week>W<time datetime=z></div>")], "id int, html string").createOrReplaceTempView("some_pages")
    assert sorted(map(tuple, spark.sql("SELECT id, pos, href FROM some_pages, LATERAL page_links(html)").collect())) == [(1, 1, "/x"), (1, 2, "/y")]
    assert [tuple(r) for r in spark.sql("SELECT id, week, has_time, datetime FROM some_pages, LATERAL page_cards(html)").collect()] == [(3, "W", True, "z")]
    assert spark.sql("SELECT html_text('<b>a</b> &amp; b')").first()[0] == "a & b"
