"""A run from bodies to the exported feed: four kinds of sources, one of them down, one switched off."""

import json
from datetime import datetime as T

import pytest
from pyspark.sql import functions as F

from feedloom.operators import normalize, serve, store, sync, venues
from feedloom.sources import curated, fetch

GROUPS = {
    "hall": "name: The Hall Company\nvenue: hall\nverified_by: me\nverified_at: 2026-01-01\ncategory: places\nsources:\n- {url: 'https://hall.example/json', kind: tribe, priority: 50}\n- {url: 'https://off.example/', kind: ics, enabled: false}\n",
    "linux": "name: Linux People\nverified_by: me\nverified_at: 2026-01-01\ncategory: tech\nvenue: hall\nsources:\n- {url: 'https://linux.example/cal.ics', kind: ics}\n",
    "open": "name: Open Society\nsources:\n- {url: 'https://open.example/', kind: html}\n- {url: 'https://down.example/cal.ics', kind: ics}\n",
    "chapter": "name: Chapter\nverified_by: me\nverified_at: 2026-01-01\nsources:\n- {url: 'https://chap.example/', kind: bevy}\n",
}
NOW = "2026-01-06 12:00:00"


def at(x):
    return F.lit(x).cast("timestamp_ntz")


@pytest.fixture(scope="module")
def registry(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("registry")
    (root / "groups").mkdir()
    (root / "venues").mkdir()
    for slug, text in GROUPS.items():
        (root / f"groups/{slug}.yaml").write_text(text)
    (root / "venues/hall.yaml").write_text("name: Hall\naliases: [The Hall]\naddress: 1 Main St\ncity: Town\n")
    got = curated.load(spark, str(root))
    assert got["problems"].count() == 0
    return got


@pytest.fixture(scope="module")
def bodies(spark, registry):
    spark.dataSource.register(fetch.FeedSource)
    asked = [r.asDict() for r in normalize.enabled(registry["sources"]).select("url", "kind").collect()]
    assert len(asked) == 5
    got = spark.read.format("feed").option("sources", json.dumps(asked)).option("now", NOW.replace(" ", "T")).option("transport", "site_stub:get").load()
    assert got.rdd.getNumPartitions() == 4
    return got.cache()


def test_run(spark, registry, bodies, tmp_path):
    rejects = spark.createDataFrame([("html:first-wednesday_20991231T000000Z", "test")], "fingerprint string, reason string")
    window = at("2026-01-04 12:00:00"), at("2026-03-07 12:00:00")
    run = sync.conclude(bodies, registry, rejects, *window, title="Open Society")
    status = {r.source_key: (r.error, r.events, r.skipped) for r in run.status.collect()}
    assert status == {
        "https://hall.example/json": (None, 2, 1), "https://linux.example/cal.ics": (None, 4, 0), "https://open.example/": (None, 1, 0), "https://chap.example/": (None, 1, 0), "https://down.example/cal.ics": ("no route", 0, 0),
    }
    assert tuple(sync.report(run.status).select("sources", "ok", "events", "skipped", "run_failed").first()) == (5, 4, 8, 1, False)
    events = {r.fingerprint: r for r in run.events.collect()}
    both = events["ics:own"]  # the group's own record wins, the venue's list fills in
    assert (both.title, both.venue.name, both.room, both.end, both.excerpt, both.url, both.status) == ("Kernel night", "Hall", "Room 30", T(2026, 1, 8, 2), "Talks & pizza", "https://hall.example/e/1", "published")
    assert both.sources == ["ics:own", "tribe:v1"] and both.categories == ["tech"] and both.venue.address == "1 Main St"
    assert events["tribe:v2"].venue.name == "Barn" and events["tribe:v2"].group_slug == "hall"
    lunches = sorted(k for k in events if k.startswith("ics:weekly_"))
    assert lunches == ["ics:weekly_20260105T180000Z", "ics:weekly_20260112T180000Z", "ics:weekly_20260119T180000Z"] and all(events[k].venue.name == "Hall" for k in lunches)
    card = events["html:first-wednesday_20260115T000000Z"]
    assert (card.title, card.venue.name, card.status, card.venue.city) == ("Open Society, First Wednesday", "Hall", "pending", "Town")
    assert events["bevy:chap.example/events/details/a/"].virtual and len(events) == 7 and run.problems.count() == 0
    snaps = store.Snapshots(spark, str(tmp_path / "state"))
    assert sync.save(run, snaps, at(NOW)) == {"inserted": 7, "updated": 0, "promoted": 0, "merged": 0, "merged_records": 1}
    verified = registry | {"groups": registry["groups"].withColumn("verified_by", F.lit("all"))}
    again = sync.conclude(bodies, verified, rejects, *window, title="Open Society")
    assert sync.save(again, snaps, at("2026-01-07 12:00:00")) == {"inserted": 0, "updated": 7, "promoted": 1, "merged": 0, "merged_records": 1}
    state = snaps.read()
    assert {(r.first_seen, r.last_seen) for r in state.collect()} == {(T(2026, 1, 6, 12), T(2026, 1, 7, 12))}
    out = tmp_path / "events.json"
    assert sync.export(state, registry["groups"], str(out), at("2026-01-08 00:00:00")) == 6
    text = out.read_text()
    feed = json.loads(text)
    assert text.endswith("}\n") and "\n  " in text and feed["generated_at"] == "2026-01-07T12:00:00Z" and "preview" not in feed
    assert [e["id"] for e in feed["events"]][:2] == ["ics:own", "tribe:v2"] and feed["events"][0]["sources"] == 2 and "pending" not in feed["events"][0]
    assert feed["events"][0]["group"] == {"slug": "linux", "name": "Linux People"} and feed["events"][0]["venue"] == {"name": "Hall", "address": "1 Main St", "city": "Town"}
    one = serve.read_feed(spark, [str(tmp_path / "none.json"), str(out)]).first()
    assert len(one.events) == 6 and one.events[0].group.name == "Linux People"
    with pytest.raises(FileNotFoundError):
        serve.read_feed(spark, [str(tmp_path / "none.json")])
    assert sync.unreviewed(run.events).count() == 1


def test_a_run_without_a_source_writes_nothing(spark, registry, bodies, tmp_path):
    rejects = spark.createDataFrame([], "fingerprint string")
    run = sync.conclude(bodies.filter("source_key like '%down%'"), registry, rejects, at("2026-01-01"), at("2026-03-01"))
    snaps = store.Snapshots(spark, str(tmp_path / "state"))
    with pytest.raises(RuntimeError):
        sync.save(run, snaps, at(NOW))
    assert snaps.version() is None and run.events.count() == 0


def test_a_failed_page_fails_its_source(spark, bodies):
    page = bodies.filter("kind = 'tribe'")
    broken = page.withColumn("uri", F.lit("p2")).withColumn("body", F.lit("<html>"))
    records, skips = sync.decode(page.unionByName(broken), at("2026-01-01"), at("2026-03-01"), "x")
    status = sync.source_status(page.unionByName(broken), records, skips).first()
    assert (status.error, status.events) == ("a document cannot be read", 0)


def test_store_rules(spark, tmp_path):
    make = spark.createDataFrame
    schema = "fingerprint string, start timestamp_ntz, sources array<string>"
    with pytest.raises(ValueError, match="no sources"):
        store.check(make([("a", T(2026, 1, 1), [])], schema), at(NOW))
    with pytest.raises(ValueError, match="no instant"):
        store.check(make([], schema), F.lit(None).cast("timestamp_ntz"))
    with pytest.raises(ValueError, match="unknown source"):
        store.check(make([("a", T(2026, 1, 1), ["rss:1"])], schema), at(NOW), make([("ics",)], "kind string"))
    snaps = store.Snapshots(spark, str(tmp_path / "s"))
    assert snaps.write(make([(1,)], "x int")) == 1
    (tmp_path / "s/claim=2").touch()  # another writer
    with pytest.raises(RuntimeError, match="another run"):
        snaps.write(make([(2,)], "x int"))
    assert snaps.read().first().x == 1
    old, new = make([("a", "x"), ("b", "y")], "slug string, url string"), make([("b", "z"), ("c", "w")], "slug string, url string")
    assert sorted(map(tuple, store.mirror(old, new, "slug").collect())) == [("a", "x"), ("b", "z"), ("c", "w")]


def test_cancelling_is_off_by_default(spark):
    make = spark.createDataFrame
    state = make([("a", T(2026, 1, 10), "published"), ("b", T(2026, 1, 10), "published"), ("c", T(2026, 3, 1), "published")], "fingerprint string, start timestamp_ntz, status string")
    seen = make([("a",)], "fingerprint string")
    run = lambda **kw: {r.fingerprint: r.status for r in store.cancel_missing(state, seen, at("2026-01-01"), at("2026-03-01"), **kw).collect()}
    assert set(run(clean=True).values()) == set(run(clean=False, enabled=True).values()) == {"published"}
    assert run(clean=True, enabled=True) == {"a": "published", "b": "cancelled", "c": "published"}


def test_venue_tables(spark):
    fields = "address string, city string, state string, zip string, url string"
    old = spark.createDataFrame([("hall", "Hall", None, "Town", None, None, None)], f"slug string, name string, {fields}")
    seen = spark.createDataFrame([("Hall", "1 Main", "Elsewhere", None, None, None), ("HALL", "2 Main", None, None, None, None), ("Barn", None, None, None, None, None)], f"name string, {fields}")
    got = {r.slug: (r.name, r.address, r.city) for r in venues.venue_rows(old, seen).collect()}
    assert got == {"hall": ("HALL", "1 Main", "Town"), "barn": ("Barn", None, None)}
