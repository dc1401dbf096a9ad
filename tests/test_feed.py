"""The feed engine against its scenarios; synthetic rows only."""

import json
from datetime import datetime as T

import pytest
from pyspark.sql import functions as F

from feedloom.functions import addresses, names, text, urls
from feedloom.operators import normalize, recurrence, registry, serve, store
from feedloom.sources import curated, fetch, html, ics, json_calendar
from feedloom.streaming import ingest


def values(spark, f, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_names(spark):
    assert values(spark, names.fold_name, ["  The  “Lab” – Bob’s ", "", None]) == ["the \"lab\" - bob's", "", None]
    assert values(spark, names.slugify, ["Week 3 / Room_A!"]) == ["week-3-room-a"]
    assert values(spark, names.venue_slug, ["Café & Bar, 2nd"]) == ["caf-bar-2nd"]


def test_links(spark):
    given = ["example.org/a", " HTTP://example.org ", "ftp://x.org", "no dots", "https://", "https://x.org/a b", "example.org:80/x", ""]
    assert values(spark, urls.clean_url, given) == ["https://example.org/a", "http://example.org", None, None, None, "https://x.org/a%20b", None, None]
    tags = values(spark, lambda x: urls.etag_matches(x, F.lit('"t"')), ["*", 'W/"t", "u"', '"u"'])
    assert tags == [True, True, False]


def test_excerpts(spark):
    long = "word " * 80
    assert values(spark, text.html_unescape, ["A &#38; &eacute;&hellip;", None]) == ["A & é…", None]
    got = values(spark, text.excerpt, ["<p></p><p>First &amp; best&#33;</p><p>Second</p>", "https://example.org/very/long\n\nThen this", "## Head **bold** [label](http://x.org)", "​", long])
    assert got[:4] == ["First & best!", "Then this", "Head bold label", None]
    assert len(got[4].encode()) <= 223 and got[4].endswith("word…")


def test_addresses(spark):
    assert values(spark, lambda x: addresses.split_on_dash(x)[1], ["Hall - Room 2", "A – B - C", "plain"]) == ["Room 2", "B - C", None]
    assert values(spark, addresses.room_segment, ["Suite 5, 1 Main", "1 Main", "Roomy place"]) == ["Suite 5", None, None]
    a = values(spark, addresses.split_flat_address, ["1 Main St, Town, TX 77001, USA"])[0]
    assert tuple(a) == ("1 Main St", "Town", "TX", "77001")
    df = spark.createDataFrame([("The Hall Room 4", "the hall")], "i string, o string")
    assert df.select(addresses.strip_venue_prefix(F.col("i"), F.col("o"))).first()[0] == "Room 4"


RAW = "source_key string, upstream_id string, organizers array<string>, title string, start timestamp_ntz, end timestamp_ntz, all_day boolean, url string, register_url string, excerpt string, venue string, virtual boolean"
SRC = [("s:venue", "hall", "ics", 50, True), ("s:group", "club", "ics", 10, True)]
GRP = [("hall", "The Hall", None, "places", "me", 0), ("club", "Bob's Club", ["The Club"], "tech", None, 1)]
S1, S2 = T(2026, 3, 1, 18), T(2026, 3, 2, 18)


def rec(source, uid, organizers=(), title="t", start=S1, end=None, url=None, venue=None, virtual=False):
    return (source, uid, list(organizers), title, start, end, False, url, None, None, venue, virtual)


def run(spark, rows, rejects=()):
    make = spark.createDataFrame
    raw = make(rows, RAW)
    sources = make(SRC, "url string, group_slug string, kind string, priority int, enabled boolean")
    groups = make(GRP, "slug string, name string, aliases array<string>, category string, verified_by string, pos int")
    return normalize.normalize(raw, sources, groups, make([(x,) for x in rejects], "fingerprint string"))


def test_cross_feed_dedupe_fills_gaps(spark):
    rows = [rec("s:venue", "v1", title="own"), rec("s:venue", "v2", ["  bob’s CLUB"], "loser", url="https://x.org", virtual=True), rec("s:group", "g1", title="winner")]
    for order in (rows, rows[::-1]):
        events, gone, problems = run(spark, order)
        got = {r.fingerprint: r for r in events.collect()}
        assert set(got) == {"ics:v1", "ics:g1"} and gone.count() == problems.count() == 0
        m = got["ics:g1"]
        assert (m.title, m.url, m.virtual, m.sources, m.category) == ("winner", "https://x.org", True, ["ics:g1", "ics:v2"], "tech")


def test_same_feed_twice_never_merges(spark):
    rows = [rec("s:group", "g1"), rec("s:group", "g2"), rec("s:venue", "v1", ["the club"])]
    assert run(spark, rows)[0].count() == 3


def test_rejects_and_problems(spark):
    rows = [rec("s:group", "g1"), rec("s:venue", "v1", ["the club"]), rec("s:venue", "v2", start=S2), rec("s:gone", "x")]
    events, gone, problems = run(spark, rows, ["ics:v1"])
    assert [r.fingerprint for r in events.collect()] == ["ics:v2"] and gone.count() == 1
    assert [r.message for r in problems.collect()] == ["unregistered source"]


@pytest.mark.parametrize(("good", "bad", "failed"), [(7, 3, False), (6, 4, True), (4, 2, False), (3, 2, True), (2, 2, True), (3, 1, False), (0, 3, False), (1, 2, False)])
def test_skip_ratio(spark, good, bad, failed):
    df = spark.createDataFrame([(good + bad, bad)], "total int, skipped int")
    assert normalize.skip_breaker(df).first().failed is failed


EV = "fingerprint string, title string, start timestamp_ntz, status string, sources array<string>"


def test_upsert_keeps_identity_and_merges_rows(spark):
    t1, t2 = F.lit("2026-01-01").cast("timestamp_ntz"), F.lit("2026-01-02").cast("timestamp_ntz")
    empty = spark.createDataFrame([], EV + ", first_seen timestamp_ntz, last_seen timestamp_ntz")
    one = store.upsert(empty, spark.createDataFrame([("a", "A", S1, "pending", ["a"]), ("b", "B", S1, "cancelled", ["b"]), ("z", "Z", S1, "pending", ["z"])], EV), t1)
    new = spark.createDataFrame([("b", "AB", S2, "published", ["b", "a"]), ("c", "C", S1, "pending", ["c"])], EV)
    assert tuple(store.save_counts(one, new).first()) == (1, 1, 1, 1)
    two = store.upsert(one, new, t2)
    got = {r.fingerprint: r for r in two.collect()}
    assert set(got) == {"a", "c", "z"} and got["a"].title == "AB" and got["a"].status == "published"
    assert got["a"].first_seen == T(2026, 1, 1) and got["a"].last_seen == T(2026, 1, 2) and got["z"].last_seen == T(2026, 1, 1)
    again = {r.fingerprint: r for r in store.upsert(two, new, t2).collect()}
    assert again == got


def test_gate_is_closed(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "v boolean")
    assert [r[0] for r in df.select(store.gate(F.col("v"))).collect()] == ["published", "pending", "pending"]


def test_recurrence(spark):
    df = spark.createDataFrame([(T(2026, 1, 31, 9, 30),)], "s timestamp_ntz")
    at = lambda c: df.select(c.alias("x")).first().x
    s = F.col("s")
    assert [t.month for t in at(recurrence.monthly_day(s, 1, 31, 6))] == [1, 3, 5]
    assert [t.day for t in at(recurrence.monthly_nth(s, 1, "FR", -1, 3))] == [27, 27]
    assert [t.day for t in at(recurrence.bounded(recurrence.daily(s, 1, 9), count=3, exdates=F.array(s)))] == [1, 2]
    utc = at(recurrence.occurrences(recurrence.weekly(F.lit("2026-10-29 20:00").cast("timestamp_ntz"), 1, ["TH"], 2), F.lit("u"), "America/Chicago"))
    assert [o.upstream_id for o in utc] == ["u_20261030T010000Z", "u_20261106T020000Z"]


RULES = [
    ("2026-03-06 02:30", "FREQ=DAILY;COUNT=3", [306, 307, 308]), ("2026-03-05 19:00", "FREQ=WEEKLY;UNTIL=20260312", [305, 312]), ("2026-03-05 19:00", "FREQ=WEEKLY;UNTIL=20260312T235959Z", [305]),
    ("2026-03-04 19:00", "FREQ=WEEKLY;BYDAY=WE,MO;COUNT=3", [304, 309, 311]), ("2026-03-01 19:00", "FREQ=MONTHLY;BYDAY=3TH;UNTIL=20260430", [319, 416]), ("2026-01-30 19:00", "FREQ=MONTHLY;BYDAY=-1FR", [327, 424]),
    ("2026-01-31 19:00", "FREQ=MONTHLY", [331]), ("2026-03-01 19:00", "FREQ=MONTHLY;BYMONTHDAY=-1,1,31", [301, 331, 401, 430]), ("1990-03-01 19:00", "FREQ=DAILY;INTERVAL=4;UNTIL=20260305", [304]),
    ("2026-02-01 19:00", "FREQ=DAILY;COUNT=29", [301]), ("2026-03-01 19:00", None, [301]), ("2026-05-01 19:00", None, []), ("2026-05-02 19:00", "FREQ=DAILY", []),
]


def test_expand_rules(spark):
    """Occurrences in March and April in a zone whose clocks change on 8 March."""
    ntz = lambda c: c.cast("timestamp_ntz")
    df = spark.createDataFrame([(str(i), a, b) for i, (a, b, _) in enumerate(RULES)], "source_key string, wall string, rrule string")
    df = df.select("source_key", F.lit("u").alias("upstream_id"), F.convert_timezone(F.lit("America/Chicago"), F.lit("UTC"), ntz(F.col("wall"))).alias("start"), ntz(F.lit(None)).alias("end"), "rrule", F.lit(None).cast("array<timestamp_ntz>").alias("exdates"), F.lit("America/Chicago").alias("zone"))
    good, skips = recurrence.expand(df, ntz(F.lit("2026-03-01 06:00")), ntz(F.lit("2026-05-01 05:00")))
    got = good.select("source_key", F.convert_timezone(F.lit("UTC"), F.lit("America/Chicago"), "start").alias("t"), "upstream_id").orderBy("t").collect()
    assert skips.count() == 0 and all((r.upstream_id == "u") == (RULES[int(r.source_key)][1] is None) for r in got)
    for i, (start, rule, days) in enumerate(RULES):
        assert [r.t.month * 100 + r.t.day for r in got if r.source_key == str(i)] == days, (start, rule)


def test_decoded_rules_expand(spark):
    body = "\r\n".join(["BEGIN:VCALENDAR", "BEGIN:VEVENT", "UID:1", "DTSTART;TZID=America/Chicago:20261029T190000", "DTEND;TZID=America/Chicago:20261029T210000", "RRULE:FREQ=WEEKLY;COUNT=4", "EXDATE;TZID=America/Chicago:20261112T190000,20261105T190000", "END:VEVENT",
                         "BEGIN:VEVENT", "UID:2", "DTSTART:20261029T190000Z", "RRULE:FREQ=YEARLY", "END:VEVENT", "BEGIN:VEVENT", "UID:3", "DTSTART:20261029T190000Z", "END:VEVENT", "BEGIN:VEVENT", "UID:4", "DTSTART:20261029T190000Z", "RRULE:FREQ=DAILY", "EXDATE:,soon", "END:VEVENT", "END:VCALENDAR"])
    good, _ = ics.decode(spark.createDataFrame([("k", body)], "source_key string, body string"))
    out, skips = recurrence.expand(good, F.lit("2026-10-01").cast("timestamp_ntz"), F.lit("2026-12-01").cast("timestamp_ntz"))
    got = {r.upstream_id: (r.start, r.end) for r in out.collect()}
    assert got == {"1_20261030T000000Z": (T(2026, 10, 30, 0), T(2026, 10, 30, 2)), "1_20261120T010000Z": (T(2026, 11, 20, 1), T(2026, 11, 20, 3)), "3": (T(2026, 10, 29, 19), None)}
    assert sorted((r.ref, r.reason) for r in skips.collect()) == [("2", "rule refused (frequency): FREQ=YEARLY"), ("4", "rule refused (excluded date): FREQ=DAILY")]


def test_calendar_decoder(spark):
    body = "\r\n".join(["BEGIN:VCALENDAR", "BEGIN:VTIMEZONE", "DTSTART:19700101T000000", "END:VTIMEZONE", "BEGIN:VEVENT", "UID:1", "SUMMARY:A\\, b\\n\\\\n", "  c", "DTSTART;TZID=America/Chicago:20260701T190000", "ATTENDEE:mailto:x@example.org",
                         "BEGIN:VALARM", "DESCRIPTION:alarm", "END:VALARM", "END:VEVENT", "BEGIN:VEVENT", "UID:2", "DTSTART;VALUE=DATE:20260702", "END:VEVENT", "BEGIN:VEVENT", "UID:3", "DTSTART;TZID=Mars/Base:20260701T190000", "END:VEVENT",
                         "BEGIN:VEVENT", "UID:4", "STATUS:cancelled", "DTSTART:bad", "END:VEVENT", "BEGIN:VEVENT", "SUMMARY:no id", "DTSTART:20260701T190000Z", "END:VEVENT", "END:VCALENDAR"])
    good, skips = ics.decode(spark.createDataFrame([("k", body)], "source_key string, body string"))
    got = {r.upstream_id: r for r in good.collect()}
    assert set(got) == {"1", "2"} and got["1"].title == "A, b\n\\n c" and got["1"].start == T(2026, 7, 2, 0) and got["1"].description is None
    assert got["2"].all_day and got["2"].start == T(2026, 7, 2, 5)
    assert sorted(r.reason for r in skips.collect()) == ["bad DTSTART", "no UID"]


def test_broken_calendars(spark):
    cut = "BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:1\r\nDTSTART:20260701T190000Z\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nUID:2\r\nDTSTART:20260701T190000Z"
    good, skips = ics.decode(spark.createDataFrame([("cut", cut), ("page", "<html>"), ("none", None)], "source_key string, body string"))
    assert [r.upstream_id for r in good.collect()] == ["1"]
    assert sorted((r.source_key, r.ref, r.reason) for r in skips.collect()) == [("cut", "2", "no END:VEVENT"), ("none", "document", "no VCALENDAR"), ("page", "document", "no VCALENDAR")]


def test_json_calendar(spark):
    page = {"total": 3, "events": [{"global_id": "1", "utc_start_date": "2026-01-01 10:00:00", "venue": {"venue": "V"}}, {"global_id": "2", "utc_start_date": "2026-01-01 10:00:00", "venue": [{"venue": "A"}, {"venue": "B"}]}, {"utc_start_date": "x"}]}
    good, skips = json_calendar.decode(spark.createDataFrame([("k", json.dumps(page))], "source_key string, body string"))
    assert {r.upstream_id: [v.name for v in r.venues] for r in good.collect()} == {"1": ["V"], "2": ["A", "B"]} and skips.count() == 1


PAGE = """<link rel="canonical" href="https://example.org/events/x/"><div class="meeting-card-compact big"><b class="meeting-week">Week
 1</b><time datetime="2026-01-01T18:00:00-05:00"></time></div><div class=meeting-card-compact><p>no time</p></div><script type="application/ld+json">{bad</script>
<script type="application/ld+json">[{"@type": ["Thing", "Event"], "name": "N"}]</script>"""


def test_html(spark):
    df = spark.createDataFrame([("k", PAGE), ("n", None)], "source_key string, body string")
    cards = sorted((tuple(r) for r in html.cards(df).collect()), key=str)
    assert cards == [("k", 0, "Week 1", True, "2026-01-01T18:00:00-05:00", None), ("k", 1, None, False, None, None), ("n", None, None, None, None, None)]
    got = {r.source_key: r for r in html.linked_events(df).collect()}
    assert got["k"].canonical == "https://example.org/events/x/" and got["k"].event.name == "N" and got["n"].event is None
    since, to = (F.lit(x).cast("timestamp_ntz") for x in ("2025-12-30", "2026-03-01"))
    good, skips = html.decode_cards(df, "Club", since, to)
    assert [(r.upstream_id, r.title, r.start) for r in good.collect()] == [("week-1_20260101T230000Z", "Club, Week 1", T(2026, 1, 1, 23))]
    assert sorted((r.ref, r.reason) for r in skips.collect()) == [("card 1", "no label"), ("document", "no cards")]
    good, skips = html.decode_linked(df, since, to)
    assert good.count() == 0 and sorted(r.reason for r in skips.collect()) == ["bad start", "no event"]
    assert html.event_links("https://e.org/c/", ["/events/details/a/?q=1", "https://e.org/events/details/a/#x", "http://e.org/events/details/b/", "/other/"]) == ["https://e.org/events/details/a/"]


def test_fetch_isolates_failures():
    now = T(2026, 1, 1)
    site = {"a": (200, b"BEGIN:VCALENDAR"), "b": (500, b"")}
    rows = fetch.fetch_one({"url": "a", "kind": "ics"}, now, site.__getitem__) + fetch.fetch_one({"url": "b", "kind": "ics"}, now, site.__getitem__) + fetch.fetch_one({"url": "a", "kind": "x"}, now, site.__getitem__)
    assert [(r[3], r[4]) for r in rows] == [("BEGIN:VCALENDAR", None), (None, "status 500"), (None, "unknown kind x")]
    seen = []

    def pages(u):
        seen.append(u)
        return 200, json.dumps({"next_rest_url": "https://x.org/p2" if len(seen) == 1 else None}).encode()

    assert len(fetch.fetch_one({"url": "https://x.org/p", "kind": "tribe"}, now, pages)) == 2
    assert fetch.fetch_one({"url": "https://y.org/p", "kind": "tribe"}, now, lambda u: (200, b'{"next_rest_url": "https://x.org/"}'))[0][4] == "next page is on another site"


def test_registry(spark, tmp_path):
    (tmp_path / "groups").mkdir()
    (tmp_path / "venues").mkdir()
    (tmp_path / "groups/a.yaml").write_text("name: Same\nverified_by: me\nvenue: nowhere\nodd: 1\nsources:\n- {url: 'http://x.org', kind: rss}\n")
    (tmp_path / "groups/b.yaml").write_text("name: b\naliases: [same]\n")
    (tmp_path / "groups/notes.txt").write_text("x")
    got = curated.load(spark, str(tmp_path))
    found = got["problems"].unionByName(registry.problems(got["groups"], got["venues"], got["sources"]))
    assert sorted(r.message for r in found.collect()) == ["name claimed twice: same", "only <slug>.yaml files belong here", "unknown key odd", "unknown kind", "url must be absolute https", "venue does not exist", "verified_by needs verified_at"]
    assert curated.load_rejects(spark, str(tmp_path / "none.yaml")).count() == 0


def test_serving(spark):
    df = spark.createDataFrame([("b", S2, None), ("a", S1, "u")], "id string, start timestamp_ntz, url string")
    body = json.loads(serve.feed_json(df, F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")).first().body)
    assert [e["id"] for e in body["events"]] == ["a", "b"] and "url" not in body["events"][1] and "preview" not in body and body["generated_at"] == "2026-01-01T00:00:00Z"


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [dict(zip([c.split()[0] for c in RAW.split(", ")], [x.isoformat() if isinstance(x, T) else x for x in rec("s:group", f"g{i}", start=S1)], strict=True)) for i in range(2)]
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, rows)))
    make, snaps = spark.createDataFrame, store.Snapshots(spark, str(tmp_path / "state"))
    sources = make(SRC, "url string, group_slug string, kind string, priority int, enabled boolean")
    groups = make(GRP, "slug string, name string, aliases array<string>, category string, verified_by string, pos int")
    args = (spark, str(tmp_path / "in"), RAW, snaps, sources, groups, make([], "fingerprint string"), str(tmp_path / "cp"), F.lit("2026-01-01").cast("timestamp_ntz"))
    ingest.ingest(*args).awaitTermination()
    (tmp_path / "in/b.json").write_text(json.dumps(rows[0] | {"title": "new"}))
    ingest.ingest(*args).awaitTermination()
    assert snaps.version() == 2 and sorted((r.fingerprint, r.title, r.status) for r in snaps.read().collect()) == [("ics:g0", "new", "pending"), ("ics:g1", "t", "pending")]
