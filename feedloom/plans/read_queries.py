"""Further registered feed queries: venues, decoders, the read path and the store's rules, with DuckDB SQL of the same rows.

The tables stand in as in :mod:`.queries`; nations are curated venues, suppliers
records that name a place, line items the children of events.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import normalize, serve, store, surface, sync, venues
from ..sources import html as html_source
from ..sources import ics, json_calendar
from ..streaming import absence, ingest
from .queries import SPLIT, ntz, query, skip_breaker, table


def _nations(spark, d):
    n = table(spark, d, "nation")
    cols = [F.concat(F.lit("n-"), F.col("n_nationkey").cast("string")).alias("slug"), F.col("n_name").alias("name"), F.array(F.concat(F.lit("The "), "n_name")).alias("aliases")]
    place = [F.lit(x).cast("string").alias(f) for f, x in zip(venues.FIELDS, ("1 Square", "Capital", None, None, None), strict=True)]
    return n.select("n_nationkey", *cols, *place, F.col("n_nationkey").alias("pos"))


def _placed(spark, d):
    """Suppliers whose texts name a place in each of the forms that there are."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    k, n = F.col("s_suppkey").cast("string"), F.col("n_name")
    one = lambda *parts: F.array(F.struct(F.concat(*parts).alias("name"), *(F.lit(None).cast("string").alias(f) for f in venues.FIELDS[:3]), F.when(F.col("s_suppkey") % 3 == 0, "77009").alias("zip"), F.lit(None).cast("string").alias("url")).cast(venues.VENUE))
    two = lambda a, b: F.concat(a, b)
    forms = [
        two(one(n, F.lit(" – Lobby")), one(n)), two(one(F.lit("Yard "), k), one(n)), one(F.lit("the  "), F.lower(n)), one(n, F.lit(" - Room 5")),
        one(F.lit("The "), n, F.lit(", Suite 9, 1 Main St, Town, TX 77001, USA")), one(F.lit("Cafe "), k, F.lit(", 12 High St, Town, TX 77001, USA")), one(F.lit("Barn "), k), two(one(n), one(n)),
    ]
    chosen = F.when(F.col("s_suppkey") % 9 < 8, F.get(F.array(*forms), (F.col("s_suppkey") % 9).cast("int")))
    return s.select("s_suppkey", "s_nationkey", chosen.alias("venues"))


_KNOWN = "k IN (0, 2, 3, 4, 7)"


@query(f"""WITH s AS (SELECT s_suppkey, n_name, s_suppkey % 9 AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT s_suppkey, CASE WHEN {_KNOWN} THEN n_name WHEN k = 1 THEN 'Yard ' || s_suppkey WHEN k = 5 THEN 'Cafe ' || s_suppkey WHEN k = 6 THEN 'Barn ' || s_suppkey END AS venue,
CASE k WHEN 0 THEN 'Lobby' WHEN 3 THEN 'Room 5' WHEN 4 THEN 'Suite 9' END AS room, CASE WHEN k < 8 THEN {_KNOWN} END AS curated,
CASE WHEN {_KNOWN} THEN '1 Square' WHEN k = 5 THEN '12 High St' END AS address, CASE WHEN {_KNOWN} THEN 'Capital' WHEN k = 5 THEN 'Town' END AS city, CASE WHEN k = 5 THEN 'TX' END AS state,
CASE WHEN k = 5 THEN '77001' WHEN k IN (1, 6) AND s_suppkey % 3 = 0 THEN '77009' END AS zip FROM s""")
def resolve_venues(spark, d):
    """All eight rules: nothing, room and building, another building, curated, dash, flat line known and unknown, and a bare name."""
    got = venues.resolve_venues(_placed(spark, d), venues.curated_keys(_nations(spark, d)), ["s_suppkey"])
    return got.select("s_suppkey", "place.venue.name", "place.room", "place.curated", *(f"place.venue.{f}" for f in venues.FIELDS[:4])).withColumnRenamed("name", "venue")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 9 < 8 THEN 'own' WHEN s_nationkey % 2 = 0 THEN n_name END AS venue FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def default_venues(spark, d):
    curated = venues.curated_keys(_nations(spark, d))
    s = venues.resolve_venues(_placed(spark, d), curated, ["s_suppkey"]).withColumn("group_slug", F.col("s_nationkey").cast("string"))
    groups = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("slug"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("n-"), F.col("n_nationkey").cast("string"))).alias("venue_slug"))
    got = venues.default_venues(s, groups, curated)
    return got.select("s_suppkey", F.when(F.size("venues") > 0, F.lit("own")).otherwise(F.col("place.venue.name")).alias("venue"))


@query("""WITH r AS (SELECT s_suppkey, s_nationkey, s_suppkey % 9 IN (0, 2, 3, 4, 7) AS curated FROM supplier WHERE s_suppkey % 9 < 8)
SELECT s_nationkey, coalesce(arg_min(s_suppkey, s_suppkey) FILTER (curated), min(s_suppkey)) AS from_record FROM r GROUP BY s_nationkey""")
def curated_first(spark, d):
    """Of a nation's records the first with a curated venue gives the place, else the first with any."""
    r = venues.resolve_venues(_placed(spark, d), venues.curated_keys(_nations(spark, d)), ["s_suppkey"])
    r = r.filter("place is not null").withColumns({"uncurated": ~F.col("place.curated"), "entity": F.lit(None).cast("string"), "place": F.struct("s_suppkey", "place")})
    m = normalize.merge_records(r, ["s_nationkey"], ["s_suppkey"], [], [], source="s_suppkey", best={"place": ["uncurated", "s_suppkey"]})
    return m.select("s_nationkey", F.col("place.s_suppkey").alias("from_record"))


_SEEN = "seen AS (SELECT s_name AS name, 'N' || s_nationkey AS city FROM supplier UNION ALL SELECT upper(s_name), 'X' FROM supplier WHERE s_suppkey % 5 = 0)"


@query(f"""WITH old AS (SELECT s_name AS name, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, CASE WHEN s_nationkey % 2 = 0 THEN 'C' || s_nationkey END AS city FROM supplier WHERE s_nationkey < 12), {_SEEN},
r AS (SELECT coalesce(o.name, s.name) AS name, coalesce(o.slug, trim(regexp_replace(lower(s.name), '[^a-z0-9]+', '-', 'g'), '-')) AS slug, o.slug IS NULL AS fresh, coalesce(o.city, s.city) AS city FROM old o FULL JOIN seen s ON o.name = s.name)
SELECT slug, arg_max(name, (fresh, name)) AS name, coalesce(min(city) FILTER (NOT fresh), arg_max(city, (fresh, name))) AS city FROM r GROUP BY slug""")
def venue_table(spark, d):
    """Known names are filled in; a name whose slug is taken renames that row."""
    s = table(spark, d, "supplier")
    more = [F.lit(None).cast("string").alias(f) for f in ("address", "state", "zip", "url")]
    slug = F.btrim(F.regexp_replace(F.lower("s_name"), "[^a-z0-9]+", "-"), F.lit("-"))
    old = s.filter("s_nationkey < 12").select(F.col("s_name").alias("name"), slug.alias("slug"), F.when(F.col("s_nationkey") % 2 == 0, F.concat(F.lit("C"), "s_nationkey")).alias("city"), *more)
    seen = s.select(F.col("s_name").alias("name"), F.concat(F.lit("N"), "s_nationkey").alias("city"), *more)
    seen = seen.unionByName(s.filter("s_suppkey % 5 = 0").select(F.upper("s_name").alias("name"), F.lit("X").alias("city"), *more))
    return venues.venue_rows(old, seen).select("slug", "name", "city")


def _user_pages(spark, d):
    """A JSON page for each user, with the user's events; every seventh has no id, every eleventh a bad end."""
    e, k = table(spark, d, "events"), F.col("event_id")
    item = F.struct(
        F.when(k % 7 > 0, F.concat(F.lit("e"), k.cast("string"))).alias("global_id"), F.concat(F.lit("A &amp; B &#8211; "), "event_type").alias("title"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("utc_start_date"),
        F.when(k % 11 == 0, F.lit("soon")).alias("utc_end_date"), F.lit(" example.org/x y ").alias("url"), F.lit("example.org/in").alias("website"), F.struct(F.concat(F.lit("Hall &quot;"), "event_type", F.lit("&quot;")).alias("venue")).alias("venue"),
        F.array(F.struct(F.lit("R&amp;D").alias("organizer"))).alias("organizer"),
    )
    pages = e.groupBy(F.col("user_id").cast("string").alias("source_key")).agg(F.collect_list(item).alias("events"))
    return pages.select("source_key", F.when(F.col("source_key").endswith("9"), F.lit("<html>")).otherwise(F.to_json(F.struct(F.size("events").alias("total"), "events"))).alias("body"))


@query("""SELECT CAST(user_id AS VARCHAR) AS source_key, 'e' || event_id AS upstream_id, 'A & B – ' || event_type AS title, date_trunc('second', ts) AS start, CAST(NULL AS VARCHAR) AS url, 'https://example.org/in' AS register_url, 'Hall "' || event_type || '"' AS venue, 'R&D' AS organizer
FROM events WHERE event_id % 7 > 0 AND event_id % 11 > 0 AND NOT ends_with(CAST(user_id AS VARCHAR), '9')""")
def decoded_pages(spark, d):
    good, _ = json_calendar.decode(_user_pages(spark, d))
    return good.select("source_key", "upstream_id", "title", "start", "url", "register_url", F.get("venues", F.lit(0))["name"].alias("venue"), F.get("organizers", F.lit(0)).alias("organizer"))


@query("""WITH p AS (SELECT CAST(user_id AS VARCHAR) AS source_key, event_id, event_type FROM events)
SELECT source_key, 'no list of events' AS reason, CAST(1 AS BIGINT) AS n FROM p WHERE ends_with(source_key, '9') GROUP BY source_key
UNION ALL SELECT source_key, CASE WHEN event_id % 7 = 0 THEN 'no id' ELSE 'bad end' END, count(*) FROM p WHERE NOT ends_with(source_key, '9') AND (event_id % 7 = 0 OR event_id % 11 = 0) GROUP BY 1, 2""")
def page_skips(spark, d):
    _, bad = json_calendar.decode(_user_pages(spark, d))
    return bad.groupBy("source_key", "reason").agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate + to_hours(CAST(o_orderkey % 20 AS INTEGER)) AS t FROM orders WHERE o_orderkey % 6 > 1),
w AS (SELECT * FROM o WHERE t BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1997-06-30'),
f AS (SELECT o_custkey, t, min(o_orderkey) AS o_orderkey FROM w GROUP BY ALL)
SELECT CAST(o_custkey AS VARCHAR) AS source_key, 'week-' || o_orderkey || '_' || strftime(t, '%Y%m%dT%H%M%SZ') AS upstream_id, 'Club, Week ' || o_orderkey AS title, t AS start, CASE WHEN o_orderkey % 2 = 0 THEN 'Hall & Co' END AS venue FROM f""")
def decoded_cards(spark, d):
    """A schedule page for each customer; a sixth of the cards has no label, a sixth no time; attributes in all forms, and tags that never end or never began."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    at = F.date_format(F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (k % 20).cast("int")), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    card = F.concat(
        F.lit("<div class='x meeting-card-compact'><br><p>one<ul><li>two<li>three</b></ul></span>"), F.when(k % 6 == 0, "").otherwise(F.concat(F.lit("<h3 title='a>b' class=meeting-week> Week <b>"), k.cast("string"), F.lit("</b></h3>"))),
        F.when(k % 2 == 0, F.lit('<p class="meeting-location">Hall &amp; Co</p>')).otherwise(""), F.when(k % 6 == 1, "").otherwise(F.concat(F.lit('<time datetime="'), at, F.lit('">then</time>'))), F.lit("</div>"),
    )
    pages = o.groupBy(F.col("o_custkey").cast("string").alias("source_key")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", card.alias("c")))), lambda x: x["c"]), "\n").alias("body"))
    good, _ = html_source.decode_cards(pages, "Club", ntz("1995-01-01"), ntz("1997-06-30"))
    return good.select("source_key", "upstream_id", "title", "start", F.get("venues", F.lit(0))["name"].alias("venue"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS source_key, 'example.org/e/' || p_partkey || '/' AS upstream_id, p_name || ' & more' AS title, TIMESTAMP '2026-03-01 18:00:00' + to_hours(CAST(p_size AS INTEGER)) AS start, p_size % 2 = 0 AS virtual, CASE WHEN p_size % 3 = 0 THEN p_brand END AS venue, CASE WHEN p_size % 3 = 0 THEN '1 Main St' END AS address
FROM part WHERE p_partkey % 10 > 2""")
def decoded_linked(spark, d):
    """An event page for each part; of ten one is cancelled, one has no canonical link, and one a start without an offset."""
    p, k, n = table(spark, d, "part"), F.col("p_partkey"), F.col("p_size")
    start = F.date_format(F.lit("2026-03-01 20:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), n.cast("int")), "yyyy-MM-dd'T'HH:mm:ss")
    where = F.when(n % 3 == 0, F.array(F.struct(F.lit("Place").alias("@type"), F.col("p_brand").alias("name"), F.lit("1 Main St").alias("address"))))
    event = F.to_json(F.struct(
        F.array(F.lit("Event"), F.lit("SocialEvent")).alias("@type"), F.concat("p_name", F.lit(" &amp; more")).alias("name"), F.concat(start, F.when(k % 10 == 2, "").otherwise("+02:00")).alias("startDate"),
        F.when(k % 10 == 0, F.lit("https://schema.org/EventCancelled")).alias("eventStatus"), F.concat(F.lit("https://schema.org/"), F.when(n % 2 == 0, "Mixed").otherwise("Offline"), F.lit("EventAttendanceMode")).alias("eventAttendanceMode"), where.alias("location"),
    ))
    link = F.when(k % 10 == 1, "").otherwise(F.concat(F.lit('<link rel="x canonical" href="https://example.org/e/'), k.cast("string"), F.lit('/?q=1">')))
    body = F.concat(F.lit("<html><head>"), link, F.lit('<script type="application/ld+json">{oops</script><script type="application/ld+json">[{"@type": "Other"}, '), event, F.lit("]</script></head></html>"))
    good, _ = html_source.decode_linked(p.select(k.cast("string").alias("source_key"), body.alias("body")), ntz("2020-01-01"), ntz("2030-01-01"))
    return good.select("source_key", "upstream_id", "title", "start", "virtual", F.get("venues", F.lit(0))["name"].alias("venue"), F.get("venues", F.lit(0))["address"].alias("address"))


@query("SELECT c_custkey FROM customer WHERE c_custkey % 3 > 0")
def enabled_sources(spark, d):
    return normalize.enabled(table(spark, d, "customer").withColumn("enabled", F.col("c_custkey") % 3 > 0)).select("c_custkey")


@query("""WITH u AS (SELECT user_id FROM events GROUP BY user_id HAVING count(*) >= 4 AND count(*) FILTER (value > 60) * 3 > count(*))
SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM u)""")
def of_successful(spark, d):
    """A source with too many skips has failed, and brings nothing at all."""
    status = skip_breaker(spark, d).select(F.col("user_id").alias("source_key"), F.when(F.col("failed"), "too many skips").alias("error"))
    return normalize.of_successful(table(spark, d, "events").withColumn("source_key", F.col("user_id")), status).select("event_id")


@query("""WITH s AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_id % 7 = 0 OR event_id % 11 = 0) AS bad FROM events GROUP BY user_id),
r AS (SELECT CAST(user_id AS VARCHAR) AS source_key, CASE WHEN ends_with(CAST(user_id AS VARCHAR), '9') THEN 'a document cannot be read' WHEN n >= 4 AND bad * 3 > n THEN 'too many skips' END AS error, n, bad FROM s)
SELECT source_key, error, CASE WHEN error IS NULL THEN n - bad ELSE 0 END AS events, CASE WHEN ends_with(source_key, '9') THEN 0 ELSE bad END AS skipped FROM r""")
def source_status(spark, d):
    """Bodies to records and skips to each source's fate."""
    pages = _user_pages(spark, d)
    bodies = pages.select("source_key", F.lit("p1").alias("uri"), F.lit("tribe").alias("kind"), "body", F.lit(None).cast("string").alias("error"), ntz(SPLIT).alias("window_end"))
    records, skips = sync.decode(bodies, ntz("2000-01-01"), ntz("2100-01-01"), "Club")
    return sync.source_status(bodies, records, skips).select("source_key", "error", "events", "skipped")


@query("""SELECT event_id, event_type, coalesce(c_name, '') AS c_name, coalesce(c_mktsegment, '') AS c_mktsegment FROM events LEFT JOIN customer ON c_custkey = user_id * 2""")
def with_venues(spark, d):
    v = table(spark, d, "customer").select(F.col("c_custkey").alias("venue_id"), "c_name", "c_mktsegment")
    return serve.with_venues(table(spark, d, "events").select("event_id", "event_type", (F.col("user_id") * 2).alias("venue_id")), v).drop("venue_id")


@query("""SELECT o_orderkey, string_agg(s_nationkey || ':' || l_linenumber || ':' || s_name, ',' ORDER BY s_nationkey, l_linenumber, s_name) AS sources FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY o_orderkey""")
def with_provenance(spark, d):
    e = table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"))
    fps = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").alias("fingerprint"), F.col("l_suppkey").alias("source_id"))
    src = table(spark, d, "supplier").select(F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("url"), F.col("s_nationkey").alias("priority"))
    got = serve.with_provenance(e, fps, src)
    told = F.array_join(F.transform("sources", lambda x: F.concat_ws(":", x["priority"].cast("string"), x["fingerprint"].cast("string"), x["source_key"])), ",")
    return got.select(F.col("event_id").alias("o_orderkey"), told.alias("sources"))


@query("""SELECT o_orderkey, string_agg(l_linestatus || l_returnflag, ',' ORDER BY l_linenumber, l_linestatus || l_returnflag) AS categories FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def with_categories(spark, d):
    e = table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"))
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").alias("position"), F.concat("l_linestatus", "l_returnflag").alias("name"))
    return serve.with_categories(e, c).select(F.col("event_id").alias("o_orderkey"), F.array_join("categories", ",").alias("categories"))


@query("""SELECT 'ics:' || event_id AS id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS start, CASE WHEN value > 50 THEN strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%SZ') END AS "end", CASE WHEN value > 90 THEN true END AS all_day, CAST(user_id AS VARCHAR) AS slug,
coalesce(c_name, CAST(user_id AS VARCHAR)) AS name, CASE WHEN event_id % 2 = 0 THEN event_type END AS venue, CAST(1 + event_id % 2 AS INTEGER) AS sources, CASE WHEN coalesce(c_acctbal > 0, false) THEN NULL ELSE true END AS pending
FROM events LEFT JOIN customer ON c_custkey = user_id""")
def wire_projection(spark, d):
    c = table(spark, d, "customer")
    e = table(spark, d, "events").join(c.select(F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") > 0).alias("verified")), "user_id", "left")
    k, none = F.col("event_id").cast("string"), F.lit(None).cast("string")
    fp = F.concat(F.lit("ics:"), k)
    e = e.select(
        fp.alias("fingerprint"), F.col("event_type").alias("title"), none.alias("excerpt"), F.col("ts").alias("start"), F.when(F.col("value") > 50, F.col("ts") + F.expr("interval 1 hour")).alias("end"), (F.col("value") > 90).alias("all_day"),
        F.col("user_id").cast("string").alias("group_slug"), F.when(F.col("event_id") % 2 == 0, F.struct(F.col("event_type").alias("name"))).alias("venue"), none.alias("room"), none.alias("url"), none.alias("register_url"),
        F.array().cast("array<string>").alias("categories"), F.lit(False).alias("virtual"), F.when(F.col("event_id") % 2 == 0, F.array(fp)).otherwise(F.array(fp, fp)).alias("sources"), store.gate(F.col("verified")).alias("status"),
    )
    w = serve.wire(e, c.select(F.col("c_custkey").cast("string").alias("slug"), F.col("c_name").alias("name"), none.alias("url")))
    return w.select("id", "start", "end", "all_day", "group.slug", "group.name", F.col("venue.name").alias("venue"), "sources", "pending")


def _hidden(spark):
    return spark.createDataFrame([("click",), ("gone",)], "event_type string")


@query("SELECT event_id FROM events WHERE event_type NOT IN ('click', 'gone')")
def group_filter(spark, d):
    return serve.without_groups(table(spark, d, "events"), _hidden(spark), "event_type").select("event_id")


@query("SELECT * FROM (VALUES ('click'), ('gone')) t(event_type) EXCEPT SELECT event_type FROM events")
def stale_groups(spark, d):
    return serve.stale(_hidden(spark), table(spark, d, "events"), "event_type")


@query("SELECT count(*) FILTER (event_type <> 'click') AS shown, count(*) AS total, count(*) FILTER (NOT coalesce(c_acctbal > 0, false)) AS pending FROM events LEFT JOIN customer ON user_id = c_custkey")
def shown_counts(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") > 0).alias("verified"))
    e = table(spark, d, "events").join(c, "user_id", "left").withColumn("status", store.gate(F.col("verified")))
    return serve.shown_counts(e, _hidden(spark), "event_type")


@query("SELECT count(*) FILTER (trim(c_mktsegment) <> '' AND c_acctbal > 0) AS verified FROM customer")
def verified_groups(spark, d):
    return serve.verified_count(table(spark, d, "customer").select(F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("verified_by")))


@query("""WITH e AS (SELECT CAST(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/Chicago' AS DATE) AS day, ts, event_id FROM events)
SELECT day, strftime(day, '%A, %B %-d') AS heading, string_agg(event_id, ',' ORDER BY ts, event_id) AS events FROM e GROUP BY day""")
def day_events(spark, d):
    got = serve.day_events(table(spark, d, "events").select("ts", "event_id", "event_type"), "ts", ("event_id",))
    return got.select("day", "heading", F.array_join(F.transform("events", lambda x: x["event_id"].cast("string")), ",").alias("events"))


@query("""WITH days AS (SELECT DISTINCT CAST(date_trunc('week', ts) AS DATE) AS d FROM events), t AS (SELECT CAST(o_orderdate AS DATE) AS day FROM orders UNION SELECT CAST(ts AS DATE) FROM events)
SELECT day, (SELECT min(d) FROM days WHERE d >= day) AS lands FROM t""")
def first_day_from(spark, d):
    e = table(spark, d, "events")
    days = e.select(F.date_trunc("WEEK", "ts").cast("date").alias("day")).distinct()
    targets = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).union(e.select(F.to_date("ts"))).distinct()
    return serve.first_day_from(days, targets)


@query("""WITH e AS (SELECT CAST(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/Chicago' AS DATE) AS day, ts, event_id FROM events)
SELECT day, ts, event_id, CASE WHEN row_number() OVER (PARTITION BY day ORDER BY ts, event_id) = 1 THEN strftime(day, '%A, %B %-d') END AS heading FROM e""")
def day_rows(spark, d):
    return serve.day_rows(table(spark, d, "events").select("ts", "event_id"), "ts", ("event_id",))


@query("""WITH m AS (SELECT page_id, regexp_extract_all(html, '(?i)<a\\b[^>]*?\\bhref="([^"]*)"', 1) AS m FROM pages)
SELECT page_id, CAST(unnest(range(1, len(m) + 1)) AS INTEGER) AS pos, unnest(m) AS href FROM m""")
def page_links_sql(spark, d):
    """Links of all pages by SQL, through the table function."""
    surface.register_functions(spark)
    table(spark, d, "pages").createOrReplaceTempView("feed_pages")
    return spark.sql("SELECT page_id, pos, href FROM feed_pages, LATERAL page_links(html)")


_OWNED = "s AS (SELECT event_id AS event, ts AS last_seen, unnest([event_id, event_id + 1]) AS s FROM events)"


@query(f"""WITH {_OWNED} SELECT s AS fingerprint, arg_max(event, (last_seen, event)) AS event FROM s GROUP BY s""")
def provenance(spark, d):
    return store.provenance(_listing(spark, d).withColumn("sources", F.expr("array(fingerprint, fingerprint + 1)")))


def _listing(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("fingerprint"), F.col("ts").alias("last_seen"))


@query(f"""WITH {_OWNED}, o AS (SELECT s, arg_max(event, (last_seen, event)) AS event FROM s GROUP BY s), k AS (SELECT event, string_agg(s, ',' ORDER BY s) AS sources FROM o GROUP BY event)
SELECT event_id AS fingerprint, coalesce(sources, '') AS sources FROM events LEFT JOIN k ON event = event_id""")
def moved_provenance(spark, d):
    state = _listing(spark, d).select(F.col("fingerprint").cast("string").alias("fingerprint"), "last_seen", F.expr("array(string(fingerprint), string(fingerprint + 1))").alias("sources"))
    state = state.withColumn("fingerprint", F.lpad("fingerprint", 12, "0")).withColumn("sources", F.transform("sources", lambda x: F.lpad(x, 12, "0")))
    got = store.with_own_sources(state)
    return got.select(F.col("fingerprint").cast("long").alias("fingerprint"), F.array_join(F.transform("sources", lambda x: x.cast("long").cast("string")), ",").alias("sources"))


@query("SELECT event_id AS fingerprint, CAST(p AS INTEGER) AS position, CASE p WHEN 0 THEN event_type ELSE 'more' END AS name FROM events, range(2) t(p) WHERE p = 0 OR event_id % 2 = 0")
def category_rows(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("fingerprint"), F.when(F.col("event_id") % 2 == 0, F.array("event_type", F.lit("more"))).otherwise(F.array("event_type")).alias("categories"))
    return store.category_rows(e)


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN DATE '2024-02-28' + CAST(c_custkey % 9 AS INTEGER) END AS verified_at FROM customer")
def groups_by_slug(spark, d):
    day = F.date_add(F.lit("2024-02-28").cast("date"), (F.col("c_custkey") % 9).cast("int")).cast("string")
    g = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 > 0, day).otherwise("last week").alias("verified_at"))
    return store.groups_by_slug(g)


@query("""SELECT CAST(event_id AS VARCHAR) AS fingerprint, 'no sources' AS message FROM events WHERE event_id % 5 = 0 UNION ALL SELECT CAST(event_id AS VARCHAR), 'no start' FROM events WHERE event_id % 5 > 0 AND event_id % 7 = 0
UNION ALL SELECT CAST(event_id AS VARCHAR), 'unknown source' FROM events WHERE event_id % 5 > 0 AND event_type = 'click'""")
def store_violations(spark, d):
    e, k = table(spark, d, "events"), F.col("event_id")
    fp = F.concat_ws(":", "event_type", k.cast("string"))
    e = e.select(k.cast("string").alias("fingerprint"), F.when(k % 7 > 0, F.col("ts")).alias("start"), F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(fp, fp)).alias("sources"))
    known = table(spark, d, "events").filter("event_type <> 'click'").select(F.col("event_type").alias("kind")).distinct()
    return store.violations(e, known)


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 4 > 0 THEN concat_ws(', ', 'Hall', 'Main St ' || s_suppkey, n_name) END AS map_query, CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 2 = 0 THEN n_name || ' — Lobby' ELSE n_name END AS place,
CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN n_name ELSE (CASE WHEN length(n_name) + 3 + 40 <= 46 THEN n_name || ' / ' || repeat('r', 40) ELSE substr(n_name || ' / ' || repeat('r', 40), 1, 45) || '…' END) END AS label,
CASE WHEN s_suppkey % 5 > 0 THEN TIMESTAMP '2024-03-01 06:00:00' + to_minutes(CAST(s_suppkey % 60 AS INTEGER)) END AS stored
FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def place_labels(spark, d):
    s, k, n = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")), F.col("s_suppkey"), F.col("n_name")
    street = F.when(k % 4 > 0, F.concat(F.lit("Main St "), k.cast("string"))).otherwise("")
    names = F.when(k % 3 == 1, F.array(n)).when(k % 3 == 2, F.array(F.lit("r" * 40), n)).otherwise(F.array().cast("array<string>"))
    told = F.when(k % 5 > 0, F.concat(F.lit("2024-03-01T06:"), F.lpad((k % 60).cast("string"), 2, "0"), F.lit(":00Z"))).otherwise("")
    return s.select(
        "s_suppkey", text.map_query(F.lit("Hall"), street, n, F.lit(""), F.lit(None).cast("string")).alias("map_query"), text.place_label(F.when(k % 3 == 0, "").otherwise(n), F.when(k % 2 == 0, "Lobby")).alias("place"),
        text.venues_label(names).alias("label"), dates.instant(told).cast("timestamp_ntz").alias("stored"),
    )


@query("SELECT CAST(s_suppkey AS VARCHAR) AS source_key, CASE WHEN s_suppkey % 3 > 0 THEN s_name || ', all' END AS name FROM supplier")
def calendar_names(spark, d):
    s = table(spark, d, "supplier")
    line = F.when(F.col("s_suppkey") % 3 > 0, F.concat(F.lit("x-wr-calname;X=\"a:b\":"), F.substring("s_name", 1, 4), F.lit("\r\n "), F.expr("substring(s_name, 5)"), F.lit("\\, all "))).otherwise("SUMMARY:X-WR-CALNAME:no")
    body = F.concat_ws("\r\n", F.lit("BEGIN:VCALENDAR"), line, F.lit("END:VCALENDAR"))
    return ics.calendar_names(s.select(F.col("s_suppkey").cast("string").alias("source_key"), body.alias("body")))


@query("SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 = 0")
def without_place_or_text(spark, d):
    k = F.col("c_custkey")
    return sync.unreviewed(table(spark, d, "customer").select(k, F.when(k % 2 > 0, "v").alias("venue"), F.when(k % 3 > 0, "x").alias("excerpt"))).select("c_custkey")


@query("""WITH u AS (SELECT user_id, count(*) AS n, count(*) FILTER (value > 60) AS skipped, max(ts) AS t FROM events GROUP BY user_id), f AS (SELECT *, n >= 4 AND skipped * 3 > n AS failed FROM u)
SELECT count(*) AS sources, count(*) FILTER (NOT failed) AS ok, CAST(sum(CASE WHEN failed THEN 0 ELSE n - skipped END) AS BIGINT) AS events, CAST(sum(skipped) AS BIGINT) AS skipped, count(*) FILTER (NOT failed) = 0 AS run_failed, max(t) AS window_end FROM f""")
def run_report(spark, d):
    f = skip_breaker(spark, d).join(table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("window_end")), "user_id")
    status = f.select(F.when(F.col("failed"), "too many skips").alias("error"), F.when(F.col("failed"), 0).otherwise(F.col("total") - F.col("skipped")).alias("events"), "skipped", "window_end")
    return sync.report(status)


@query("""SELECT event_id, CASE WHEN value > 90 THEN 'All day' WHEN value > 50 THEN strftime(ts, '%-I:%M %p') || ' – ' || strftime(ts + INTERVAL 90 MINUTE, '%-I:%M %p') ELSE strftime(ts, '%-I:%M %p') END AS label FROM events""")
def time_labels(spark, d):
    end = F.when(F.col("value") > 50, F.col("ts") + F.expr("interval 90 minutes"))
    return table(spark, d, "events").select("event_id", dates.time_label(F.col("ts"), end, F.col("value") > 90).alias("label"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS written, date_trunc('second', ts) - to_hours(CAST(event_id % 3 AS INTEGER)) AS zoned, CAST(NULL AS TIMESTAMP) AS local FROM events""")
def instants(spark, d):
    """Instants are written in UTC and read with any offset; without one they are absent."""
    wall = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    zoned = F.concat(wall, F.lit("+0"), (F.col("event_id") % 3).cast("string"), F.lit(":00"))
    return table(spark, d, "events").select("event_id", dates.to_rfc3339(F.col("ts")).alias("written"), dates.rfc3339(zoned).cast("timestamp_ntz").alias("zoned"), dates.rfc3339(wall).cast("timestamp_ntz").alias("local"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS events FROM events GROUP BY ALL")
def hourly_counts(spark, d):
    return ingest.hourly_counts(table(spark, d, "events")).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("SELECT c_custkey AS slug, CASE WHEN c_acctbal > 0 THEN 'new' ELSE 'old' END AS name FROM customer WHERE c_acctbal > 0 OR c_mktsegment <> 'BUILDING'")
def registry_mirror(spark, d):
    """The registry's rows as they are now, and old ones that it no longer has."""
    c, k = table(spark, d, "customer"), F.col("c_custkey").alias("slug")
    old, new = c.filter("c_mktsegment <> 'BUILDING'").select(k, F.lit("old").alias("name")), c.filter("c_acctbal > 0").select(k, F.lit("new").alias("name"))
    return store.mirror(old, new, "slug")


@query("""SELECT event_id, CASE WHEN ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-23' AND NOT coalesce(value > 50, false) THEN 'cancelled' ELSE 'published' END AS status FROM events""")
def cancel_missing(spark, d):
    """Switched on: what a clean run no longer brings, well inside its window, is cancelled."""
    e = table(spark, d, "events").select(F.col("event_id").alias("fingerprint"), F.col("ts").alias("start"), F.lit("published").alias("status"), "value")
    got = store.cancel_missing(e, e.filter("value > 50"), ntz("2024-01-10"), ntz("2024-01-25"), clean=True, enabled=True)
    return got.select(F.col("fingerprint").alias("event_id"), "status")


@query("""
WITH e AS (SELECT concat_ws(':', user_id, event_type) AS fingerprint, date_trunc('day', ts) AS seen, date_trunc('day', ts) + to_hours(CAST(floor(value) AS INTEGER)) AS start FROM events),
last AS (SELECT fingerprint, max(seen) AS last_at FROM e GROUP BY ALL),
kept AS (SELECT fingerprint, last_at, max(start) AS start FROM e JOIN last USING (fingerprint) WHERE seen = last_at GROUP BY ALL),
run AS (SELECT max(seen) AS now FROM e)
SELECT fingerprint, CASE WHEN last_at < now AND start >= now AND start < now + INTERVAL 18 DAY THEN 'cancelled' ELSE 'published' END AS status FROM kept, run
""")
def absent_timers(spark, d):
    """A stream of all events, each day a run: what the last run has not brought back is cancelled by its own timer."""
    # A pattern, as a stream's path must be a folder or one.
    e = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/event[s].parquet")
    day = F.date_trunc("day", "ts")
    runs = e.select(F.concat_ws(":", "user_id", "event_type").alias("fingerprint"), (day + F.make_dt_interval(hours=F.floor("value").cast("int"))).cast("timestamp_ntz").alias("start"), F.lit("published").alias("status"), day.cast("timestamp_ntz").alias("seen"), F.lit(True).alias("clean"))
    return absence.changes_of(runs, timedelta(days=20)).groupBy("fingerprint").agg(F.min_by("status", F.struct(-F.col("seen_ms"), "status")).alias("status"))
