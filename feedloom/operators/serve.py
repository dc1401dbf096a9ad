"""The read path: upcoming events, counts, feeds and their presentation."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates

FEED = """generated_at string, preview boolean, events array<struct<id: string, title: string, excerpt: string, start: string, end: string, all_day: boolean, group: struct<slug: string, name: string, url: string>,
venue: struct<name: string, address: string, city: string, state: string, zip: string, url: string>, room: string, url: string, register_url: string, categories: array<string>, virtual: boolean, sources: int, pending: boolean>>"""


def upcoming(events: DataFrame, since: Column, statuses: tuple[str, ...] = ("published",), start: str = "start", status: str = "status") -> DataFrame:
    """Events of the statuses from an instant on, to the second."""
    return events.filter(F.col(status).isin(*statuses) & (F.col(start) >= F.date_trunc("SECOND", since).cast("timestamp_ntz")))


def feed_json(events: DataFrame, generated_at: Column, preview: bool = False) -> DataFrame:
    """One row: the feed as JSON, absent values left out.  The feed is what one page shows, so it fits a row."""
    ordered = F.array_sort(F.collect_list(F.struct("start", "id", F.struct(*events.columns).alias("e"))), lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0))
    at = dates.to_rfc3339(generated_at.cast("timestamp_ntz"))
    body = F.to_json(F.struct(at.alias("generated_at"), F.when(F.lit(preview), F.lit(True)).alias("preview"), F.transform("e", lambda x: x["e"]).alias("events")))
    return events.agg(ordered.alias("e")).select(body.alias("body"))


def wire(events: DataFrame, groups: DataFrame) -> DataFrame:
    """What goes out of an event, named one by one: nothing that is added elsewhere becomes public by itself.

    Absent values are null, as are false flags and empty lists; a group that the
    registry no longer has goes by its slug.
    """
    names = groups.select(F.col("slug").alias("group_slug"), F.col("name").alias("_name"), F.col("url").alias("_url"))
    true = lambda c: F.when(c, F.lit(True))
    group = F.struct(F.col("group_slug").alias("slug"), F.coalesce(F.nullif("_name", F.lit("")), "group_slug").alias("name"), F.col("_url").alias("url"))
    return events.join(names, "group_slug", "left").select(
        F.col("fingerprint").alias("id"), "title", "excerpt", dates.to_rfc3339(F.col("start")).alias("start"), dates.to_rfc3339(F.col("end")).alias("end"), true(F.col("all_day")).alias("all_day"),
        group.alias("group"), F.when(F.col("venue.name").isNotNull(), F.col("venue")).alias("venue"), "room", "url", "register_url", F.when(F.size("categories") > 0, F.col("categories")).alias("categories"),
        true(F.col("virtual")).alias("virtual"), F.nullif(F.size("sources"), F.lit(0)).alias("sources"), true(F.col("status") == "pending").alias("pending"),
    )


def indented(body: str) -> str:
    """A feed as a file has it: indented, with a line's end."""
    return json.dumps(json.loads(body), indent=2, ensure_ascii=False) + "\n"


def feed_lines(wire: DataFrame) -> DataFrame:
    """``line``: each event of the feed as JSON, absent values left out, in the order of start and id."""
    return wire.orderBy("start", "id").select(F.to_json(F.struct(*wire.columns)).alias("line"))


def feed_text(lines: Iterable[str], generated_at: str, preview: bool = False) -> Iterator[str]:
    """The feed file in pieces: its head, an event at a time, its foot; the same text as :func:`indented` gives of :func:`feed_json`."""
    yield indented(json.dumps({"generated_at": generated_at} | ({"preview": True} if preview else {}))).removesuffix("\n}\n") + ',\n  "events": ['
    some = False
    for line in lines:
        yield ("," if some else "") + "\n    " + json.dumps(json.loads(line), indent=2, ensure_ascii=False).replace("\n", "\n    ")
        some = True
    yield ("\n  " if some else "") + "]\n}\n"


def read_feed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The first of some feed files that is there, as one row; a file that is no feed is an error."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            return spark.read.schema(FEED).option("mode", "FAILFAST").json(path, multiLine=True)
    raise FileNotFoundError(", ".join(paths))


def with_venues(events: DataFrame, venues: DataFrame, key: str = "venue_id") -> DataFrame:
    """Events and their venues' columns, empty texts where there is none."""
    cols = [c for c in venues.columns if c != key]
    out = events.join(venues, key, "left")
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in cols})


def with_provenance(events: DataFrame, fingerprints: DataFrame, sources: DataFrame, key: str = "event_id") -> DataFrame:
    """Events with ``sources``: their feeds' records, by priority and fingerprint."""
    rows = fingerprints.join(sources.select("source_id", "url", "priority"), "source_id")
    item = F.struct("priority", "fingerprint", F.col("url").alias("source_key"))
    return events.join(rows.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("sources")), key, "left")


def with_categories(events: DataFrame, categories: DataFrame, key: str = "event_id") -> DataFrame:
    """Events with ``categories``: names in order."""
    named = F.transform(F.array_sort(F.collect_list(F.struct("position", "name"))), lambda x: x["name"])
    return events.join(categories.groupBy(key).agg(named.alias("categories")), key, "left")


def without_groups(events: DataFrame, hidden: DataFrame, group: str = "group_slug") -> DataFrame:
    """Events of groups that nobody hides."""
    return events.join(hidden.select(group).distinct(), group, "left_anti")


def stale(hidden: DataFrame, events: DataFrame, group: str = "group_slug") -> DataFrame:
    """Hidden groups that have no events any more: a set difference."""
    return hidden.select(group).subtract(events.select(group))


def day_events(events: DataFrame, start: str = "start", order: tuple[str, ...] = ("fingerprint",)) -> DataFrame:
    """A row for each local day with its heading and its events, in order of start."""
    day = dates.local(F.col(start)).cast("date")
    item = F.struct(F.col(start), *order, *(c for c in events.columns if c != start and c not in order))
    out = events.groupBy(day.alias("day")).agg(F.array_sort(F.collect_list(item)).alias("events"))
    return out.withColumn("heading", dates.day_label(F.col("day")))


def day_rows(events: DataFrame, start: str = "start", order: tuple[str, ...] = ("fingerprint",)) -> DataFrame:
    """Events in order of start, by ranges, with their local day; ``heading`` begins a day's section and is null on its other events.

    A day's first event is a minimum, so no day is gathered, however many events it has.
    """
    rows = events.withColumn("day", dates.local(F.col(start)).cast("date"))
    first = rows.groupBy("day").agg(F.min(F.struct(start, *order)).alias("_first"))
    heading = F.when(F.struct(start, *order) == F.col("_first"), dates.day_label(F.col("day")))
    return rows.join(first, "day").withColumn("heading", heading).drop("_first").orderBy("day", start, *order)


def first_day_from(days: DataFrame, targets: DataFrame, key: str = "day") -> DataFrame:
    """Of each target the first day on it or after; null if none is left.

    A month has its days as a sorted array, and the first day after it: targets
    meet their month by equality and search there.
    """
    month = lambda c: F.trunc(c, "MM")
    span = days.select(month(F.col("day")).alias("m")).unionByName(targets.select(month(F.col(key)).alias("m"))).agg(F.min("m").alias("a"), F.max("m").alias("b")).filter("a is not null")
    months = span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("m"))
    held = days.filter("day is not null").groupBy(month(F.col("day")).alias("m")).agg(F.array_sort(F.collect_set("day")).alias("_days"))
    # A calendar's months: some hundreds, whatever the events.
    after = F.min(F.get("_days", F.lit(0))).over(Window.orderBy("m").rowsBetween(1, Window.unboundedFollowing))
    index = months.join(held, "m", "left").withColumn("_after", after).withColumnRenamed("m", "_m")
    met = targets.join(index, month(F.col(key)) == F.col("_m"), "left")
    here = F.get(F.filter("_days", lambda d: d >= F.col(key)), F.lit(0))
    return met.withColumn("lands", F.coalesce(here, F.col("_after"))).select(*targets.columns, "lands")


def shown_counts(events: DataFrame, hidden: DataFrame, group: str = "group_slug") -> DataFrame:
    """A row: events shown, all of them, and those that are pending."""
    mark = hidden.select(group).distinct().withColumn("_off", F.lit(True))
    return events.join(mark, group, "left").agg(F.count_if(F.col("_off").isNull()).alias("shown"), F.count("*").alias("total"), F.count_if(F.col("status") == "pending").alias("pending"))


def verified_count(groups: DataFrame) -> DataFrame:
    return groups.agg(F.count_if(F.coalesce(F.btrim("verified_by"), F.lit("")) != "").alias("verified"))


def day_sections(events: DataFrame, start: str = "start") -> DataFrame:
    """Local day, its heading, and how many events it has."""
    day = dates.local(F.col(start)).cast("date")
    return events.groupBy(day.alias("day")).agg(F.count("*").alias("events")).withColumn("heading", dates.day_label(F.col("day")))


def jump_targets(days: DataFrame, today: Column) -> DataFrame:
    """(label, day): the first day with events this week, next week and of each month, unless a week's is the same."""
    d = days.filter(F.col("day") >= today)
    week = dates.week_start(today)
    this = d.filter(dates.week_start(F.col("day")) == week).agg(F.min("day").alias("day")).select(F.lit("this week").alias("label"), "day")
    following = d.filter(dates.week_start(F.col("day")) == F.date_add(week, 7)).agg(F.min("day").alias("day")).select(F.lit("next week").alias("label"), "day")
    weeks = this.unionByName(following).filter("day is not null")
    months = d.groupBy(F.trunc("day", "MM").alias("m")).agg(F.min("day").alias("day")).select(F.date_format("m", "MMMM").alias("label"), "day")
    return weeks.unionByName(months.join(weeks.select("day"), "day", "left_anti").select("label", "day"))


def status_counts(events: DataFrame, status: str = "status") -> DataFrame:
    return events.groupBy(status).agg(F.count("*").alias("events"))
