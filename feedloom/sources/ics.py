"""iCalendar documents decoded with column functions: no Python per line."""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import ZONE

#: The properties that are kept; all others, people's addresses among them, are dropped at once.
KEPT = ("UID", "SUMMARY", "DESCRIPTION", "LOCATION", "URL", "STATUS", "DTSTART", "DTEND", "RRULE", "EXDATE", "CONFERENCE")


def unfold(body: Column) -> Column:
    return F.split(F.regexp_replace(body, r"\r?\n[ \t]", ""), r"\r?\n")


def unescape(c: Column) -> Column:
    """One pass over backslash escapes: a mark stands for a doubled backslash meanwhile."""
    c = F.replace(c, F.lit("\\\\"), F.lit("\u0001"))
    c = F.regexp_replace(F.regexp_replace(c, r"\\[nN]", "\n"), r"\\([;,])", "$1")
    return F.replace(c, F.lit("\u0001"), F.lit("\\"))


def properties(docs: DataFrame) -> DataFrame:
    """(source_key, event, pos, name, tzid, is_date, value) of each event's own properties and its END, nested components left out.

    One row a line; a document's lines are numbered within it, so windows are by document.
    """
    from pyspark.sql import Window

    lines = docs.select("source_key", F.posexplode(unfold(F.col("body"))).alias("pos", "line"))
    head = F.regexp_extract("line", r'^((?:[^":]|"[^"]*")*):(.*)$', 1)
    lines = lines.select("source_key", "pos", F.upper(F.trim(F.regexp_extract(head, "^([^;]*)", 1))).alias("name"), head.alias("head"), F.regexp_extract("line", r'^((?:[^":]|"[^"]*")*):(.*)$', 2).alias("value"))
    up = F.when(F.col("name") == "BEGIN", 1).when(F.col("name") == "END", -1).otherwise(0)
    by = Window.partitionBy("source_key").orderBy("pos")
    lines = lines.withColumn("depth", F.sum(up).over(by))
    opens = (F.col("name") == "BEGIN") & (F.upper(F.trim("value")) == "VEVENT") & (F.col("depth") == 2)
    other = (F.col("name") == "BEGIN") & (F.upper(F.trim("value")) != "VEVENT") & (F.col("depth") == 2)
    lines = lines.withColumn("event", F.sum(opens.cast("int")).over(by))
    inside = F.last(F.when(opens, True).when(other | (F.col("depth") == 1), False), ignorenulls=True).over(by)
    closes = F.col("event").isNotNull() & (F.col("name") == "END") & (F.upper(F.trim("value")) == "VEVENT") & (F.col("depth") == 1)
    lines = lines.withColumn("inside", inside).filter((F.col("inside") & (F.col("depth") == 2) & F.col("name").isin(*KEPT)) | closes)
    quoted = lambda k: F.nullif(F.regexp_extract("head", rf'(?i);{k}="?([^";]*)"?', 1), F.lit(""))
    return lines.select("source_key", "event", "pos", "name", quoted("TZID").alias("tzid"), (F.upper(F.coalesce(quoted("VALUE"), F.lit(""))) == "DATE").alias("is_date"), "value")


def calendar_names(docs: DataFrame) -> DataFrame:
    """(source_key, name): what each document calls itself, for reports only."""
    line = F.get(F.filter(unfold(F.col("body")), lambda x: x.rlike(r"(?i)^X-WR-CALNAME[;:]")), F.lit(0))
    return docs.select("source_key", F.nullif(F.btrim(unescape(F.regexp_extract(line, r'^(?:[^":]|"[^"]*")*:(.*)$', 1))), F.lit("")).alias("name"))


def instants(value: Column, tzid: Column, is_date: Column, known: Column) -> Column:
    """A property's instant in UTC, null if malformed or in an unknown zone; a date is local midnight."""
    day = F.try_to_timestamp(F.when(is_date | F.length(value).eqNullSafe(8), value), F.lit("yyyyMMdd")).cast("timestamp_ntz")
    zulu = F.try_to_timestamp(F.when(value.endswith("Z"), value), F.lit("yyyyMMdd'T'HHmmss'Z'")).cast("timestamp_ntz")
    wall = F.try_to_timestamp(F.when(~value.endswith("Z"), value), F.lit("yyyyMMdd'T'HHmmss")).cast("timestamp_ntz")
    home = F.convert_timezone(F.lit(ZONE), F.lit("UTC"), F.coalesce(day, wall))
    there = F.convert_timezone(F.coalesce(known, F.lit("UTC")), F.lit("UTC"), wall)
    return F.when(day.isNotNull(), home).when(value.endswith("Z"), zulu).when(tzid.isNull(), home).when(known.isNotNull(), there)


def decode(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, skips) of documents with source_key and body.  Cancelled events are dropped before their dates are read; a document that is no calendar is a skip."""
    spark = docs.sparkSession
    p = properties(docs)
    zones = F.broadcast(spark.createDataFrame([(z,) for z in sorted(available_timezones())], "zone string"))  # a fixed list
    p = p.join(zones, F.col("tzid") == F.col("zone"), "left").withColumn("value", F.trim("value"))
    p = p.withColumn("at", instants(F.col("value"), F.col("tzid"), F.col("is_date"), F.col("zone")))
    wall = F.col("tzid").isNull() | F.col("is_date") | F.length("value").eqNullSafe(8)
    p = p.withColumn("written_in", F.when(F.col("value").endswith("Z"), "UTC").when(wall, ZONE).otherwise(F.col("zone")))
    p = p.withColumn("ats", F.when(F.col("name") == "EXDATE", F.transform(F.filter(F.split("value", ","), lambda v: F.trim(v) != ""), lambda v: instants(F.trim(v), F.col("tzid"), F.col("is_date"), F.col("zone")))))
    last = lambda name, what="value": F.max_by(what, F.when(F.col("name") == name, F.col("pos")))
    e = p.groupBy("source_key", "event").agg(
        last("UID").alias("upstream_id"), unescape(last("SUMMARY")).alias("title"), unescape(last("DESCRIPTION")).alias("description"), unescape(last("LOCATION")).alias("location"),
        last("URL").alias("url"), last("STATUS").alias("status"), last("RRULE").alias("rrule"), last("DTSTART").alias("raw_start"), last("DTSTART", "at").alias("start"), last("DTSTART", "is_date").alias("all_day"),
        last("DTEND").alias("raw_end"), last("DTEND", "at").alias("end"), (last("CONFERENCE").isNotNull()).alias("virtual"), F.flatten(F.collect_list("ats")).alias("exdates"), last("DTSTART", "written_in").alias("zone"), F.bool_or(F.col("name") == "END").alias("closed"),
    )
    reason = (
        F.when(~F.col("closed"), "no END:VEVENT").when(F.coalesce(F.col("upstream_id"), F.lit("")) == "", "no UID").when(F.col("raw_start").isNull(), "no DTSTART")
        .when(F.upper(F.coalesce("status", F.lit(""))) == "CANCELLED", "").when(F.col("start").isNull(), "bad DTSTART").when(F.col("raw_end").isNotNull() & F.col("end").isNull(), "bad DTEND")
    )
    e = e.withColumn("reason", reason)
    skips = e.filter("reason <> ''").select("source_key", F.coalesce("upstream_id", F.concat(F.lit("event "), F.col("event").cast("string"))).alias("ref"), "reason")
    none = docs.filter(~F.coalesce(F.col("body").rlike(r"(?im)^[ \t]*BEGIN[ \t]*:[ \t]*VCALENDAR[ \t]*\r?$"), F.lit(False))).select("source_key", F.lit("document").alias("ref"), F.lit("no VCALENDAR").alias("reason"))
    return e.filter("reason is null").drop("reason", "raw_start", "raw_end", "closed"), skips.unionByName(none)
