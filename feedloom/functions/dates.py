"""Instants, local days and labels.  Times without a zone are wall clock; the feed's own zone is one place's."""

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "America/Chicago"


def rfc3339(c: Column) -> Column:
    """An instant with an explicit offset, else null."""
    return F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))


def to_rfc3339(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def instant(c: Column) -> Column:
    """A stored instant; an empty one is absent."""
    return F.try_to_timestamp(F.nullif(c, F.lit("")), F.lit("yyyy-MM-dd'T'HH:mm:ssX"))


def local(c: Column, zone: str = ZONE) -> Column:
    """UTC to the zone's wall clock."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), c.cast("timestamp_ntz"))


def utc(c: Column, zone: str = ZONE) -> Column:
    """The zone's wall clock to UTC; an hour that occurs twice is the first, one that does not is moved on."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), c.cast("timestamp_ntz"))


def day_label(day: Column) -> Column:
    return F.date_format(day, "EEEE, MMMM d")


def week_start(day: Column) -> Column:
    return F.date_trunc("WEEK", day).cast("date")


def time_label(start: Column, end: Column, all_day: Column) -> Column:
    clock = lambda c: F.date_format(c, "h:mm a")
    return F.when(all_day, F.lit("All day")).when(end.isNotNull(), F.concat_ws(" \u2013 ", clock(start), clock(end))).otherwise(clock(start))
