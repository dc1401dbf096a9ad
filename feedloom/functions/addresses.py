"""Venues and rooms in one text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import fold_name

#: Words that begin a room.
ROOMS = ("room", "rooms", "conference room", "suite", "floor", "studio", "hall", "lobby", "auditorium")
#: Dashes between a venue and a room, in the order in which they are tried.
DASHES = ("\u2013", "\u2014", " - ")


def split_on_dash(c: Column) -> tuple[Column, Column]:
    """Before and after the first en dash, else em dash, else spaced hyphen; (null, null) without one."""
    before = after = F.lit(None).cast("string")
    for d in reversed(DASHES):
        at, has = F.instr(c, d), F.instr(c, d) > 0
        before = F.when(has, F.trim(F.substring(c, F.lit(1), at - 1))).otherwise(before)
        after = F.when(has, F.trim(F.substring(c, at + len(d), F.length(c)))).otherwise(after)
    return before, after


def room_segment(c: Column) -> Column:
    """The first part before a comma if it names a room, else null."""
    first = F.trim(F.element_at(F.split(c, ","), 1))
    return F.when(fold_name(first).rlike(f"^({'|'.join(ROOMS)})( |$)"), first)


def split_flat_address(c: Column) -> Column:
    """struct(address, city, state, zip) of a tail such as ``1 Main St, Town, TX 77001, USA``."""
    parts = F.filter(F.transform(F.split(c, ","), lambda s: F.trim(s)), lambda s: (s != "") & ~F.upper(s).isin("USA", "US"))
    tokens = F.split(F.coalesce(F.get(parts, 2), F.lit("")), " +")
    state = F.get(F.filter(tokens, lambda t: t.rlike("^[A-Z]{2}$")), 0)
    zips = F.filter(tokens, lambda t: t.rlike("^[0-9].{4}$"))
    return F.struct(F.get(parts, 0).alias("address"), F.get(parts, 1).alias("city"), state.alias("state"), F.try_element_at(zips, F.lit(-1)).alias("zip"))


def strip_venue_prefix(inner: Column, outer: Column) -> Column:
    """What follows the venue's name in a room's, in its own case; null if it does not begin with it."""
    rest = F.ltrim(F.substring(fold_name(inner), F.length(fold_name(outer)) + 1, F.length(inner)), F.lit(" -"))
    return F.when(F.startswith(fold_name(inner), fold_name(outer)), F.right(F.trim(inner), F.length(rest)))
