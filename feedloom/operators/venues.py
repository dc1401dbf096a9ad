"""Where an event is: from what a feed says to a curated or discovered venue, and a room.

Feeds say it as one name, as room and building in an array, or as one flat line
with an address.  Every key that a record may be looked up by is a column, so the
curated venues are joined once, by equality, on exploded keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.addresses import room_segment, split_flat_address, split_on_dash, strip_venue_prefix
from ..functions.names import fold_name, venue_slug
from .normalize import claimed_names

FIELDS = ("address", "city", "state", "zip", "url")
#: A venue as events carry it.
VENUE = "struct<name: string, address: string, city: string, state: string, zip: string, url: string>"


def text(c: Column) -> Column:
    return F.nullif(F.btrim(c), F.lit(""))


def curated_keys(venues: DataFrame) -> DataFrame:
    """(key, venue): each folded slug, name and alias with the first venue that claims it."""
    names = F.filter(F.concat(F.array("slug", "name"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda n: n.isNotNull())
    own = venues.select("slug", F.struct("name", *FIELDS).cast(VENUE).alias("venue"))
    return claimed_names(venues, "slug", names, "pos").join(own, "slug").select("key", "venue")


def discovered(name: Column, raw: Column) -> Column:
    """A venue that nobody has curated, with what the feed says about it."""
    return F.when(text(name).isNotNull(), F.struct(F.btrim(name).alias("name"), *(text(raw[f]).alias(f) for f in FIELDS)).cast(VENUE))


def resolve_venues(records: DataFrame, curated: DataFrame, keys: list[str]) -> DataFrame:
    """``records`` with ``place``, a struct of venue, room and curated, null where the feed names none.

    ``keys`` tell records apart; ``venues`` is their array of structs, room first
    and building last; ``curated`` has the columns of :func:`curated_keys`.
    """
    # Everything that is made of texts is a column before the join, so that what follows it is short.
    n, first, last = F.size("venues"), F.get("venues", F.lit(0)), F.try_element_at("venues", F.lit(-1))
    names = {"_in": F.btrim(F.coalesce(first["name"], F.lit(""))), "_out": F.btrim(F.coalesce(last["name"], F.lit(""))), "_many": F.coalesce(n > 1, F.lit(False))}
    rows = records.withColumns(names)
    inner, outer, many = F.col("_in"), F.col("_out"), F.col("_many")
    before, after = split_on_dash(inner)
    comma = F.instr(inner, ",")
    rows = rows.withColumns({
        "_before": F.when(~many, before), "_after": F.when(~many, after), "_comma": ~many & (comma > 0), "_headed": F.btrim(F.substring(inner, F.lit(1), comma - 1)),
        "_tail": F.substring(inner, comma + 1, F.length(inner)), "_room": F.when(many & (fold_name(outer) != ""), strip_venue_prefix(inner, outer)),
    })
    rows = rows.withColumns({
        "_whole": fold_name(inner), "_outer": F.when(F.col("_room").isNotNull(), fold_name(outer)), "_dash": fold_name(F.col("_before")), "_head": F.when(F.col("_comma"), fold_name(F.col("_headed"))),
        "_segment": room_segment(F.col("_tail")), "_flat": split_flat_address(F.col("_tail")), "_found_in": discovered(inner, first), "_found_out": discovered(outer, last), "_found_dash": discovered(F.col("_before"), first),
    })
    asked = ["_whole", "_outer", "_dash", "_head"]
    found = rows.select(*keys, F.explode(F.array(*(F.struct(F.lit(k).alias("as"), F.col(k).alias("key")) for k in asked))).alias("_k")).select(*keys, "_k.*").filter("key <> ''")
    found = found.join(curated, "key").groupBy(*keys).agg(*(F.any_value(F.when(F.col("as") == k, F.col("venue")), True).alias(f"_v{k}") for k in asked))
    rows = rows.join(found, keys, "left")
    is_ = lambda v, room, known: F.struct(F.col(v).alias("venue"), text(room).alias("room"), F.lit(known).alias("curated"))
    none, room, dashed, has = F.lit(None).cast("string"), F.col("_room"), F.col("_before").isNotNull(), lambda k: F.col(f"_v{k}").isNotNull()
    addressed = F.struct(F.col("_headed").alias("name"), *(F.col(f"_flat.{f}").alias(f) for f in FIELDS[:4]), text(first["url"]).alias("url")).cast(VENUE)
    rows = rows.withColumn("_addressed", F.when(F.col("_headed") != "", addressed))
    place = (
        F.when(room.isNotNull() & has("_outer"), is_("_v_outer", room, True)).when(room.isNotNull(), is_("_found_out", room, False))
        .when(has("_whole"), is_("_v_whole", none, True)).when(many, is_("_found_in", none, False))
        .when(dashed & has("_dash"), is_("_v_dash", F.col("_after"), True)).when(dashed, is_("_found_dash", F.col("_after"), False))
        .when(F.col("_comma") & has("_head"), is_("_v_head", F.col("_segment"), True)).when(F.col("_comma"), is_("_addressed", none, False))
        .otherwise(is_("_found_in", none, False))
    )
    nowhere = F.when(room.isNotNull(), ~has("_outer") & F.col("_found_out").isNull()).when(has("_whole"), False).when(many, F.col("_found_in").isNull()).when(dashed, ~has("_dash") & F.col("_found_dash").isNull())
    nowhere = nowhere.when(F.col("_comma"), ~has("_head") & F.col("_addressed").isNull()).otherwise(F.col("_found_in").isNull())
    return rows.withColumn("place", F.when((n > 0) & ~nowhere, place)).select(*records.columns, "place")


def default_venues(events: DataFrame, groups: DataFrame, curated: DataFrame) -> DataFrame:
    """Events without a place get where their group usually meets, if the registry says so."""
    usual = groups.filter("venue_slug is not null").select(F.col("slug").alias("group_slug"), fold_name(F.col("venue_slug")).alias("key"))
    usual = usual.join(curated, "key").select("group_slug", F.struct(F.col("venue"), F.lit(None).cast("string").alias("room"), F.lit(True).alias("curated")).alias("_usual"))
    return events.join(usual, "group_slug", "left").withColumn("place", F.coalesce("place", "_usual")).drop("_usual")


def venue_rows(old: DataFrame, seen: DataFrame) -> DataFrame:
    """The venue table after a run: known names keep what they have and take what they lack, new names come with a slug.

    ``old`` has slug, name and the fields, ``seen`` name and the fields.  A new
    name whose slug is taken renames that row, as the same place spelled anew.
    """
    of = F.struct(*(F.col(f).isNull() for f in FIELDS), *FIELDS)
    seen = seen.filter(text(F.col("name")).isNotNull()).groupBy("name").agg(*(F.min_by(f, of).alias(f) for f in FIELDS))
    both = old.alias("o").join(seen.alias("n"), "name", "full_outer")
    fill = [F.coalesce(text(F.col(f"o.{f}")), text(F.col(f"n.{f}"))).alias(f) for f in FIELDS]
    rows = both.select("name", F.coalesce("o.slug", venue_slug(F.col("name"))).alias("slug"), F.col("o.slug").isNull().alias("new"), *fill)
    last = F.struct("new", "name")
    return rows.groupBy("slug").agg(F.max_by("name", last).alias("name"), *(F.coalesce(F.max_by(f, F.when(~F.col("new"), F.struct("name"))), F.max_by(f, last)).alias(f) for f in FIELDS))
