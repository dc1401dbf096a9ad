"""JSON calendar pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import html_unescape, unescape_all
from ..functions.urls import clean_url

VENUE = "global_id string, venue string, address string, city string, state string, stateprovince string, zip string, url string"
EVENT = "global_id string, title string, description string, url string, website string, utc_start_date string, utc_end_date string, all_day boolean, is_virtual boolean, virtual_url string, organizer array<struct<organizer: string, website: string>>, venue string, categories array<struct<name: string>>"


def one_or_many(raw: Column, fields: str) -> Column:
    """An object or an array of objects as an array; null is empty."""
    whole = F.when(F.ltrim(raw).startswith("["), raw).otherwise(F.concat(F.lit("["), raw, F.lit("]")))
    parsed = F.from_json(whole, F.lit(f"array<struct<{', '.join(f.strip().replace(' ', ': ', 1) for f in fields.split(','))}>>"))
    return F.coalesce(F.when(raw.isNull() | (F.trim(raw) == "null"), None).otherwise(parsed), F.from_json(F.lit("[]"), F.lit(f"array<struct<{', '.join(f.strip().replace(' ', ': ', 1) for f in fields.split(','))}>>")))


def decode(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, skips) of pages with source_key and body.

    Titles and names are unescaped, descriptions stay as they are, links are
    repaired, times are UTC already.  A page that is no object with a list of
    events is a skip of the document.
    """
    whole = F.schema_of_variant(F.try_parse_json("body"))
    listed = F.coalesce(F.schema_of_variant(F.try_variant_get(F.try_parse_json("body"), "$.events", "variant")), F.lit("VOID"))
    ok = F.coalesce(whole.startswith("OBJECT") & (listed.startswith("ARRAY") | (listed == "VOID")), F.lit(False))
    broken = pages.filter(~ok).select("source_key", F.lit("document").alias("ref"), F.lit("no list of events").alias("reason"))
    events = F.from_json("body", F.lit("struct<total: int, next_rest_url: string, events: array<string>>"))["events"]
    e = pages.select("source_key", F.posexplode_outer(events).alias("pos", "raw")).filter("raw is not null")
    e = e.withColumn("e", F.from_json("raw", F.lit(EVENT))).select("source_key", "pos", "e.*")
    stamp = lambda c: F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    e = e.withColumns({"start": stamp("utc_start_date"), "end": stamp("utc_end_date"), "places": one_or_many(F.col("venue"), VENUE)})
    bad_end = (F.coalesce("utc_end_date", F.lit("")) != "") & F.col("end").isNull()
    e = e.withColumn("reason", F.when(F.coalesce("global_id", F.lit("")) == "", "no id").when(F.col("start").isNull(), "bad start").when(bad_end, "bad end"))
    venue = lambda v: F.struct(v["venue"].alias("name"), v["address"].alias("address"), v["city"].alias("city"), F.coalesce(v["state"], v["stateprovince"]).alias("state"), v["zip"].alias("zip"), clean_url(v["url"]).alias("url"))
    good = e.filter("reason is null").select(
        "source_key", F.col("global_id").alias("upstream_id"), html_unescape(F.col("title")).alias("title"), "description", "start", "end", "all_day",
        clean_url(F.col("url")).alias("url"), clean_url(F.col("website")).alias("register_url"), clean_url(F.col("virtual_url")).alias("virtual_url"), F.col("is_virtual").alias("virtual"),
        unescape_all(F.transform("organizer", lambda o: o["organizer"])).alias("organizers"), F.transform("places", venue).alias("venues"), unescape_all(F.transform("categories", lambda c: c["name"])).alias("categories"),
    )
    names = unescape_all(F.transform("venues", lambda v: v["name"]))
    good = good.withColumn("_names", names).withColumn("venues", F.zip_with("venues", "_names", lambda v, n: v.withField("name", n))).drop("_names")
    return good, broken.unionByName(e.filter("reason is not null").select("source_key", F.coalesce(F.nullif("global_id", F.lit("")), F.col("pos").cast("string")).alias("ref"), "reason"))
