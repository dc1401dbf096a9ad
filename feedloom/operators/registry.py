"""Constraints of the curated registry: every problem at once, as rows (scope, slug, message)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import fold_name

#: The pattern of slugs, and the kinds of sources.
SLUG = "^[a-z0-9]+(-[a-z0-9]+)*$"
KINDS = ("tribe", "ics", "html", "bevy")


def claimed_twice(df: DataFrame, scope: str, names: Column, slug: str = "slug") -> DataFrame:
    """Folded names that more than one entity claims."""
    rows = df.select(F.col(slug).cast("string").alias("slug"), F.explode(names).alias("n")).withColumn("key", fold_name(F.col("n"))).filter("key <> ''")
    twice = rows.groupBy("key").agg(F.countDistinct("slug").alias("c"), F.min("slug").alias("slug")).filter("c > 1")
    return twice.select(F.lit(scope).alias("scope"), "slug", F.concat(F.lit("name claimed twice: "), F.col("key")).alias("message"))


def _rules(df: DataFrame, scope: str, rules: list[tuple[Column, str]], slug: str = "slug") -> DataFrame:
    """The messages of all rules that a row breaks, in one pass."""
    broken = F.array_compact(F.array(*(F.when(bad, F.lit(message)) for bad, message in rules)))
    return df.select(F.lit(scope).alias("scope"), F.col(slug).cast("string").alias("slug"), F.explode(broken).alias("message"))


def problems(groups: DataFrame, venues: DataFrame, sources: DataFrame, rejects: DataFrame | None = None) -> DataFrame:
    """All at once: names, slugs, dates, references, kinds and links; a registry needs a group at least."""
    blank = lambda c: F.coalesce(F.btrim(F.col(c).cast("string")), F.lit("")) == ""
    bad_date = lambda c: ~blank(c) & F.try_to_date(F.col(c).cast("string"), "yyyy-MM-dd").isNull()
    names = F.concat(F.array("slug", "name"), F.coalesce("aliases", F.array().cast("array<string>")))
    named = [(blank("name"), "name is required"), (~F.col("slug").rlike(SLUG), "file name is no slug")]
    dated = [(~blank("verified_by") & blank("verified_at"), "verified_by needs verified_at"), (bad_date("verified_at"), "verified_at is no date")]
    out = [_rules(groups, "group", named + dated), _rules(venues, "venue", named), claimed_twice(groups, "group", names), claimed_twice(venues, "venue", names)]
    lost = groups.filter(~blank("venue_slug")).join(venues.select(F.col("slug").alias("venue_slug")), "venue_slug", "left_anti")
    out.append(_rules(lost, "group", [(F.lit(True), "venue does not exist")]))
    out.append(_rules(sources, "source", [(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "unknown kind"), (~F.coalesce(F.col("url").rlike(r"^https://[^/\s]+"), F.lit(False)), "url must be absolute https")], "group_slug"))
    twice = sources.groupBy("url").agg(F.count("*").alias("c"), F.min("group_slug").alias("slug")).filter("c > 1")
    out.append(_rules(twice, "source", [(F.lit(True), "url listed twice")]))
    none = groups.agg(F.count("*").alias("n")).filter("n = 0").withColumn("slug", F.lit(None).cast("string"))
    out.append(_rules(none, "registry", [(F.lit(True), "no group")]))
    if rejects is not None:
        dates = [(bad_date("rejected_at"), "rejected_at is no date")] if "rejected_at" in rejects.columns else []
        out.append(_rules(rejects, "reject", [(blank("fingerprint"), "fingerprint is required"), (blank("reason"), "reason is required"), *dates], "fingerprint"))
        twice = rejects.groupBy("fingerprint").count().filter("count > 1")
        out.append(_rules(twice, "reject", [(F.lit(True), "fingerprint listed twice")], "fingerprint"))
    return reduce(DataFrame.unionByName, out)
