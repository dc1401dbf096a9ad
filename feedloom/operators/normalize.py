"""From raw records to events: resolve, cluster, merge, reject.

Records: source_key, upstream_id, organizers (array of names), title, start,
end, all_day, url, register_url, excerpt, virtual, venue (see ``EVENT``).
Absent values are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import fingerprint, fold_name


def claimed_names(entities: DataFrame, slug: str, names: Column, position: str) -> DataFrame:
    """(key, slug): every folded name with the first entity that claims it, in registry order and then in the order of its names."""
    rows = entities.select(F.col(slug).alias("slug"), F.col(position).alias("_at"), F.posexplode(names).alias("_nth", "_name"))
    rows = rows.withColumn("key", fold_name(F.col("_name"))).filter("key <> ''")
    return rows.groupBy("key").agg(F.min_by("slug", F.struct("_at", "_nth")).alias("slug"))


def enabled(sources: DataFrame) -> DataFrame:
    """Sources that a run asks."""
    return sources.filter("enabled")


def of_successful(records: DataFrame, status: DataFrame) -> DataFrame:
    """Records of sources without an error: a failed source brings nothing, which is not the same as an empty list."""
    return records.join(status.filter("error is null").select("source_key"), "source_key", "left_semi")


def merged_away(records: int, events: int, rejected: int) -> int:
    """Records that merges have taken up."""
    return records - events - rejected


def with_sources(raw: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records joined with their source (kind, priority, owner), and the records of none as problems."""
    joined = raw.join(sources.select(F.col("url").alias("source_key"), "kind", "priority", F.col("group_slug").alias("owner")), "source_key", "left")
    problems = joined.filter("kind is null").select("source_key", "upstream_id", F.lit("unregistered source").alias("message"))
    return joined.filter("kind is not null"), problems


def resolve_groups(records: DataFrame, claimed: DataFrame, keys: list[str]) -> DataFrame:
    """group_slug: that of the first organizer whose folded name is claimed, else the source's owner."""
    named = records.select(*keys, F.posexplode("organizers").alias("_at", "_name")).withColumn("key", fold_name(F.col("_name")))
    found = named.join(claimed, "key").groupBy(*keys).agg(F.min_by("slug", "_at").alias("_slug"))
    return records.join(found, keys, "left").withColumn("group_slug", F.coalesce("_slug", "owner")).drop("_slug")


def with_entities(records: DataFrame, cluster: list[str], source: str, row: list[str]) -> DataFrame:
    """``entity``: null where the cluster's records merge, which they do if no source gives two of them; else the record's own key.

    Sources are counted with partial aggregates; no cluster is gathered.
    """
    most = records.groupBy(*cluster, source).count().groupBy(*cluster).agg((F.max("count") == 1).alias("mergeable"))
    return records.join(most, cluster).withColumn("entity", F.when(~F.col("mergeable"), F.struct(*row)))


def merge_records(records: DataFrame, cluster: list[str], order: list[str], winner: list[str], filled: list[str], any_of: list[str] = (), source: str = "fingerprint", best: dict[str, list[str]] | None = None) -> DataFrame:
    """One row for each cluster and entity, by priority.

    ``winner`` columns come from the first record in ``order``; ``filled`` ones
    from the first that has them, ``best`` ones from the first by orders of their
    own; ``any_of`` are true if one is.  ``sources`` lists the fingerprints in
    order: one for each source, so a short list.
    """
    by = F.struct(*order)
    aggs = [F.min_by(c, by).alias(c) for c in winner]
    aggs += [F.min_by(c, F.when(F.col(c).isNotNull(), by)).alias(c) for c in filled]
    aggs += [F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*own))).alias(c) for c, own in (best or {}).items()]
    aggs += [F.bool_or(c).alias(c) for c in any_of]
    sources = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(source).alias("_fp")))), lambda s: s["_fp"])
    return records.groupBy(*cluster, "entity").agg(*aggs, sources.alias("sources")).drop("entity")


def without_rejects(events: DataFrame, rejects: DataFrame, key: str = "fingerprint") -> tuple[DataFrame, DataFrame]:
    """Events none of whose contributing fingerprints is rejected, and those that one is."""
    bad = events.select(key, F.explode("sources").alias("_fp")).join(rejects.select(F.col("fingerprint").alias("_fp")), "_fp", "left_semi").select(key).distinct()
    return events.join(bad, key, "left_anti"), events.join(bad, key, "left_semi")


def normalize(raw: DataFrame, sources: DataFrame, groups: DataFrame, rejects: DataFrame, venues: DataFrame | None = None, settle=lambda df: df) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, rejected, problems) of one run; see the steps above.

    With ``venues``, the curated ones, records have an array ``venues`` instead
    of a venue: it is resolved, a curated venue of any record beats one that is
    not, its room comes with it, and a group's usual venue fills in.  ``settle``
    may write the resolved records, so that later steps don't compute them again.
    """
    records, problems = with_sources(raw, sources)
    names = F.concat(F.array("slug", "name"), F.coalesce("aliases", F.array().cast("array<string>")))
    records = resolve_groups(records, claimed_names(groups, "slug", names, "pos"), ["source_key", "upstream_id"])
    known = groups.select(F.col("slug").alias("group_slug"), "category")
    lost = records.join(known, "group_slug", "left_anti").select("source_key", "upstream_id", F.lit("unknown group").alias("message"))
    records = records.join(known, "group_slug").withColumn("fingerprint", fingerprint(F.col("kind"), F.col("upstream_id")))
    records = with_entities(records, ["group_slug", "start"], "source_key", ["source_key", "upstream_id"])
    order = ["priority", "upstream_id", "source_key"]
    cluster, winner, filled = ["group_slug", "start"], ["fingerprint", "title", "all_day", "category"], ["end", "url", "register_url", "excerpt"]
    if venues is None:
        events = merge_records(records, cluster, order, winner, [*filled, "venue"], ["virtual"])
    else:
        from .venues import curated_keys, default_venues, resolve_venues

        curated = curated_keys(venues)
        records = settle(resolve_venues(records, curated, ["source_key", "upstream_id"])).withColumn("uncurated", ~F.col("place.curated"))
        events = merge_records(records, cluster, order, winner, filled, ["virtual"], best={"place": ["uncurated", *order]})
        events = default_venues(events, groups, curated)
        events = events.withColumns({"venue": F.col("place.venue"), "room": F.col("place.room")}).drop("place")
        events = events.withColumn("categories", F.when(F.col("category").isNotNull(), F.array("category"))).drop("category")
    kept, gone = without_rejects(events, rejects)
    return kept, gone, problems.unionByName(lost)


def skip_breaker(units: DataFrame, total: str = "total", skipped: str = "skipped") -> DataFrame:
    """``failed``: at least 4 records, more than a third of them skipped."""
    return units.withColumn("failed", (F.col(total) >= 4) & (F.col(skipped) * 3 > F.col(total)))
