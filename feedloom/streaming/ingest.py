"""Continuous ingestion: files that land in a folder become the next state, one micro-batch a run.

A batch's number is part of the mark that puts its state in force.  A batch that
Spark replays after a failure is either in force already, and passed over, or
left no mark, and written anew: each makes one version.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import normalize, store, sync
from ..operators.lineage import settled
from ..sources.fetch import SCHEMA as BODIES


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a query keeps over restarts, from its checkpoint; a new checkpoint is a new stream."""
    return json.loads("".join(r[0] for r in spark.read.text(f"{checkpoint}/metadata").collect()))["id"]


def _started(rows: DataFrame, snapshots: store.Snapshots, checkpoint: str, once: Callable[[DataFrame, tuple[str, int]], None]):
    def run(batch: DataFrame, number: int) -> None:
        at = stream_id(batch.sparkSession, checkpoint), number
        if not snapshots.done(*at):
            once(batch, at)

    return rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _instant(seen: Column | None) -> Column:
    return seen if seen is not None else F.current_timestamp().cast("timestamp_ntz")


def ingest(spark: SparkSession, folder: str, schema: str, snapshots: store.Snapshots, sources: DataFrame, groups: DataFrame, rejects: DataFrame, checkpoint: str, seen: Column | None = None, venues: DataFrame | None = None):
    """A started query (available now) over decoded records; with ``venues``, the curated ones, records bring an array of places that are resolved."""
    verified = groups.select(F.col("slug").alias("group_slug"), (F.coalesce(F.trim("verified_by"), F.lit("")) != "").alias("verified"))

    def once(batch: DataFrame, at: tuple[str, int]) -> None:
        events, _, _ = normalize.normalize(batch, sources, groups, rejects, venues, settled)
        now = _instant(seen)
        events = events.join(verified, "group_slug", "left").withColumn("status", store.gate(F.col("verified"))).drop("verified")
        old = snapshots.read()
        if old is None:
            old = events.limit(0).withColumns({"first_seen": now, "last_seen": now})
        events = settled(events)
        snapshots.commit({store.EVENTS: store.upsert(old, events, now)}, at)

    return _started(spark.readStream.schema(schema).json(folder), snapshots, checkpoint, once)


def ingest_bodies(spark: SparkSession, folder: str, snapshots: store.Snapshots, registry: dict[str, DataFrame], rejects: DataFrame, since: Column, to: Column, checkpoint: str, title: str = "Schedule", seen: Column | None = None):
    """A started query (available now) over fetched bodies: each batch is a run, decoded, resolved and merged, and saved with the registry's tables.

    A batch in which every source failed changes nothing.
    """

    def once(batch: DataFrame, at: tuple[str, int]) -> None:
        run = sync.conclude(settled(batch), registry, rejects, since, to, title)
        if run.status.filter("error is null").limit(1).count():
            sync.save(run, snapshots, _instant(seen), registry, at)

    return _started(spark.readStream.schema(BODIES).json(folder), snapshots, checkpoint, once)


def hourly_counts(events: DataFrame, time: str = "ts", late: str = "2 days", key: str = "event_type") -> DataFrame:
    """Events of each hour and key; rows later than the watermark are not counted.  Works on streams and tables."""
    return events.withWatermark(time, late).groupBy(F.window(time, "1 hour").alias("w"), key).agg(F.count("*").alias("events")).select(F.col("w.start").alias("hour"), key, "events")
