"""Which row of the history each event of a run writes.

Events are taken in order.  An event claims the rows that own its records; of
several the one first seen survives and the others go; what it then owns are its
records and no others, so records that it does not bring are free again; an event
that claims no row is a new one.  Events that share no row and no record cannot
touch each other, and nearly all are alone: these are joins and aggregates.  The
others fall into components, found by iterated least labels, and only within one
of these does the order matter.
"""

from __future__ import annotations

from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import settled


#: Events of shared components that one task takes, about.
MEMBERS = 4_000


def labels(links: DataFrame) -> DataFrame:
    """(event, label) of ``links`` (event, hub): the least event that hubs connect it to, by least labels and pointer jumps."""
    now = links.select("event", F.col("event").alias("label")).distinct()
    while True:
        hubs = links.join(now, "event").groupBy("hub").agg(F.min("label").alias("least"))
        step = links.join(hubs, "hub").groupBy("event").agg(F.min("least").alias("to"))
        jump = now.select(F.col("event").alias("to"), F.col("label").alias("far"))
        new = step.join(jump, "to").join(now, "event")
        new = settled(new.select("event", F.least("far", "to").alias("label"), (F.least("far", "to") < F.col("label")).alias("moved")))
        now = new.select("event", "label")
        if not new.filter("moved").limit(1).count():
            return now


def in_order(members: list[tuple]) -> list[list]:
    """The claims of one component: members are (old, at, id, status, records), its rows and its events."""
    owner, rows, out, waiting = {}, {}, [], {}
    for _, at, fp, status, fps in (m for m in members if m[0]):
        rows[fp] = {"seen": (0, at), "status": status, "owns": set(fps), "by": None}
        owner.update({f: fp for f in fps if f != fp or f not in owner})
    events = sorted((m for m in members if not m[0]), key=lambda m: (m[1] is not None, m[1], m[2]))
    for e in events:
        for f in e[4]:
            waiting[f] = waiting.get(f, 0) + 1
    for _, _, fp, status, fps in events:
        asks = set(fps)
        for f in asks:
            waiting[f] -= 1
        met = {owner[f] for f in asks if f in owner} | {f for f in asks if f in rows}
        # A row whose own record another event still brings is that event's.
        met = sorted((r for r in met if r in asks or not waiting.get(r)), key=lambda r: (rows[r]["seen"], r))
        row = met[0] if met else fp
        was = rows[row]["status"] if met else None
        for r in met:
            for f in [f for f in rows[r]["owns"] if owner.get(f) == r]:
                del owner[f]
            if rows[r]["by"] is not None:
                out[rows[r]["by"]][-1] = False
        for r in met[1:]:
            del rows[r]
        owner.update(dict.fromkeys(asks, row))
        rows[row] = {"seen": rows[row]["seen"] if met else (1, 0), "status": status, "owns": asks, "by": len(out)}
        out.append([fp, row, not met, len(met), met[1:], was == "pending" and status == "published", True])
    return out


def _components(part: pd.DataFrame) -> pd.DataFrame:
    """The claims of all components of a bucket."""
    out, members = [], list(part.sort_values("label")[["label", "old", "at", "id", "status", "fps"]].itertuples(index=False, name=None))
    for _, own in groupby(members, key=itemgetter(0)):
        out += in_order([m[1:] for m in own])
    return pd.DataFrame(out, columns=["new_fp", "row", "inserted", "matched", "gone", "promoted", "final"])


def claims(state: DataFrame, incoming: DataFrame) -> DataFrame:
    """(new_fp, row, inserted, matched, gone, promoted, final) for each incoming event.

    ``row`` is the identity that it writes, ``matched`` the rows that it claimed,
    ``gone`` those of them that merged into ``row``, ``final`` whether no later
    event of the run wrote or merged that row.  A row is found by a record of its
    provenance, or by its own fingerprint; an event that brings a row's own
    fingerprint has it before others.  The order is (start, fingerprint).
    """
    kind = state.schema["fingerprint"].dataType.simpleString()
    at = F.unix_micros(F.col("start").cast("timestamp_ltz")) if "start" in incoming.columns else F.lit(0).cast("long")
    status = lambda df: F.col("status") if "status" in df.columns else F.lit(None).cast("string")
    fps = lambda sources: F.array_distinct(F.filter(F.concat(F.coalesce(F.col(sources), F.array().cast(f"array<{kind}>")), F.array("fingerprint")), lambda f: f.isNotNull())).alias("fps")
    events = incoming.select(F.col("fingerprint").alias("id"), at.alias("at"), status(incoming).alias("status"), fps("sources"))
    rows = state.select(F.col("fingerprint").alias("id"), F.unix_micros(F.col("first_seen").cast("timestamp_ltz")).alias("at"), status(state).alias("status"), fps("sources"))
    asks = events.select(F.col("id").alias("event"), F.explode("fps").alias("fp"))
    met = settled(asks.join(rows.select(F.col("id").alias("row"), "at", "status", F.explode("fps").alias("fp")), "fp").select("event", "row", "at", "status").distinct())
    shared = lambda df, hub, tag: df.join(df.groupBy(hub).agg(F.count("*").alias("n")).filter("n > 1"), hub).select("event", F.struct(F.lit(tag).alias("what"), F.col(hub).cast("string").alias("id")).alias("hub"))
    links = settled(shared(met, "row", "row").unionByName(shared(asks, "fp", "record")))
    tied = labels(links) if links.limit(1).count() else links.select("event", F.col("event").alias("label"))
    first = F.struct("at", "row")
    alone = met.join(tied.select("event"), "event", "left_anti").groupBy("event").agg(
        F.min_by("row", first).alias("row"), F.min_by("status", first).alias("was"), F.count("*").cast("long").alias("matched"), F.collect_set("row").alias("all"))
    free = events.join(tied.select(F.col("event").alias("id")), "id", "left_anti").select("id", "status").join(alone.withColumnRenamed("event", "id"), "id", "left")
    none = F.col("row").isNull()
    promoted = F.coalesce((F.col("was") == "pending") & (F.col("status") == "published"), F.lit(False))
    free = free.select(
        F.col("id").alias("new_fp"), F.coalesce("row", "id").alias("row"), none.alias("inserted"), F.coalesce("matched", F.lit(0)).cast("long").alias("matched"),
        F.when(none, F.array().cast(f"array<{kind}>")).otherwise(F.array_remove("all", F.col("row"))).alias("gone"), promoted.alias("promoted"), F.lit(True).alias("final"),
    )
    theirs = met.join(tied, "event").select("label", F.col("row").alias("id")).distinct().join(rows, "id").withColumn("old", F.lit(True))
    group = events.join(tied.withColumnRenamed("event", "id"), "id").withColumn("old", F.lit(False)).unionByName(theirs)
    kinds = f"new_fp {kind}, row {kind}, inserted boolean, matched long, gone array<{kind}>, promoted boolean, final boolean"
    bucket = F.pmod(F.xxhash64("label"), F.lit(max(8, tied.count() // MEMBERS)))
    return free.unionByName(group.groupBy(bucket.alias("bucket")).applyInPandas(lambda part: _components(part), kinds))
