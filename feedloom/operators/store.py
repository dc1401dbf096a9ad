"""The event history: gate, upsert with write-once identity, enrichment, snapshots."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ledger import claims
from .lineage import settled


def gate(verified: Column) -> Column:
    """Fail closed: published only if the group is verified, decided anew each run."""
    return F.when(F.coalesce(verified, F.lit(False)), F.lit("published")).otherwise(F.lit("pending"))


def upsert(state: DataFrame, incoming: DataFrame, seen: Column, got: DataFrame | None = None) -> DataFrame:
    """The next state.  Both have fingerprint, start, title, status, sources; state also first_seen and last_seen.

    Updated rows keep fingerprint and first_seen; merged rows leave one; rows not
    seen stay as they are; a row that events of the run share no longer is written
    by one of them, and the others are new.  ``got`` has the :func:`claims` of
    these two, if they are known.
    """
    payload = [c for c in incoming.columns if c != "fingerprint"]
    got = settled(claims(state, incoming)) if got is None else got
    last = incoming.withColumnRenamed("fingerprint", "new_fp").join(got.filter("final").select("new_fp", F.col("row").alias("fingerprint")), "new_fp").drop("new_fp")
    gone = got.select(F.explode("gone").alias("fingerprint")).distinct()
    old = state.join(gone, "fingerprint", "left_anti")
    both = old.alias("o").join(last.alias("n"), "fingerprint", "full_outer")
    here = F.col("n.sources").isNotNull()
    cols = [F.when(here, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in payload]
    first = F.coalesce("o.first_seen", seen).alias("first_seen")
    final = F.when(here, seen).otherwise(F.col("o.last_seen")).alias("last_seen")
    return both.select("fingerprint", *cols, first, final)


def fill_blanks(old: DataFrame, new: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Rows matched by key keep what they have and take what they lack; others are added."""
    both = old.alias("o").join(new.alias("n"), key, "full_outer")
    return both.select(key, *(F.coalesce(F.nullif(F.col(f"o.{c}"), F.lit("")), F.nullif(F.col(f"n.{c}"), F.lit(""))).alias(c) for c in cols))


def mirror(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The registry's rows, and old ones that it no longer has."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def save_counts(state: DataFrame, incoming: DataFrame, got: DataFrame | None = None) -> DataFrame:
    """inserted, updated, promoted (pending before, published now) and merged of a run."""
    got = claims(state, incoming) if got is None else got
    return got.agg(
        F.count_if("inserted").alias("inserted"), F.count_if(~F.col("inserted")).alias("updated"), F.count_if("promoted").alias("promoted"), F.coalesce(F.sum(F.size("gone")), F.lit(0)).cast("long").alias("merged"),
    )


def violations(incoming: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(fingerprint, message) of events that must not be stored: without sources, start or group, or of a source that the registry lacks.

    ``known`` has the fingerprints' kinds, the part before the colon.
    """
    why = F.when(F.coalesce(F.size("sources"), F.lit(0)) <= 0, "no sources").when(F.col("start").isNull(), "no start").when(F.col("fingerprint").isNull(), "no fingerprint")
    bad = incoming.select("fingerprint", why.alias("message")).filter("message is not null")
    if known is None:
        return bad
    lost = incoming.select("fingerprint", F.explode("sources").alias("s")).withColumn("kind", F.substring_index("s", ":", 1)).join(known, "kind", "left_anti")
    return bad.unionByName(lost.select("fingerprint", F.lit("unknown source").alias("message")).distinct())


def check(incoming: DataFrame, seen: Column, known: DataFrame | None = None) -> None:
    """Raise before anything is written if an event, or the run's instant, breaks the store's rules."""
    if incoming.sparkSession.range(1).select(seen.alias("t")).first()["t"] is None:
        raise ValueError("the run has no instant")
    if bad := violations(incoming, known).limit(3).collect():
        raise ValueError("; ".join(f"{r.fingerprint}: {r.message}" for r in bad))


def provenance(state: DataFrame) -> DataFrame:
    """(fingerprint, event): which row each feed record makes up; if several list it, the one last seen has it."""
    rows = state.select(F.col("fingerprint").alias("event"), "last_seen", F.explode("sources").alias("fingerprint"))
    return rows.groupBy("fingerprint").agg(F.max_by("event", F.struct("last_seen", "event")).alias("event"))


def with_own_sources(state: DataFrame) -> DataFrame:
    """Rows without the records that have moved to another row; the order stays."""
    own = provenance(state).select(F.col("fingerprint").alias("s"), "event")
    each = state.select(F.col("fingerprint").alias("event"), F.posexplode("sources").alias("at", "s")).join(own, ["s", "event"])
    kept = each.groupBy("event").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "s"))), lambda x: x["s"]).alias("_own"))
    out = state.join(kept.withColumnRenamed("event", "fingerprint"), "fingerprint", "left")
    return out.withColumn("sources", F.coalesce("_own", F.array().cast("array<string>"))).select(*state.columns)


def category_rows(state: DataFrame) -> DataFrame:
    """(fingerprint, position, name): an event's categories as rows, replaced whole in each run."""
    return state.select("fingerprint", F.posexplode("categories").alias("position", "name"))


def groups_by_slug(groups: DataFrame) -> DataFrame:
    """The stored groups: a date that cannot be read is absent."""
    return groups.withColumn("verified_at", F.try_to_date(F.col("verified_at").cast("string"), "yyyy-MM-dd"))


def cancel_missing(state: DataFrame, seen: DataFrame, now: Column, window_end: Column, clean: bool, enabled: bool = False) -> DataFrame:
    """Optional, off by default: upcoming rows well inside the window that a clean run of all sources did not bring are cancelled."""
    if not enabled or not clean:
        return state
    mark = seen.select("fingerprint", F.lit(True).alias("_seen"))
    inside = (F.col("start") >= now) & (F.col("start") < window_end - F.expr("interval 2 days"))
    out = state.join(mark, "fingerprint", "left")
    return out.withColumn("status", F.when(inside & F.col("_seen").isNull(), F.lit("cancelled")).otherwise(F.col("status"))).drop("_seen")


#: The tables of a state; the events' folder keeps its short name.
EVENTS, GROUPS, VENUES, SOURCES = "v", "groups", "venues", "sources"


class Snapshots:
    """States of several tables in versioned folders.

    A version is all its tables and one mark, which is written last and names
    them: they come into force together or not at all, and a run that dies
    before leaves the old ones in force.  The mark also keeps the last batch of
    each stream, so a batch that is replayed is known.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return jvm.org.apache.hadoop.fs.Path, path.getFileSystem(conf)

    def _names(self) -> list[str]:
        path, fs = self._fs()
        return [s.getPath().getName() for s in fs.listStatus(path(self.root))] if fs.exists(path(self.root)) else []

    def version(self) -> int | None:
        return max((int(n[4:]) for n in self._names() if n.startswith("now=")), default=None)

    def mark(self, version: int | None = None) -> dict:
        """What a version's mark says: its ``tables``, and ``streams`` with the last batch of each."""
        version = self.version() if version is None else version
        text = "" if version is None else "".join(r[0] for r in self.spark.read.text(f"{self.root}/now={version}").collect())
        return {"tables": [EVENTS], "streams": {}} | (json.loads(text) if text else {})

    def read(self, table: str = EVENTS) -> DataFrame | None:
        """A table of the version in force; None before the first, or if it has no such table."""
        v = self.version()
        return self.read_at(v, table) if v is not None and table in self.mark(v)["tables"] else None

    def read_at(self, version: int, table: str = EVENTS) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{table}={version:06d}")

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written beside the version to come, without a mark, and read back."""
        v = (self.version() or 0) + 1
        self._put(df, name, v)
        return self.read_at(v, name)

    def _put(self, df: DataFrame, table: str, version: int) -> None:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{table}={version:06d}")

    def done(self, stream: str, batch: int) -> bool:
        """Whether a version in force has this batch, or a later one, of a stream."""
        return self.mark()["streams"].get(stream, -1) >= batch

    def commit(self, tables: dict[str, DataFrame], batch: tuple[str, int] | None = None) -> int:
        """Write the next version of all ``tables``, then its mark.

        One writer at a time: a version is claimed by a file that only one can
        create, so a second writer fails before it writes.
        """
        v = (self.version() or 0) + 1
        path, fs = self._fs()
        claim = path(f"{self.root}/claim={v}")
        fs.mkdirs(path(self.root))
        if not fs.createNewFile(claim):
            raise RuntimeError(f"another run writes version {v}; remove {claim.toString()} if it has died")
        try:
            for table, df in tables.items():
                self._put(df, table, v)
            streams = self.mark()["streams"] | (dict([batch]) if batch else {})
            # Written aside and renamed, so that a mark is whole or not there.
            own = path(f"{self.root}/.mark={v}")
            out = fs.create(own, True)
            out.write(bytearray(json.dumps({"tables": list(tables), "streams": streams}).encode()))
            out.close()
            if not fs.rename(own, path(f"{self.root}/now={v}")):
                raise RuntimeError(f"version {v} is there already")
        finally:
            fs.delete(claim, False)
        return v

    def write(self, df: DataFrame) -> int:
        """The next version of the events alone."""
        return self.commit({EVENTS: df})

    def prune(self, keep: int = 10) -> None:
        """Delete all but the last ``keep`` versions, and what runs left beside them; nobody may still read those."""
        path, fs = self._fs()
        now = self.version()
        for name in self._names():
            part, _, number = name.partition("=")
            if now is not None and number.isdigit() and part != "claim" and (int(number) <= now - keep or part == "run" and int(number) <= now):
                fs.delete(path(f"{self.root}/{name}"), True)


def write_atomically(path: str, pieces: Iterable[str]) -> int:
    """A local file of some pieces of text, whole or not at all, readable by all; returns how many pieces there were."""
    own, n = f"{path}.{uuid.uuid4().hex}", 0
    try:
        with open(own, "w", encoding="utf-8") as f:
            for piece in pieces:
                n += 1
                f.write(piece)
        os.chmod(own, 0o644)
        os.replace(own, path)
    finally:
        if os.path.exists(own):
            os.remove(own)
    return n
