"""Rows that no run has brought back, by state of their own: a timer for each row instead of a join with the whole state.

Runs are a stream of (fingerprint, start, status, seen, clean): what a run
brought, at its instant ``seen``, and whether all its sources worked.  A run
also sends a row without a fingerprint, so that one that brings nothing counts.
The watermark is the instant of the last clean run.  Each row that a run brings
sets a timer just after it; the next clean run that does not bring the row moves
the watermark past the timer, and the row is cancelled if it lies well inside that
run's window.  State is kept for rows that may still be cancelled only: it goes
when a row is cancelled or its start has passed.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import store
from ..operators.lineage import new_path
from .ingest import stream_id

RUNS = "fingerprint string, start timestamp_ntz, status string, seen timestamp_ntz, clean boolean"
OUT = "fingerprint string, status string, seen_ms long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Absence(StatefulProcessor):
    """A fingerprint's start, the instant it was last seen and its timer for the next clean run, in milliseconds."""

    def __init__(self, ahead: timedelta, margin: timedelta):
        self.inside = int((ahead - margin) / timedelta(milliseconds=1))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.row = handle.getValueState("row", "start_ms long, seen_ms long, timer_ms long")

    def _wait(self, seen: int, start: int | None, timer: int | None) -> None:
        """Wait from ``seen`` on; ``timer`` is the one that is set.  Each call on the state is a message to the JVM, so none is made in vain."""
        if timer is not None and (start is None or timer != seen + 1):
            self.handle.deleteTimer(timer)
        if start is not None:
            self.row.update((start, seen, seen + 1))
            if timer != seen + 1:
                self.handle.registerTimer(seen + 1)
        elif timer is not None:
            self.row.clear()

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:
        old = self.row.get()
        self._wait(initialState.seen_ms, initialState.start_ms, None if old is None else old[2])

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        if key[0] is None:
            return
        # Of one instant's rows the greatest start and status count, whatever the order they come in.
        last = max(((r.seen_ms, -1 if r.start_ms is None else r.start_ms, r.status or "", r.has_start) for r in rows), default=None)
        if last is None:
            return
        seen, start, status, has_start = last
        old = self.row.get()
        if old is None or seen >= old[1]:
            self._wait(seen, start if has_start else None, None if old is None else old[2])
            yield Row(fingerprint=key[0], status=status, seen_ms=seen)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        row, now = self.row.get(), timerValues.getCurrentWatermarkInMs()
        if row is None:
            return
        start, seen, _ = row
        if start >= now + self.inside:
            self.row.update((start, seen, now + 1))
            self.handle.registerTimer(now + 1)
            return
        self.row.clear()
        if start >= now:
            yield Row(fingerprint=key[0], status="cancelled", seen_ms=seen)

    def close(self) -> None:
        pass


def _millis(col: str):
    return F.unix_millis(F.col(col).cast("timestamp"))


def watched(runs: DataFrame, ahead: timedelta, margin: timedelta = timedelta(days=2), state: DataFrame | None = None) -> DataFrame:
    """Changes of status: (fingerprint, status, seen_ms), each row that a run brings, and "cancelled" for those that a clean run leaves out.

    ``ahead`` is the length of a run's window.  ``state`` (fingerprint, start,
    last_seen) has rows known before the stream began.  Rows without a fingerprint
    only tell of their run; rows without a start are never cancelled; repeated rows
    of a run are one; a run that is not clean cancels nothing, but keeps what it
    brings; rows of a run before the last clean one come too late and are passed
    over.  Runs that arrive in one micro-batch are judged as one, at the instant
    of the last clean one.
    """
    # Only clean runs move the watermark; the others' rows have no event time and are never late.
    rows = runs.select(
        "fingerprint", _millis("start").alias("start_ms"), F.col("start").isNotNull().alias("has_start"), "status", _millis("seen").alias("seen_ms"),
        F.when(F.col("clean"), F.col("seen").cast("timestamp")).alias("at"),
    )
    known = None
    if state is not None:
        known = state.filter("fingerprint is not null and start is not null").select("fingerprint", _millis("start").alias("start_ms"), _millis("last_seen").alias("seen_ms")).groupBy("fingerprint")
    return rows.withWatermark("at", "0 seconds").groupBy("fingerprint").transformWithState(Absence(ahead, margin), OUT, "Update", "EventTime", known)


@contextmanager
def rocks(spark: SparkSession):
    """Queries started here keep their state in RocksDB, which timers need; the session's own setting is put back."""
    was = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, was)


def changes_of(runs: DataFrame, ahead: timedelta, margin: timedelta = timedelta(days=2)) -> DataFrame:
    """All changes that a stream has for now, as a table in the shared folder; a replayed batch writes its part anew."""
    root = new_path(runs.sparkSession, "absence")
    runs.sparkSession.createDataFrame([], OUT).write.parquet(f"{root}/changes/batch=-1")

    def once(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/changes/batch={number}")

    with rocks(runs.sparkSession):
        q = watched(runs, ahead, margin).writeStream.outputMode("update").foreachBatch(once).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return runs.sparkSession.read.parquet(f"{root}/changes").drop("batch")


def apply_changes(state: DataFrame, changes: DataFrame) -> DataFrame:
    """The state with the cancellations of some changes; a row seen again since its timer was set keeps its status."""
    gone = changes.filter("status = 'cancelled'").groupBy("fingerprint").agg(F.max("seen_ms").alias("_seen_ms"))
    out = state.join(gone, "fingerprint", "left")
    hit = F.coalesce(_millis("last_seen") <= F.col("_seen_ms"), F.lit(False))
    return out.withColumn("status", F.when(hit, F.lit("cancelled")).otherwise(F.col("status"))).drop("_seen_ms").select(*state.columns)


def cancel(runs: DataFrame, snapshots: store.Snapshots, checkpoint: str, ahead: timedelta, margin: timedelta = timedelta(days=2)):
    """A started query (available now) that writes cancellations to the state in force; a replayed batch makes no version.

    Rows that the state has when the stream begins are watched from the start, cancelled ones aside.
    """
    spark, now = snapshots.spark, snapshots.read()
    known = None if now is None else now.filter("coalesce(status, '') <> 'cancelled'")

    def once(batch: DataFrame, number: int) -> None:
        at = stream_id(batch.sparkSession, checkpoint), number
        state = snapshots.read()
        if state is not None and not snapshots.done(*at):
            batch = batch.persist()
            try:
                if batch.filter("status = 'cancelled'").limit(1).count():
                    tables = {t: snapshots.read(t) for t in snapshots.mark()["tables"]}
                    snapshots.commit(tables | {store.EVENTS: apply_changes(state, batch)}, at)
            finally:
                batch.unpersist()

    with rocks(spark):
        return watched(runs, ahead, margin, known).writeStream.outputMode("update").foreachBatch(once).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
