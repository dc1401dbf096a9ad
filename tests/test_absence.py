"""State by key with timers: the same rows as cancel_missing after the same runs."""

import json
from datetime import datetime as T
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from feedloom.operators import store
from feedloom.streaming import absence, ingest

AHEAD = timedelta(days=20)
#: (instant, clean, {fingerprint: start})
RUNS = [
    (T(2024, 1, 1), True, {"a": T(2024, 1, 10), "b": T(2024, 1, 10), "past": T(2024, 1, 2), "edge": T(2024, 1, 21), "far": T(2024, 2, 20), "none": None}),
    (T(2024, 1, 3), False, {"a": T(2024, 1, 10)}),
    (T(2024, 1, 4), True, {"a": T(2024, 1, 10)}),
    (T(2024, 1, 5), True, {"b": T(2024, 1, 12), "late": T(2024, 1, 15)}),
    (T(2024, 1, 6), True, {}),
    (T(2024, 1, 7), True, {"late": T(2024, 1, 15), "a": T(2024, 1, 11)}),
]


def ntz(x):
    return F.lit(x).cast("timestamp_ntz")


def land(folder, n, run, copies=1):
    seen, clean, rows = run
    lines = [{"seen": str(seen), "clean": clean}] + [{"fingerprint": k, "start": v and str(v), "status": "published", "seen": str(seen), "clean": clean} for k, v in rows.items()] * copies
    (folder / f"{n}.json").write_text("\n".join(json.dumps(x) for x in lines))


def after(spark, runs):
    """The statuses after some runs, by cancel_missing."""
    state = {}
    for seen, clean, rows in runs:
        state |= {k: (v, "published") for k, v in rows.items()}
        df = spark.createDataFrame([(k, v, s) for k, (v, s) in state.items()], "fingerprint string, start timestamp_ntz, status string")
        brought = spark.createDataFrame([(k,) for k in rows], "fingerprint string")
        got = store.cancel_missing(df, brought, ntz(seen), ntz(seen + AHEAD), clean, enabled=True)
        state = {r.fingerprint: (r.start, r.status) for r in got.collect()}
    return {k: s for k, (_, s) in state.items()}


def stream(spark, folder):
    return spark.readStream.schema(absence.RUNS).option("maxFilesPerTrigger", 1).json(str(folder))


def told(spark, folder, checkpoint, status):
    def keep(batch, number):
        for r in batch.collect():
            status[r.fingerprint] = r.status

    with absence.rocks(spark):
        q = absence.watched(stream(spark, folder), AHEAD).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    q.awaitTermination()
    return status


def test_as_cancel_missing_over_a_restart(spark, tmp_path):
    before = spark.conf.get(absence.PROVIDER)
    folder, status = tmp_path / "runs", {}
    folder.mkdir()
    for n, run in enumerate(RUNS):
        land(folder, n, run, copies=3 if n == 0 else 1)
        told(spark, folder, tmp_path / "cp", status)  # each start is a restart from the checkpoint
        assert status == after(spark, RUNS[: n + 1]), n
    assert {k for k, s in status.items() if s == "cancelled"} == {"b", "edge"}
    assert spark.conf.get(absence.PROVIDER) == before


def test_rows_of_an_old_run_come_too_late(spark, tmp_path):
    folder, status = tmp_path / "runs", {}
    folder.mkdir()
    land(folder, 0, RUNS[0])
    land(folder, 1, RUNS[2])
    told(spark, folder, tmp_path / "cp", status)
    assert status["b"] == "cancelled"
    land(folder, 2, (T(2024, 1, 2), True, {"b": T(2024, 1, 10)}))
    told(spark, folder, tmp_path / "cp", status)
    assert status["b"] == "cancelled"


@pytest.mark.parametrize("again", [False, True])
def test_the_state_in_force_is_cancelled(spark, tmp_path, again):
    snaps, folder = store.Snapshots(spark, str(tmp_path / "state")), tmp_path / "runs"
    folder.mkdir()
    schema = "fingerprint string, start timestamp_ntz, title string, status string, sources array<string>, first_seen timestamp_ntz, last_seen timestamp_ntz"
    old, new = T(2023, 12, 31), T(2024, 1, 9)
    rows = [("a", T(2024, 1, 10), "A", "published", ["s"], old, old), ("b", T(2024, 1, 10), "B", "pending", ["s"], old, new if again else old), ("c", T(2024, 1, 10), "C", "cancelled", ["s"], old, old)]
    snaps.write(spark.createDataFrame(rows, schema))
    land(folder, 0, (T(2024, 1, 1), True, {"a": T(2024, 1, 10)}))
    absence.cancel(stream(spark, folder), snaps, str(tmp_path / "cp"), AHEAD).awaitTermination()
    assert {r.fingerprint: r.status for r in snaps.read().collect()} == {"a": "published", "b": "pending" if again else "cancelled", "c": "cancelled"}
    assert snaps.version() == (1 if again else 2)
    absence.cancel(stream(spark, folder), snaps, str(tmp_path / "cp"), AHEAD).awaitTermination()
    assert snaps.version() == (1 if again else 2)


def test_counts_of_hours_leave_late_rows_out(spark, tmp_path):
    folder, out = tmp_path / "in", {}
    folder.mkdir()

    def run(n, *times):
        (folder / f"{n}.json").write_text("\n".join(json.dumps({"ts": t, "event_type": "x"}) for t in times))

        def keep(batch, _):
            out.update({r.hour.isoformat(): r.events for r in batch.collect()})

        counts = ingest.hourly_counts(spark.readStream.schema("ts timestamp, event_type string").json(str(folder)))
        counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    run(0, "2024-01-01T00:10:00Z", "2024-01-05T00:10:00Z")
    run(1, "2024-01-01T00:20:00Z", "2024-01-04T00:20:00Z", "2024-01-05T00:30:00Z")
    assert out == {"2024-01-01T00:00:00": 1, "2024-01-04T00:00:00": 1, "2024-01-05T00:00:00": 2}


def test_a_key_asks_its_state_no_more_than_it_must():
    from pyspark.sql import Row

    class Handle:
        def __init__(self):
            self.calls, self.value, self.timers = [], None, set()

        def getValueState(self, *_):
            return self

        def get(self):
            self.calls.append("get")
            return self.value

        def update(self, value):
            self.calls.append("update")
            self.value = value

        def clear(self):
            self.calls.append("clear")
            self.value = None

        def listTimers(self):
            self.calls.append("list")
            return iter(sorted(self.timers))

        def registerTimer(self, t):
            self.calls.append("register")
            self.timers.add(t)

        def deleteTimer(self, t):
            self.calls.append("delete")
            self.timers.remove(t)

    row = lambda seen, start: Row(fingerprint="a", start_ms=start, has_start=start is not None, status="published", seen_ms=seen, at=None)
    p, h = absence.Absence(AHEAD, timedelta(days=2)), Handle()
    p.init(h)
    for seen, start, calls, timers in [(10, 99, ["get", "update", "register"], {11}), (10, 99, ["get", "update"], {11}), (20, 99, ["get", "delete", "update", "register"], {21}), (15, 99, ["get"], {21}), (30, None, ["get", "delete", "clear"], set())]:
        h.calls.clear()
        list(p.handleInputRows(("a",), iter([row(5, 1), row(seen, start)]), None))
        assert (h.calls, h.timers) == (calls, timers)
