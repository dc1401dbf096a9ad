"""Which rows events write: chains, splits and moved records, against a sequential walk over one map."""

import random

import pytest
from pyspark.sql import functions as F

from feedloom.operators import ledger, store

EV = "fingerprint string, title string, start timestamp_ntz, status string, sources array<string>"
T1, T2 = "timestamp_ntz'2024-01-02 00:00:00'", "timestamp_ntz'2024-02-02 00:00:00'"


def state_of(spark, rows, day="2024-01-0"):
    df = spark.createDataFrame([(fp, fp, "pending", src, seen) for fp, src, seen in rows], "fingerprint string, title string, status string, sources array<string>, seen int")
    at = F.concat(F.lit(day), F.col("seen").cast("string")).cast("timestamp_ntz")
    return df.withColumns({"start": at, "first_seen": at, "last_seen": at}).drop("seen")


def run_of(spark, events):
    df = spark.createDataFrame([(fp, "new " + fp, "published", src, k) for k, (fp, src) in enumerate(events)], "fingerprint string, title string, status string, sources array<string>, k int")
    return df.withColumn("start", F.timestamp_add("DAY", "k", F.expr(T2)).cast("timestamp_ntz")).drop("k")


def after(spark, rows, events):
    state, new = state_of(spark, rows), run_of(spark, events)
    got = {r.fingerprint: (r.title, sorted(r.sources), r.first_seen.month) for r in store.upsert(state, new, F.expr(T2)).collect()}
    return got, tuple(store.save_counts(state, new).first())


def test_chains_leave_one_row_with_the_earliest_identity(spark):
    got, counts = after(spark, [("A", ["A"], 1), ("B", ["B"], 2), ("C", ["C"], 3)], [("X", ["A", "B"]), ("Y", ["B", "C"])])
    assert got == {"A": ("new Y", ["B", "C"], 1)} and counts == (0, 2, 1, 2)


@pytest.mark.parametrize("order", [("A", "B"), ("B", "A")])
def test_a_split_row_keeps_both_events(spark, order):
    got, counts = after(spark, [("A", ["A", "B"], 1)], [(x, [x]) for x in order])
    assert got == {"A": ("new A", ["A"], 1), "B": ("new B", ["B"], 2)} and counts == (1, 1, 1, 0)


def test_a_row_without_its_own_record_is_still_found_by_it(spark):
    got, _ = after(spark, [("A", ["B", "C"], 1)], [("B", ["B", "C"]), ("A", ["A"])])
    assert got == {"A": ("new A", ["A"], 1), "B": ("new B", ["B", "C"], 2)}


def test_a_record_moves_to_another_row(spark):
    got, counts = after(spark, [("A", ["A", "M"], 1), ("B", ["B"], 2), ("Z", ["Z"], 3)], [("A", ["A"]), ("B", ["B", "M"])])
    assert got == {"A": ("new A", ["A"], 1), "B": ("new B", ["B", "M"], 1), "Z": ("Z", ["Z"], 1)} and counts == (0, 2, 2, 0)


def walk(rows, events):
    """One event after another over a map of records to rows."""
    live = {fp: [seen, set(src)] for fp, src, seen in rows}
    title = {fp: fp for fp in live}
    for k, (fp, src) in enumerate(events):
        mine = {*src, fp}
        later = set().union(*({*s, f} for f, s in events[k + 1 :]))
        met = [r for r in live if (mine & (live[r][1] | {r})) and (r in mine or r not in later)]
        met = [r for r in met if mine & live[r][1] or r in mine]
        met.sort(key=lambda r: (live[r][0], r))
        row = met[0] if met else fp
        seen = live[row][0] if met else 99
        for r in met:
            del live[r], title[r]
        live[row], title[row] = [seen, mine], "new " + fp
    return {r: title[r] for r in live}


@pytest.mark.parametrize("seed", range(4))
def test_random_runs_match_a_walk(spark, seed):
    r = random.Random(seed)
    names = [f"r{i:02}" for i in range(40)]
    r.shuffle(names)
    rows, i = [], 0
    while i < 28:
        n = r.randint(1, 3)
        rows.append((names[i], names[i : i + n], r.randint(1, 9)))
        i += n
    events, used = [], set()
    for _ in range(14):
        src = r.sample(names, r.randint(1, 3))
        if src[0] not in used:
            used.add(src[0])
            events.append((src[0], src))
    got, _ = after(spark, rows, events)
    assert {k: v[0] for k, v in got.items()} == walk(rows, events)


def test_labels_of_a_long_chain(spark):
    links = spark.range(40).select(F.col("id").alias("event"), F.explode(F.array("id", F.col("id") + 1)).alias("hub")).unionByName(spark.sql("select 100L as event, 500L as hub"))
    assert {(r.event, r.label) for r in ledger.labels(links).collect()} == {(i, 0) for i in range(40)} | {(100, 100)}
