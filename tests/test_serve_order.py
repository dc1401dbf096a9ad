"""The feed in order without gathering it, sections, and days looked up by month."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from feedloom.operators import serve, store

WIRE = "id string, title string, start string, room string"


@pytest.mark.parametrize("rows", [[], [("b", "Ü <b>", "2026-01-02T00:00:00Z", None), ("a", 'q"\n', "2026-01-02T00:00:00Z", "r"), ("c", "x", "2026-01-01T00:00:00Z", None)]])
@pytest.mark.parametrize("preview", [True, False])
def test_the_file_is_the_feed(spark, tmp_path, rows, preview):
    df = spark.createDataFrame(rows, WIRE).repartition(3)
    pieces = serve.feed_text((r["line"] for r in serve.feed_lines(df).toLocalIterator()), "2026-01-01T00:00:00Z", preview)
    assert store.write_atomically(str(tmp_path / "f.json"), pieces) == len(rows) + 2
    want = serve.feed_json(df, F.lit("2026-01-01 00:00:00").cast("timestamp_ntz"), preview).first()["body"]
    assert (tmp_path / "f.json").read_text() == serve.indented(want)


def test_a_file_that_fails_leaves_the_old_one(tmp_path):
    path = tmp_path / "f.json"
    store.write_atomically(str(path), ["old"])

    def broken():
        yield "new"
        raise ValueError("lost")

    with pytest.raises(ValueError, match="lost"):
        store.write_atomically(str(path), broken())
    assert path.read_text() == "old" and [p.name for p in tmp_path.iterdir()] == ["f.json"]


def test_days_by_month(spark):
    days = [date(2026, 1, 5), date(2026, 1, 20), date(2026, 4, 1)]
    asked = [date(2025, 11, 3), date(2026, 1, 5), date(2026, 1, 6), date(2026, 1, 21), date(2026, 2, 10), date(2026, 4, 1), date(2026, 4, 2), date(2027, 1, 1), None]
    make = lambda rows: spark.createDataFrame([(d,) for d in rows], "day date")
    got = serve.first_day_from(make([*days, days[0]]), make(asked))
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r.day: r.lands for r in got.collect()} == {a: min((d for d in days if a and d >= a), default=None) for a in asked}
    assert [r.lands for r in serve.first_day_from(make([]), make(asked[:2])).collect()] == [None, None]


def test_sections_begin_once(spark):
    rows = [(f"e{k:03}", datetime(2026, 1, 1 + k % 3, 18, k % 60)) for k in range(120)]
    got = serve.day_rows(spark.createDataFrame(rows, "fingerprint string, start timestamp_ntz").repartition(7)).collect()
    assert [(r.start, r.fingerprint) for r in got] == sorted((t, f) for f, t in rows)
    assert [i for i, r in enumerate(got) if r.heading] == [0, 40, 80]
