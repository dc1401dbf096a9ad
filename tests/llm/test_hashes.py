"""Strings that polynomials modulo a power of two cannot tell apart."""

import numpy as np
import pytest

from feedloom.llm import byte_dedup, jaccard, passage_dedup, suffix_lm
from feedloom.llm.textops import Prefix, U, Words, byte_values


def twins(k, x="a", y="b"):
    """The two Thue-Morse strings of 2**k parts."""
    for _ in range(k):
        x, y = x + y, y + x
    return x, y


def test_ranges_by_both_ways():
    data = np.random.default_rng(0).integers(0, 256, 70_000).astype(np.uint8)
    p = Prefix(data, 9, byte_values(9))
    i = np.arange(len(data) - 400 + 1)
    assert (p.slide(400) == p.of(i, i + 400)).all() and len(np.unique(p.slide(400))) == len(i)
    q = Prefix(data[50_000:], 9, byte_values(9))
    assert (p.slide(31)[50_000:] == q.slide(31)).all()
    values = byte_values(9)[data]
    assert (Prefix(values, 9).of(i, i + 7) == p.of(i, i + 7)).all() and not len(Prefix(data[:3], 9, byte_values(9)).slide(4))


def test_twin_words_and_sequences():
    a, b = twins(10)
    raw = np.frombuffer(f"{a} {b}".encode(), np.uint8)
    h = Words(raw, np.array([0, len(raw)])).hash
    assert h[0] != h[1]
    x, y = (np.array([1 if c == "a" else 2 for c in s], U) for s in (a, b))
    assert Prefix(x, 2).of(np.array([0]), np.array([1024])) != Prefix(y, 2).of(np.array([0]), np.array([1024]))


def test_twin_words_are_not_one(spark):
    """What looked like a repeated window, a link and a known word before."""
    a, b = twins(10)
    words = [f"w{i}" for i in range(34)]
    docs = spark.createDataFrame([(1, " ".join([*words, a])), (2, " ".join([*words, b])), (3, f"{a} x y z"), (4, f"{b} x y z")], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in passage_dedup.remove_repeats(docs).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 0}
    got = {r.doc_id: r.component_id for r in jaccard.near_groups(docs).collect()}
    assert got[3] == 3 and got[4] == 4
    known = {r.doc_id: r.n_known for r in suffix_lm.scored(docs.filter("doc_id > 2"), (7, 6)).collect()}  # 3 is held out
    assert known == {3: 4, 4: 5}


def test_a_blocks_documents_have_one_order():
    """Each step of op9 reads the exchange anew, and names a block's rows by their place."""
    import pyarrow as pa

    from feedloom.llm.byte_dedup import ordered

    t = pa.table({"doc_id": pa.array([3, None, 1, 3, None], pa.int64()), "h": [5, 9, 7, 4, 8], "text": list("abcde")})
    want = ordered(t)["text"].to_pylist()
    assert want == ["c", "d", "a", "e", "b"]
    assert all(ordered(t.take(o))["text"].to_pylist() == want for o in ([4, 3, 2, 1, 0], [2, 0, 4, 1, 3]))


@pytest.mark.parametrize("bits", [64, 6, 2])
def test_windows_that_meet_by_the_first_hash_alone_stay(spark, bits):
    """Forty documents of other words and one repeated passage: however narrow the first hash, nothing else goes."""
    own = [" ".join(f"d{i}w{j}" for j in range(60)) for i in range(40)]
    same = " ".join(f"s{j}" for j in range(40))
    # Two words apart from a passage that is in two others: its anchors repeat, its windows don't.
    almost = " ".join(f"s{j}" if j not in (0, 34) else f"x{j}" for j in range(40))
    docs = spark.createDataFrame([*enumerate(own), (50, f"{own[0][:20]} {same}"), (51, f"y {same} z"), (52, almost)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in passage_dedup.remove_repeats(docs, bits=bits).collect() if r.n_removed}
    assert got == {50: 40, 51: 40}


def test_a_row_that_a_third_of_the_table_repeats_has_no_block_of_its_own(spark, tmp_path):
    """Blocks of op1, op4, op8 and op9; every scan deals alike, however it is split."""
    from feedloom.llm import blocks

    rows = [(1, "same words here")] * 4000 + [(i, f"text {i}") for i in range(8000)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    assert blocks.replayable(docs) is docs and blocks.replayable(docs.distinct()) is not docs
    sizes = sorted(r["count"] for r in blocks.dealt(docs, 16).groupBy("block").count().collect())
    assert len(sizes) == 16 and sizes[-1] < 2 * sizes[8] and sum(sizes) == 12000
    assert blocks.dealt(docs.filter("doc_id = 1"), 16).select("block").distinct().count() == 16
    one = blocks.dealt(docs, 16).select("block", "doc_id", "text")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
        assert one.exceptAll(docs.select(blocks.block(docs, 16), "doc_id", "text")).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_repeated_rows_in_bulk(spark):
    """One row repeated for a third of all: each copy loses its repeated words and is linked to the others."""
    text = " ".join(f"s{j}" for j in range(80))
    docs = spark.createDataFrame([(1, text)] * 300 + [(i, f"t{i} " * 5) for i in range(10, 610)], "doc_id long, text string")
    got = passage_dedup.remove_repeats(docs).groupBy("n_removed").count().collect()
    assert {(r.n_removed, r["count"]) for r in got} == {(80, 300), (0, 600)}
    assert jaccard.near_groups(docs).filter("doc_id = 1 and component_id = 1").count() == 300
    assert byte_dedup.remove_repeated_bytes(spark.createDataFrame([(1, text * 2)] * 30 + [(2, "a")], "doc_id long, text string")).filter("doc_id = 1 and n_removed = n_bytes").count() == 30
    scores = suffix_lm.scored(docs).filter("doc_id = 1").groupBy("n_tokens", "train_tokens").count().collect()
    assert [r["count"] for r in scores] == [300]
