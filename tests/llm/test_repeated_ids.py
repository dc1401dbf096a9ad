"""Near copies among rows whose ids repeat or are null: what goes is decided by row."""

import random

import corpus_pipeline

VOC = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe", "ri") for b in ("s", "t", "v", "x", "z", "bo", "de", "fu")]


def prose(seed):
    return " ".join(random.Random(seed).choices(VOC, k=80))


def test_near_copies_by_row(spark):
    a, b, c, d, e = (prose(i) for i in range(5))
    rows = [(0, a), (1, a + " more"), (1, b), (2, b + " more"), (None, c), (None, c), (None, c + " more"), (None, d), (5, d), (6, e), (6, e), (7, None), (7, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    by_c = [r for r in got if r[0] is None and r[1] in (c, c + " more")]
    assert len(by_c) == 1
    got.remove(by_c[0])
    order = lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[1] is None)
    assert sorted(got, key=order) == sorted([(0, a), (1, b), (5, d), (6, e), (7, None), (7, ""), (None, None)], key=order)
