"""Learning is bounded, whatever ids repeat; scores are the noisy-or of sentences; held-out accuracy."""

import random

import numpy as np
import pyarrow as pa
import pytest

from feedloom.llm import toxicity
from feedloom.llm.shared import crc_mod

BAD = ["idiot", "scum", "vermin", "moron"]


def text(r, toxic):
    s = [" ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(r.randint(3, 9))) for _ in range(r.randint(1, 6))]
    if toxic:
        s.insert(r.randrange(len(s) + 1), f"you {r.choice(BAD)} go")
    return ". ".join(s) + "."


def test_scores_are_the_noisy_or_of_sentences():
    r = random.Random(2)
    y = [k % 5 == 0 for k in range(400)]
    w, bias = toxicity.train([text(r, t) for t in y], y)
    for t in (text(r, True), text(r, False), "", "...", "You idiot. You scum!\nfine"):
        col = pa.array([t], pa.large_string())
        from feedloom.llm.textops import buffers

        raw = buffers(col)
        p, _, lo, hi, _ = toxicity.judge(*raw, w, bias)
        s, f, doc, sa, _ = toxicity.features(*raw)
        clean = 1.0
        for k in range(len(doc)):
            clean *= 1 / (1 + np.exp(bias + sum(w[x] for x in set(f[s == k].tolist()))))
        assert p[0] == pytest.approx(1 - clean if len(doc) else 1 / (1 + np.exp(-bias)), rel=1e-3)
    assert len(lo) == 2 and (np.diff(np.stack([lo, hi])) > 0).all()


def test_bounded_learning(spark):
    r = random.Random(3)
    rows = [(i, text(r, i % 5 == 0)) for i in range(600)]
    rows += [(7, text(r, False)) for _ in range(300)] + [(8, None), (None, "x"), (9, "big " * 2_000_000)]  # one id many times, and a text too large to learn from
    labels = [(i, 0, int(i % 5 == 0)) for i in range(600)] + [(0, 1, 0), (None, 1, 1), (3, None, None), (10_000, 0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for sample, size in ((8000, 64 << 20), (500, 64 << 20), (8000, 60_000)):
        model = toxicity.fit(docs, labels, sample, size)
        got = toxicity.score(docs.filter(crc_mod("doc_id", 5) == 0).filter("doc_id < 600 and length(text) < 1000"), model).collect()
        hits = [(x.score >= 0.5) == (x.doc_id % 5 == 0) for x in got]
        assert len(hits) > 100 and sum(hits) >= 0.95 * len(hits)
    low = toxicity.fit(docs, labels, 8000, 1)
    assert (low[0] == 0).all() and low[1] < 0
    assert (toxicity.fit(docs.limit(0), labels.limit(0))[0] == 0).all()


def test_learning_takes_a_task_and_not_the_driver(spark, monkeypatch):
    r = random.Random(4)
    rows = [(i, text(r, i % 5 == 0), int(i % 5 == 0)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    learned = docs.filter(crc_mod("doc_id", 5) != 0).selectExpr("text", "toxic", "xxhash64(doc_id, text) AS h").orderBy("h").toArrow()
    w, bias = toxicity.train(learned["text"], learned["toxic"].to_numpy())
    monkeypatch.setattr(toxicity, "train", None)
    got = toxicity.fit(docs.select("doc_id", "text").repartition(3), docs.select("doc_id", "toxic"))
    assert (w != 0).any() and (got[0] == w).all() and got[0].dtype == w.dtype and got[1] == bias
