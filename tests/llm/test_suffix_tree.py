"""op4 against a tree counted in full: what follows a context once is scored as seen, in training and held-out documents."""

import math
import random
from collections import Counter

import pytest

from feedloom.llm import suffix_lm
from feedloom.llm.shared import crc_mod

PHRASES = ["red fox runs", "blue fish swims", "old man sees", "red fox sleeps", "old fish eats"]


def texts():
    r = random.Random(4)
    for i in range(150):
        yield i, " ".join(f"{r.choice(PHRASES)} {f'rare{r.randrange(900)}' if r.random() < 0.4 else r.choice('abcd')}" for _ in range(12))


def tree(rows, train):
    """(doc_id, score, tokens after a kept context that are seen after it once) by counts of every word, pair and triple."""
    c1, c2, c3 = Counter(), Counter(), Counter()
    docs = {i: (*t.split(), "<end>") for i, t in rows}
    for i, w in docs.items():
        if i in train:
            c1.update(w)
            c2.update(zip(w, w[1:], strict=False))
            c3.update(zip(w, w[1:], w[2:], strict=False))
    n, v = sum(c1.values()), len(c1)
    p0 = lambda w: (c1[w] + 1) / (n + v + 1)
    p1 = lambda u, w: (c2[u, w] + (1 + c1[u] / 2) * p0(w)) / (c1[u] + 1 + c1[u] / 2)
    gain = Counter()
    for (u, w), c in c2.items():
        gain[u,] += c * math.log(((c - 1) / p0(w) + 1 + c1[u] / 2) / (1 + c1[u] / 2))
    for (t, u, w), c in c3.items():
        gain[t, u] += c * math.log(((c - 1) / p1(u, w) + 1 + c2[t, u] / 2) / (1 + c2[t, u] / 2))
    kept = {k for k, g in gain.items() for c in [c1[k[0]] if len(k) == 1 else c2[k]] if c >= 3 and g + c * math.log((1 + c / 2) / (c * 1.5)) > 6}
    assert any(len(k) == 1 for k in kept) and any(len(k) == 2 for k in kept)
    for i, w in docs.items():
        score, once = 0.0, [0, 0]
        for k, x in enumerate(w):
            if k > 1 and (w[k - 2], w[k - 1]) in kept:
                c = c2[w[k - 2], w[k - 1]]
                score += math.log10((c3[w[k - 2], w[k - 1], x] + (1 + c / 2) * p1(w[k - 1], x)) / (c + 1 + c / 2))
                once[1] += c3[w[k - 2], w[k - 1], x] == 1
            elif k and (w[k - 1],) in kept:
                score += math.log10(p1(w[k - 1], x))
                once[0] += c2[w[k - 1], x] == 1
            else:
                score += math.log10(p0(x))
        yield i, score, once


def test_scores_are_the_whole_trees(spark):
    docs = spark.createDataFrame(list(texts()), "doc_id long, text string")
    train = {r.doc_id for r in docs.filter(crc_mod("doc_id", suffix_lm.HELD_OUT[0]) != suffix_lm.HELD_OUT[1]).collect()}
    want = list(tree(list(texts()), train))
    for part in (True, False):
        assert sum(sum(once) for i, _, once in want if (i in train) == part) > 0
    got = {r.doc_id: r.score for r in suffix_lm.scored(docs.repartition(3)).collect()}
    assert got == {i: pytest.approx(s, rel=1e-9) for i, s, _ in want}


def test_packed_keys():
    import numpy as np

    r = np.random.default_rng(1)
    for n in (0, 1, 2, 5000):
        for wide in (True, False):
            keys = np.unique(r.integers(0, 1 << (63 if wide else 40), n).astype(np.uint64))
            assert (suffix_lm._unpack(memoryview(suffix_lm._pack(keys, wide)), wide) == keys).all()
            assert not n or len(suffix_lm._pack(keys, wide)) <= 9 + n * 8
