"""A Python worker serves one stage after the other: what it keeps for one is small, and goes with the next."""

import gc
import weakref

import numpy as np
import pyarrow as pa

from feedloom.llm import jaccard, shared, textops, token_files, toxicity


def test_slices_have_a_bound_that_only_one_document_passes():
    n = np.array([0, 700, 0, 400, 600, 5000, 0, 1, 999, 1000, 1001, 0])
    got = list(textops.pieces(n, 1000))
    assert [a for a, _ in got] == [0, *[b for _, b in got[:-1]]] and got[-1][1] == len(n)
    assert all(n[a:b].sum() <= 1000 or b == a + 1 for a, b in got)
    assert list(textops.pieces(n[:0])) == [] and list(textops.pieces(n[:1])) == [(0, 1)]


def test_tables_of_powers_stay_small():
    texts = pa.array([f"word{i % 97} of a text of some length. " * 60 for i in range(1500)], pa.large_string())
    shared.kept("nothing", dict)
    whole = jaccard.Sets(texts, 5)
    shared.kept("nothing", dict)
    parts = [jaccard.Sets(texts.slice(a, b - a), 5) for a, b in jaccard._parts(texts)]
    assert len(parts) > 1 and whole.sig == [x for p in parts for x in p.sig]
    toxicity.train(texts, np.arange(1500) % 2)
    assert max(len(t) for pair in shared.kept("powers", dict).values() for t in pair) <= 1 << 18


def test_an_encoder_goes_when_its_worker_has_other_work():
    import public_tokenizers

    path = public_tokenizers.path(token_files.NAME)
    e = token_files.encoder(path)
    first = e(["some words of a text"])
    assert token_files.encoder(path) is e and e.known
    gone = weakref.ref(e)
    del e
    textops.powers(0, 0, 1)
    gc.collect()
    assert gone() is None
    assert token_files.encoder(path)(["some words of a text"]) == first
