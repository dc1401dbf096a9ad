"""TSQR whitening against an eigendecomposition of the covariance, and its defined cases."""

import math

import numpy as np
import pytest

from feedloom.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, n long, component int, node string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], SCHEMA).repartition(5)


def brute(vectors):
    x = np.floor(64 * np.array(vectors)) + 1_000_000
    values, basis = np.linalg.eigh(np.cov(x.T, bias=True))
    return x, values[::-1], basis[:, ::-1]


def test_components_sums_and_error_match_an_eigendecomposition(spark):
    r = np.random.default_rng(5)
    v = r.normal(size=(700, 12)) @ r.normal(size=(12, 12))
    rows, model, error = whitening.whitened(frame(spark, [(i, x.tolist()) for i, x in enumerate(v)]), 7)
    got = {r.vec_id: r for r in rows.collect()}
    x, values, basis = brute(v)
    want = (x - x.mean(0)) @ basis[:, :7] / np.sqrt(values[:7])
    mine = np.array([got[i].whitened for i in range(700)])
    assert np.allclose(np.abs(mine), np.abs(want), atol=1e-8) and error < 1e-9
    assert np.allclose(model.values, values[:7]) and math.isclose(model.trace, values.sum(), rel_tol=1e-9)
    sums = [int(s) for s in x.sum(0)]
    assert all(got[i].deviation == sum((700 * int(a) - s) ** 2 for a, s in zip(x[i], sums, strict=True)) for i in range(700))
    assert np.abs(np.cov(mine.T, bias=True) - np.eye(7)).max() == pytest.approx(error, abs=1e-12)


def test_unusable_rows_go_and_ids_stay_as_they_are(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [0.0, 0.0]), (2, [0.5, -3.0]), (3, [2.0, 1.0])]
    bad = [(4, None), (5, [None, 1.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0]), (9, [])]
    rows, model, _ = whitening.whitened(frame(spark, good + bad))
    got = rows.collect()
    assert sorted((r.vec_id or 0) for r in got) == [0, 1, 1, 2, 3] and model.n == 5 and len(got[0].whitened) == 2
    assert len({tuple(r.whitened) for r in got if r.vec_id == 1}) == 1


def test_constant_flat_and_empty_inputs(spark):
    rows, model, error = whitening.whitened(frame(spark, [(i, [1.0, 2.0, 3.0]) for i in range(6)]))
    assert [r.whitened for r in rows.collect()] == [[]] * 6 and len(model.values) == 0 and error == 0.0
    rows, model, error = whitening.whitened(frame(spark, [(i, [float(i), 2.0 * i, 3.0]) for i in range(9)]))
    assert len(model.values) == 1 and error < 1e-9 and rows.count() == 9
    rows, model, error = whitening.whitened(frame(spark, []))
    assert rows.count() == 0 and model is None
    rows, model, _ = whitening.whitened(frame(spark, [(1, [5.0, 1.0])]))
    assert rows.first().deviation == 0 and model.n == 1


def test_large_entries_stay_exact_and_what_64_bits_do_not_hold_is_null(spark):
    far = [(1, [2.0**40, 0.0]), (2, [-(2.0**40), 1.0]), (3, [1e300, 2.0]), (4, [0.0, 3.0])]
    rows, model, _ = whitening.whitened(frame(spark, far))
    x = [[min(math.floor(64 * a) + 1_000_000, 1 << 61) for a in v] for _, v in far]
    assert model.sums == [sum(c) for c in zip(*x, strict=True)]
    assert all(r.deviation is None for r in rows.collect())
    rows, model, _ = whitening.whitened(frame(spark, far[:2]))
    want = [sum((2 * a - s) ** 2 for a, s in zip(v, model.sums, strict=True)) for v in ([math.floor(64 * a) + 1_000_000 for a in w] for _, w in far[:2])]
    assert [r.deviation for r in rows.collect()] == [w if w < 1 << 63 else None for w in want]


def test_factors_merge_over_several_levels(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    r = np.random.default_rng(6)
    v = r.normal(size=(300, 4))
    df = spark.createDataFrame([(i, x.tolist(), 1, 2, "x") for i, x in enumerate(v)], SCHEMA).repartition(11)
    _, model, error = whitening.whitened(df)
    assert np.allclose(model.values, brute(v)[1]) and error < 1e-9
