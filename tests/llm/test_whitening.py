"""Whitening against covariances in plain numpy and Python's integers."""

import math

import numpy as np
import pytest

from trendloom.llm import whitening as w

SHAPE = "vec_id long, embedding array<float>, label int"


def whole(v):
    return tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v)


def check(spark, rows, most=16):
    """The rows of whiten, by component, held against a covariance of the distinct vectors."""
    out = w.whiten(spark.createDataFrame(rows, SHAPE), most=most).collect()
    fit = np.array(sorted({whole(v) for _, v, _ in rows}))
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    e, vectors = np.linalg.eigh(centred.T @ centred / n)
    e, vectors = e[::-1], vectors[:, ::-1]
    by = {}
    for r in out:
        by.setdefault(r.component, []).append(r)
    x = {i: np.array(whole(v)) for i, v, _ in rows}
    assert {r.n for r in out} == {n} and len({r.identity_error for r in out}) == 1 and out[0].identity_error < 1e-9
    for k, own in by.items():
        assert sorted(r.vec_id for r in own) == sorted(i for i, _, _ in rows)
        want = np.array([(x[r.vec_id] - sums / n) @ vectors[:, k - 1] for r in own]) / np.sqrt(e[k - 1])
        got = np.array([r.whitened for r in own])
        assert np.allclose(got, want, rtol=0, atol=1e-7) or np.allclose(got, -want, rtol=0, atol=1e-7)
        for r in own:
            assert abs(r.explained / (e[k - 1] / e.sum()) - 1) < 1e-9
            assert r.deviation == sum((n * int(v) - int(s)) ** 2 for v, s in zip(x[r.vec_id], sums, strict=True))
    return by


def test_equals_plain_covariance(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 20)) @ (rng.normal(size=(20, 20)) * np.logspace(0, -1, 20))
    rows = [(i, [float(c) for c in x], 0) for i, x in enumerate(v)]
    rows += [(1000 + i, rows[i % 7][1], 1) for i in range(50)]  # copies count once in the fit
    assert sorted(check(spark, rows)) == list(range(1, 17))


def test_fewer_components_than_asked(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(40, 3))
    assert sorted(check(spark, [(i, x.tolist(), 0) for i, x in enumerate(v)])) == [1, 2, 3]
    # entries that repeat another's have no variance of their own
    flat = [(i, [*x.tolist(), *x.tolist()[:2], 1.0], 0) for i, x in enumerate(v)]
    assert sorted({r.component for r in w.whiten(spark.createDataFrame(flat, SHAPE)).collect()}) == [1, 2, 3]


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i % 5), float(i * i % 7), i / 3], 0) for i in range(20)]
    bad = [(100, None, 0), (101, [1.0, None, 2.0], 0), (102, [nan, 1.0, 2.0], 0), (103, [1.0, -inf, 2.0], 0), (104, [], 0), (105, [1.0, 2.0], 0), (106, [3e38, 1.0, 1.0], 0)]
    found = w.whiten(spark.createDataFrame(good + bad, SHAPE)).collect()
    assert {r.vec_id for r in found} == set(range(20)) and {r.component for r in found} == {1, 2, 3}
    again = [(None, good[0][1], 0), (None, good[0][1], 0)]
    found = w.whiten(spark.createDataFrame(good + again, SHAPE)).collect()
    assert sum(r.vec_id is None for r in found) == 6 and {r.n for r in found} == {20}


@pytest.mark.parametrize("rows", [[], [(1, None, 0)], [(1, [1.0, 2.0], 0)], [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)]])
def test_without_variance_there_are_no_rows(spark, rows):
    out = w.whiten(spark.createDataFrame(rows, SHAPE))
    assert out.collect() == [] and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


@pytest.mark.parametrize("shape", [(60, 8), (200, 33), (3, 6), (1, 4), (50, 1)])
def test_rotations_give_singular_values_and_vectors(shape):
    rng = np.random.default_rng(shape[0])
    a = rng.normal(size=shape) * np.logspace(0, -9, shape[1])
    sigma, v = w.jacobi(np.linalg.qr(a, mode="r"))
    want = np.linalg.svd(a, compute_uv=False)
    assert np.allclose(sigma[: len(want)], want, rtol=1e-9, atol=want[0] * 1e-15) and np.allclose(v.T @ v, np.eye(shape[1]), atol=1e-13)
    assert np.allclose(np.linalg.norm(a @ v, axis=0), sigma, rtol=1e-9, atol=want[0] * 1e-15)


def test_each_round_pairs_every_column_once():
    for d in (2, 6, 10):
        pairs = [tuple(x) for p, q in w._rounds(d) for x in zip(p.tolist(), q.tolist(), strict=True)]
        assert len(set(pairs)) == len(pairs) == d * (d - 1) // 2
        assert all(len({*p, *q}) == d for p, q in w._rounds(d))


def test_factors_stack_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(w, "FAN_IN", 3)
    rng = np.random.default_rng(5)
    x = rng.integers(0, 1000, (400, 6))
    df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<long>").repartition(11)
    r = w._factor(df, len(x), x.sum(axis=0))
    c = x - x.mean(axis=0)
    assert np.allclose(r.T @ r, c.T @ c)


def test_sums_beyond_64_bits_stay_exact():
    sums = np.array([10, -7])
    x = np.array([[1 << 61, 3], [5, -(1 << 61)]])
    got = w.centred(x, 1000, sums)
    assert [[int(v) for v in row] for row in got] == [[1000 * (1 << 61) - 10, 3007], [4990, -1000 * (1 << 61) + 7]]
    assert w._deviations(got).to_pylist() == [None, None]
    assert w._deviations(np.array([[3, 4], [1 << 31, 1 << 31]])).to_pylist() == [25, None]
