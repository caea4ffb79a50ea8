import math

import numpy as np

from artiscope.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>, n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 7) for i, v in rows], SCHEMA)


def brute(rows, components):
    """The contract on one machine, in exact integers up to the covariance."""
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in good], dtype=object)
    n, s = len(good), x.sum(axis=0)
    apart = x * n - s
    cov = np.array(apart.T.dot(apart), dtype=float) / n**3
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:components], v[:, ::-1][:, :components]
    return [i for i, _ in good], n, (apart**2).sum(axis=1), e / np.trace(cov), np.array(apart, dtype=float) / n @ v / np.sqrt(e)


def gathered(got):
    """Rows of a result by id (ids differ) and component."""
    return {(r.vec_id, r.component): r for r in got}


def check(got, rows, components, tolerance=1e-6):
    ids, n, deviation, explained, whitened = brute(rows, components)
    by = gathered(got)
    assert len(by) == len(got) == len(ids) * components
    w = np.array([[by[i, k].whitened for k in range(1, components + 1)] for i in ids])
    signs = np.sign((w * whitened).sum(axis=0))
    assert np.abs(w * signs - whitened).max() < tolerance
    assert all(by[i, k].deviation == int(d) and by[i, k].n == n for i, d in zip(ids, deviation) for k in range(1, components + 1))
    assert np.allclose([by[ids[0], k].explained for k in range(1, components + 1)], explained, rtol=1e-6)
    assert np.abs(w.T @ w / n - np.eye(components)).max() < 1e-9 and got[0].identity_error < 1e-9


def test_query_equals_brute_force(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    check(wh.op13_whitening(spark, sf_dir).collect(), rows, 32)


def test_odd_rows_are_dropped(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(40)]
    odd = [(100, None), (101, [1.0, None, 1.0, 1.0, 1.0]), (102, [math.nan] * 5), (103, [math.inf, 0.0, 0.0, 0.0, 0.0]), (104, []), (105, [None] * 5)]
    check(wh.whiten(frame(spark, rows + odd)).collect(), rows, 5)
    # another length than the commonest
    check(wh.whiten(frame(spark, [*rows, (200, [1.0, 2.0])])).collect(), rows, 5)
    assert {r.n for r in wh.whiten(frame(spark, rows[:2] + [(None, [1.0] * 5), rows[0]])).collect()} == {4}


def test_nearly_dependent_dimensions(spark):
    """Deviations five orders apart, and a copy that differs in one row: eigenvalues of the covariance alone would be noise."""
    rng = np.random.default_rng(2)
    a = rng.normal(size=(400, 4)) * [3000, 1, 0.05, 0.05]
    rows = np.column_stack([a, a[:, 0]])
    rows[7, 4] += 0.125
    got = wh.whiten(frame(spark, [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(rows.tolist())])).collect()
    by = gathered(got)
    w = np.array([[by[i, k].whitened for k in range(1, 6)] for i in range(400)])
    assert np.abs(w.T @ w / 400 - np.eye(5)).max() < 1e-4 and got[0].identity_error < 1e-4


def test_directions_without_any_deviation(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [1.0, *v, v[0] + 1, 0.0]) for i, v in enumerate((rng.integers(0, 9, (60, 3)) / 4).tolist())]
    got = wh.whiten(frame(spark, rows)).collect()
    assert {r.component for r in got} == {1, 2, 3} and got[0].identity_error < 1e-9
    assert abs(sum(r.explained for r in got if r.vec_id == 0) - 1) < 1e-9
    assert wh.whiten(frame(spark, [(i, [0.5, 2.0]) for i in range(9)])).count() == 0
    assert wh.whiten(frame(spark, [(1, [0.5, 2.0])])).count() == 0
    assert wh.whiten(frame(spark, [])).count() == 0
    assert wh.whiten(frame(spark, [(1, None)])).count() == 0


def test_deviations_are_exact_or_null():
    q, r = np.array([3, -4]), np.array([1, 2])
    small, large, huge = wh.Center(10, q, r), wh.Center(10**6, q, r), wh.Center(10**9, q, r)
    x = np.array([[3, -4], [1000, 5], [-7, 12]])
    for mid in (small, large, huge):
        exact = [sum((mid.n * int(v - a) - int(b)) ** 2 for v, a, b in zip(row, q, r)) for row in x]
        assert mid.deviation(x) == [s if s < 1 << 63 else None for s in exact]
    assert huge.deviation(x)[1] is None
