"""Whitening against numpy on the whole matrix, ill-conditioned and rank-deficient rows, exact sums, odd rows."""

from __future__ import annotations

from fractions import Fraction

import numpy as np

from vigilume.llm.whitening import _shifted, solved, whiten

SCHEMA = "vec_id long, embedding array<double>"


def frame(spark, points, extra=()):
    rows = [(k, [float(c) for c in p]) for k, p in enumerate(points)] + list(extra)
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def by_component(rows):
    white, axes = {}, {}
    for r in rows:
        white[r.vec_id, r.component] = r.whitened
        axes[r.component] = r.eigenvalue
    return white, axes


def brute(points, k=8):
    """Eigenvectors of the covariance of exactly centred whole numbers."""
    x = np.floor(1024 * np.asarray(points, float)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    away = x * n - sums
    centred = away / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(values)[::-1][:k]
    return away, centred, values[order], axes[:, order], values.sum()


def check(spark, points, k=8, tolerance=1e-9):
    rows = whiten(frame(spark, points)).collect()
    away, centred, values, axes, total = brute(points, k)
    k = min(k, len(values))
    assert len(rows) == len(points) * k
    white, found = by_component(rows)
    expected = centred @ axes / np.sqrt(values)
    for c in range(k):
        got = np.array([white[v, c + 1] for v in range(len(points))])
        sign = np.sign(got @ expected[:, c])
        assert np.abs(got * sign - expected[:, c]).max() < tolerance
        assert abs(found[c + 1] / values[c] - 1) < tolerance
    for r in rows:
        assert r.n == len(points) and r.deviation == int((away[r.vec_id].astype(object) ** 2).sum())
        assert abs(r.explained * total / values[r.component - 1] - 1) < tolerance and r.identity_error < 1e-9


def test_components_equal_numpy(spark):
    rng = np.random.default_rng(1)
    check(spark, rng.normal(size=(400, 12)) * np.linspace(3, 0.5, 12) @ np.linalg.qr(rng.normal(size=(12, 12)))[0])


def test_fewer_components_than_eight(spark):
    check(spark, np.random.default_rng(2).normal(size=(50, 3)) * [5, 2, 1])


def test_small_components_keep_their_digits(spark):
    """Standard deviations from 10^6 to 1: eigenvalues of the covariance differ by 10^12, and the small ones are still right."""
    rng = np.random.default_rng(3)
    scales = np.array([1e6, 1e4, 1e2, 1.0])
    points = rng.normal(size=(600, 4)) * scales
    rows = whiten(frame(spark, points)).collect()
    away = brute(points)[0]
    exact = np.linalg.svd(away / len(points))[1] ** 2 / len(points)
    found = by_component(rows)[1]
    assert all(abs(found[c + 1] / exact[c] - 1) < 1e-9 for c in range(4)) and rows[0].identity_error < 1e-9


def test_rows_that_leave_out_directions(spark):
    rng = np.random.default_rng(4)
    points = np.round(rng.normal(size=(100, 2)) * 100) @ np.array([[1, 2, 3, 0, 1], [0, 1, -1, 0, 2]])
    rows = whiten(frame(spark, points)).collect()
    found = by_component(rows)[1]
    assert found[1] > found[2] > 0 and found[3] == found[4] == found[5] == 0
    assert all(r.whitened == 0 and r.explained == 0 for r in rows if r.component > 2)
    white = np.array([[by_component(rows)[0][v, c] for c in (1, 2)] for v in range(100)])
    assert np.abs(white.T @ white / 100 - np.eye(2)).max() < 1e-9


def test_equal_rows_and_one_row(spark):
    for points in ([[1.5, -2.0]], [[1.5, -2.0]] * 7):
        rows = whiten(frame(spark, points)).collect()
        assert len(rows) == 2 * len(points) and all(r.whitened == 0 and r.deviation == 0 and r.explained == 0 and r.identity_error == 1 for r in rows)


def test_odd_rows_are_left_out(spark):
    rng = np.random.default_rng(5)
    points = rng.normal(size=(40, 3)) * [3, 2, 1]
    extra = [
        (100, None), (101, []), (102, [1.0, None, 2.0]), (103, [float("nan"), 0.0, 0.0]), (104, [0.0, float("-inf"), 0.0]), (105, [1.0, 2.0]), (106, [1e300, 0.0, 0.0]),
    ]
    rows = whiten(frame(spark, points, extra)).collect()
    assert {r.vec_id for r in rows} == set(range(40)) and {r.n for r in rows} == {40}
    assert whiten(frame(spark, [], extra[:2])).collect() == [] and whiten(frame(spark, [])).collect() == []


def test_repeated_rows_null_ids_and_other_columns(spark):
    rows = [(None, [1.0, 2.0], "x", 1), (None, [1.0, 2.0], "x", 1), (3, [4.0, 1.0], "y", 2), (3, [0.0, 7.0], "y", 2)]
    out = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string, n int")).collect()
    assert len(out) == 8 and sum(r.vec_id is None for r in out) == 4 and {r.n for r in out} == {4}


def test_sums_beyond_64_bits_are_exact(spark):
    points = [[4e15, 1.0], [-4e15, 2.0], [3e15, 5.0]]
    rows = whiten(frame(spark, points)).collect()
    x = [[int(1024 * Fraction(c)) + 100_000 for c in p] for p in points]
    assert all(r.deviation is None for r in rows) and {r.n for r in rows} == {3}
    exact = [sum((3 * x[v][j] - sum(row[j] for row in x)) ** 2 for j in range(2)) for v in range(3)]
    assert min(exact) >= 1 << 63


def test_triangular_solve_and_shift():
    rng = np.random.default_rng(6)
    r = np.triu(rng.normal(size=(6, 6))) + 4 * np.eye(6)
    rows = rng.normal(size=(20, 6))
    assert np.abs(solved(rows, (r, r)) - rows @ np.linalg.inv(r) @ np.linalg.inv(r)).max() < 1e-10
    singular = np.ones((3, 3))
    f = _shifted(singular, 1e-20, 3.0)
    assert np.abs(f.T @ f - singular).max() < 1e-9
