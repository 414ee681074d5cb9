"""Operator 12: its solver against LAPACK, its rows against exact plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import common as C
from cohortlens.llm import whitening as W
from cohortlens.llm.bidiagonal import bidiagonalise, right_singular, squared_singular_values

SF = "/root/testdata/sf0.001"


def matrices():
    r = np.random.default_rng(0)
    y = r.normal(size=(300, 24))
    a, b = (np.linalg.qr(r.normal(size=(24, 24)))[0] for _ in range(2))
    gone = y.copy()
    gone[:, [3, 9]] = 0
    tri = lambda m: np.linalg.qr(m, mode="r")
    return {"random": tri(y), "graded": tri(y * 10.0 ** -np.arange(24)), "equal": tri(a), "constant": tri(gone),
            "clusters": tri(a @ np.diag(np.repeat([5, 3, 1, .1], 6)) @ b),
            "close": tri(a @ np.diag(1 + 1e-9 * np.arange(24)) @ b), "identity": np.eye(24), "one": np.array([[3.0]]),
            "rank": tri(r.normal(size=(100, 3)) @ r.normal(size=(3, 24))), "zero": np.zeros((8, 8)),
            "wilkinson": np.diag(np.abs(np.arange(-10.0, 11)) + 1) + np.diag(np.ones(20), 1)}


@pytest.mark.parametrize("name", matrices())
def test_solver(name):
    m = matrices()[name]
    d = len(m)
    s = np.linalg.svd(m)[1]
    values, v = right_singular(m, d)
    assert np.allclose(np.sqrt(values), s, rtol=0, atol=1e-13 * max(s[0], 1e-300))
    assert v.shape[1] == (s > s[0] * d * 2.3e-16).sum()
    assert np.abs(v.T @ v - np.eye(v.shape[1])).max(initial=0) < 1e-10
    if v.shape[1]:
        assert np.abs(v.T @ m.T @ m @ v - np.diag(values[:v.shape[1]])).max() < 1e-10 * values[0]


def test_small_singular_values_keep_their_digits():
    a, b = 10.0 ** -np.arange(20.0), 0.3 * 10.0 ** -np.arange(19.0)
    got = np.sqrt(squared_singular_values(a, b))
    # the product of the singular values is that of the diagonal; the smallest is 30 orders below the first
    assert math.isclose(np.log(got).sum(), np.log(a).sum(), rel_tol=1e-13)
    d, s, _ = bidiagonalise(np.diag(a) + np.diag(b, 1))
    assert np.allclose(np.sort(np.abs(d)), np.sort(np.abs(a)), rtol=1e-12)


def brute(rows, components=16):
    ok = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows
          if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in ok})
    n, d = len(fit), len(fit[0])
    s = [sum(x[k] for x in fit) for k in range(d)]
    y = np.array([[(n * x[k] - s[k]) / n for k in range(d)] for x in fit])
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1], v[:, ::-1]
    m = min(components, int((e > e[0] * 1e-12).sum()))
    out = {}
    for i, x in ok:
        dev = sum((n * x[k] - s[k]) ** 2 for k in range(d))
        w = np.array([(n * x[k] - s[k]) / n for k in range(d)]) @ v[:, :m] / np.sqrt(e[:m])
        out.setdefault(i, []).append((dev, w))
    return n, m, e[:m] / e.sum(), out


def check(df, rows, **how):
    n, m, share, want = brute(rows)
    got = {}
    sign = None
    for r in W.whiten(df, **how).collect():
        got.setdefault(r.vec_id, []).append(r)
        assert r.n == n and r.identity_error < 1e-4
        assert math.isclose(r.explained, share[r.component - 1], rel_tol=1e-4)
    assert got.keys() == want.keys()
    for i, found in got.items():
        assert len(found) == m * len(want[i])
        assert sorted(r.deviation for r in found) == sorted(x for x, _ in want[i] for _ in range(m))
        if len(want[i]) == 1:
            w = np.array([r.whitened for r in sorted(found, key=lambda r: r.component)])
            big = np.abs(want[i][0][1]) > 1e-6
            now = np.sign(w) * np.sign(want[i][0][1])
            sign = now if sign is None else np.where(big, sign, now)
            assert np.allclose(np.abs(w), np.abs(want[i][0][1]), atol=1e-6)
            assert (now == sign)[big].all()


def table(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for c in ("x", "id", "n", "v", "label"):
        df = df.withColumn(c, F.lit("y"))
    return df


def vectors(spark):
    return [(r[0], list(r[1])) for r in C.table(spark, SF, "embeddings").select("vec_id", "embedding").collect()]


def test_smallest_table(spark):
    rows = vectors(spark)
    check(C.table(spark, SF, "embeddings"), rows)


def test_edge_cases(spark):
    rows = [(i, v[:6]) for i, v in vectors(spark)[:120]]
    rows += [(1000, None), (1001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1002, [float("nan")] + [0.0] * 5),
             (1003, [float("inf")] + [0.0] * 5), (7, rows[7][1]), (1004, rows[8][1]), (None, rows[9][1])]
    rows += [(2000 + k, rows[10][1]) for k in range(100)]
    check(table(spark, rows), rows)


def test_constant_dimension_and_few_rows(spark):
    rows = [(k, [float(k), 2.0, float(k * k), 0.5]) for k in range(5)]
    check(table(spark, rows), rows)
    assert W.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0


def test_empty_tables(spark):
    for rows in ([], [(1, None)], [(1, [])]):
        out = W.whiten(table(spark, rows))
        assert out.count() == 0
        assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_exact_past_a_long():
    x = np.array([[1 << 40, 0]])
    y = W._centred(x, 1 << 30, np.array([5, 7], object))
    assert y[0, 0] == (1 << 70) - 5 and W._deviations(y) == [None]
    assert W._deviations(np.array([[3, -4]])) == [25]
