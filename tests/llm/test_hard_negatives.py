"""Operator 11 against brute force, its Hilbert keys and its bounds."""

import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from cohortlens.llm import common as C
from cohortlens.llm import hard_negatives as H

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("dims,bits", [(1, 4), (2, 3), (3, 2), (4, 2), (5, 2), (2, 1)])
def test_hilbert_curve_visits_neighbours(dims, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = H.hilbert_keys(grid, bits)
    assert len(set(keys)) == len(grid)
    walk = grid[sorted(range(len(keys)), key=keys.__getitem__)].astype(int)
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 10 ** 6))
def test_bounds_hold_and_are_reached(seed):
    r = np.random.default_rng(seed)
    x, a = r.integers(-9, 10, (6, 4)), r.integers(-9, 10, (3, 4))
    lo, hi = H.bounds(a, x.min(axis=0)[None], x.max(axis=0)[None], True)
    s = a @ x.T
    assert (lo[:, 0] <= s.min(axis=1)).all() and (hi[:, 0] >= s.max(axis=1)).all()
    one_lo, one_hi = H.bounds(a, x[:1], x[:1], True)
    assert (one_lo[:, 0] == s[:, 0]).all() and (one_hi[:, 0] == s[:, 0]).all()


def test_windows_are_exact():
    p = np.array([-7, -1, 0, 1, 2, 3, 99, 100, 101, 20157, 10 ** 15 + 7])
    lo, hi = H.window_of(p, 50, 95)
    for q, a, z in zip(p.tolist(), lo.tolist(), hi.tolist()):
        assert 100 * a >= 50 * q > 100 * (a - 1) and 100 * z <= 95 * q < 100 * (z + 1)


def brute(rows, positives=5, negatives=3):
    """Rows (id, label, vector) -> sorted result rows; ids divisible by 50 are anchors."""
    ok = [(i, g, [math.floor(256 * x) for x in v]) for i, g, v in rows
          if i is not None and g is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, g, a in ok:
        if i % 50:
            continue
        s = [(-sum(p * q for p, q in zip(a, x)), j, h) for j, h, x in ok if j != i]
        for p, pid, h in sorted(x for x in s if x[2] == g)[:positives]:
            inside = sorted(x for x in s if x[2] != g and 50 * -p <= 100 * -x[0] <= 95 * -p)[:negatives]
            out += [(i, pid, k, j, -p, -q) for k, (q, j, _) in enumerate(inside, 1)]
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    for c in ("id", "w", "grp", "no", "block", "key", "anchor", "all"):
        df = df.withColumn(c, F.lit("x"))
    out = H.hard_negatives(df, F.col("vec_id") % 50 == 0, F.col("label"))
    return sorted(tuple(r) for r in out.collect())


def smallest(spark):
    return [(r.vec_id, r.label, list(r.embedding)) for r in C.table(spark, SF, "embeddings").collect()]


@pytest.mark.parametrize("block,zones,cells", [(512, 256, 4), (7, 5, 1)])
def test_smallest_table(spark, monkeypatch, block, zones, cells):
    for name, value in (("BLOCK", block), ("ZONES", zones), ("BUNDLES_A_CELL", cells)):
        monkeypatch.setattr(H, name, value)
    rows = smallest(spark)
    assert run(spark, rows) == brute(rows)


def test_edge_cases(spark):
    rows = [(i, g, v[:8]) for i, g, v in smallest(spark)[:150]]
    v = rows[0][2]
    rows += [(None, 1, v), (1000, None, v), (1050, 1, None), (1100, 1, [1.0, None]), (1150, 2, [float("nan")] * 8),
             (1200, 2, [float("inf")] * 8), (1250, 1, []), (1300, 2, [0.0] * 8), (1350, 3, v[:3]), (1400, 99, v),
             (1450, 4, [x * 1000 for x in v]), (1451, 4, [-x for x in v])]
    rows += [(2000 + k, 5, v) for k in range(60)] + [(3000 + k, 6, v) for k in range(60)]
    assert run(spark, rows) == brute(rows)


def test_a_third_one_vector_of_one_label(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK", 16)
    rows = [(i, g, v[:6]) for i, g, v in smallest(spark)[:200]]
    rows += [(1000 + k, 7, rows[3][2]) for k in range(100)]
    assert run(spark, rows) == brute(rows)


def test_large_weights_are_read_in_full(spark):
    r = np.random.default_rng(1)
    rows = [(k, k % 3, [float(x) for x in r.integers(-10 ** 5, 10 ** 5, 4)]) for k in range(120)]
    assert run(spark, rows) == brute(rows)


def test_empty_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(50, 1, [1.0])]) == []
    assert run(spark, [(1, 1, [1.0]), (2, 2, [1.0])]) == []


@pytest.mark.parametrize("cell,most", [(2000, 1 << 25), (1 << 21, 3000)])
def test_many_cells_and_slices(spark, monkeypatch, cell, most):
    for name, value in (("BLOCK", 7), ("ZONES", 5), ("BLOCKS_A_GROUP", 1), ("CELL_BYTES", cell), ("MOST_BYTES", most)):
        monkeypatch.setattr(H, name, value)
    rows = smallest(spark)[:300]
    assert run(spark, rows) == brute(rows)


def test_nothing_of_the_tables_size_is_broadcast(spark):
    out = H.hard_negatives(C.table(spark, SF, "embeddings"), F.col("vec_id") % 50 == 0, F.col("label"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_grid_is_bounded():
    for row_bytes, anchor_bytes in ((0, 0), (10 ** 7, 10 ** 5), (10 ** 9, 10 ** 7), (10 ** 11, 10 ** 9), (10 ** 9, 10 ** 11)):
        cells, slices = H.grid(row_bytes, anchor_bytes)
        assert row_bytes / cells <= H.MOST_BYTES and anchor_bytes / slices <= H.MOST_BYTES
        assert cells * anchor_bytes <= 2 * row_bytes + anchor_bytes or cells == max(1, math.ceil(row_bytes / H.MOST_BYTES))
