"""Operator 12: embedding whitening by a bidiagonal qd solver.

Each vector entry c becomes the integer x = floor(scale * c) + offset.  The *fit
list* holds every distinct x vector once.  With n and the sums S of the fit list, a
row's exact integers n * x - S, divided by n, are its centred entries, so the offset
cancels before anything is rounded.

* Blockwise QR: every task folds its centred rows into one triangular factor R of
  the size of the dimension; factors meet in groups of ``FAN`` until one is left.
* The R of the whole fit list (dimension x dimension, however many rows) goes to
  ``bidiagonal``: Householder bidiagonalisation, dqds for the singular values,
  twisted factorisations for the directions.
* Every row is projected on the directions over the root of their eigenvalues; the
  covariance of the fit list's projections, summed by tasks, gives the
  ``identity_error`` against the identity.

Edge cases: rows whose vector is null, or holds null or non-finite entries, take no
part; a row without an id does.  The dimension is that of the longest vector; entries
that a shorter one lacks count as 0.  Entries beyond 2 ** 40 saturate there.  Repeated
vectors count once in the fit and each get their rows.  A component whose singular
value is below the rounding of the largest one (constant dimensions, fewer vectors
than dimensions) has no direction and no rows; so a table of one distinct vector, an
empty one or one of empty vectors gives an empty result.  ``deviation`` is exact; null
where it passes a long.  Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.session import ship_package

from . import common as C
from .bidiagonal import right_singular
from .registry import query

FAN = 16
BATCH = 4096
_TOP = float(1 << 40)


def integers(vectors: DataFrame, vec_id: str, embedding: str, scale: int, offset: int) -> DataFrame:
    """(id, x array<long>) of the rows that take part."""
    v = F.col(f"`{embedding}`").cast("array<double>")
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    x = F.transform("v", lambda c: F.floor(F.greatest(F.least(c * F.lit(float(scale)), F.lit(_TOP)), F.lit(-_TOP)))
                    .cast("long") + F.lit(offset).cast("long"))
    return vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), v.alias("v")) \
        .filter(F.col("v").isNotNull() & ~bad).select("id", x.alias("x"))


def _matrix(column, dim: int, fill: int) -> np.ndarray:
    """Rows of an Arrow column of integer lists as one array, short ones filled up."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_list(pa.int64()))
    off = np.asarray(column.offsets)
    flat = column.values.to_numpy(zero_copy_only=False)
    lens = np.diff(off)
    if (lens == dim).all():
        return flat[off[0]:off[-1]].reshape(-1, dim)
    out = np.full((len(lens), dim), fill, np.int64)
    inside = np.arange(dim)[None, :] < lens[:, None]
    out[inside] = flat[off[0]:off[-1]]
    return out


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, exactly: as longs where they fit, as Python integers elsewhere."""
    reach = int(np.abs(x).max(initial=0)) * n + int(max(map(abs, sums.tolist()), default=0))
    if reach < 1 << 62:
        return x * np.int64(n) - sums.astype(np.int64)
    return x.astype(object) * n - sums


def _deviations(y: np.ndarray):
    """Sums of squares of whole numbers by row; None beyond a long."""
    if y.dtype != object and float(np.abs(y).max(initial=0)) ** 2 * max(1, y.shape[1]) < 2.0 ** 62:
        return (y * y).sum(axis=1).tolist()
    return [s if s < 1 << 63 else None for s in (sum(int(c) ** 2 for c in row) for row in y)]


def _fold(r, y):
    return np.linalg.qr(np.vstack([r, y]), mode="r")


def triangular_factor(fit: DataFrame, centre) -> np.ndarray:
    """R of the centred rows of ``fit`` (R'R = Y'Y), folded in tasks and then in a tree."""
    def rows(batches):
        r = None
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                y = centre(b.column("x").slice(at, BATCH))
                r = _fold(np.zeros((0, y.shape[1])) if r is None else r, y)
        if r is not None:
            from pyspark import TaskContext
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())],
                ["part", "r"])

    def meet(t: pa.Table) -> pa.Table:
        r, key = None, t.column("key")[0]
        for raw in t.sort_by("part").column("r").to_pylist():
            one = np.frombuffer(raw, np.float64)
            one = one.reshape(-1, dim)
            r = one if r is None else _fold(r, one)
        return pa.table({"part": pa.array([key.as_py()], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})
    dim = centre.dim
    parts = C.store(fit.select("x").mapInArrow(rows, "part long, r binary"), "op12-factors")
    left = parts.agg(F.max("part")).first()[0]
    while left:
        parts = parts.withColumn("key", F.expr(f"part div {FAN}")).groupBy("key") \
            .applyInArrow(meet, "part long, r binary")
        left //= FAN
    got = parts.first()
    r = np.frombuffer(got["r"], np.float64).reshape(-1, dim)
    return np.vstack([r, np.zeros((max(0, dim - len(r)), dim))])[:dim]


class _Centre:
    """Centred doubles of an Arrow column of x vectors."""

    def __init__(self, dim, n, sums, fill):
        self.dim, self.n, self.sums, self.fill = dim, n, sums, fill

    def exact(self, column):
        return _centred(_matrix(column, self.dim, self.fill), self.n, self.sums)

    def __call__(self, column):
        return (self.exact(column) / self.n).astype(np.float64)


def whiten(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = 16,
           scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for every
    row that takes part and every component.  See the module head."""
    spark = vectors.sparkSession
    ship_package(spark)
    rows = integers(vectors, vec_id, embedding, scale, offset)
    fit = C.store(rows.groupBy("x").agg(F.lit(1).alias("once")).select("x"), "op12-fit")
    head = fit.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).first()
    n, dim = int(head["n"]), int(head["d"] or 0)
    shape = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not dim:
        return spark.createDataFrame([], shape)

    def totals(batches):
        s = np.zeros(dim, object)
        for b in batches:
            x = _matrix(b.column("x"), dim, offset)
            s += x.sum(axis=0, dtype=np.int64).astype(object)  # a batch's sum fits a long
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([str(v) for v in s])], ["at", "s"])
    # one row a dimension and task; exact sums of any size as decimals
    got = fit.mapInArrow(totals, "at int, s string").groupBy("at") \
        .agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("at").collect()
    sums = np.array([int(r["s"]) for r in got], object)
    centre = _Centre(dim, n, sums, offset)
    values, directions = right_singular(triangular_factor(fit, centre), components)
    m = directions.shape[1]
    eigen = values / n
    weights = directions / np.sqrt(eigen[:m])
    explained = (eigen[:m] / eigen.sum()).tolist() if m else []

    def squares(batches):
        total = np.zeros((m, m))
        for b in batches:
            w = centre(b.column("x")) @ weights
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(m * m), pa.int32()), pa.array(total.ravel(), pa.float64())],
                                         ["at", "s"])
    error = 0.0
    if m:
        got = fit.mapInArrow(squares, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")) \
            .orderBy("at").collect()
        error = float(np.abs(np.array([r["s"] for r in got]).reshape(m, m) / n - np.eye(m)).max())

    def project(batches):
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                one = b.slice(at, BATCH)
                y = centre.exact(one.column("x"))
                w = (y / n).astype(np.float64) @ weights
                k = len(w)
                again = np.repeat(np.arange(k), m)
                yield pa.RecordBatch.from_arrays(
                    [one.column("id").take(pa.array(again)), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), k)),
                     pa.array(np.full(k * m, n)), pa.array(_deviations(y), pa.int64()).take(pa.array(again)),
                     pa.array(w.ravel()), pa.array(np.tile(explained, k)), pa.array(np.full(k * m, error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return rows.mapInArrow(project, shape)


@query("op12_embedding_whitening")
def op12(spark, sf_dir):
    return whiten(C.table(spark, sf_dir, "embeddings"))
