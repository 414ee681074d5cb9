"""Operator 5: exact top-k inner products by exhaustive term-at-a-time accumulation.

A vector is a sparse row of integer weights floor(scale * x), one term for each
component.  Candidates are packed into blocks of at most ``BLOCK`` rows with an
inverted index (term -> rows and weights).  A query walks its non-zero terms and
scatters weight times posting into one dense array of the block's scores; then a
partition selection keeps its best k with all ties, and Spark merges the blocks'
lists.  Every (query block, candidate block) pair is one join row, dealt by
(query block, group of candidate blocks), so work spreads over all tasks and no
side is broadcast.

Edge cases: vectors that are null, or hold null or non-finite components, take no
part; neither do rows without an id.  An empty vector scores 0.  Vectors may
differ in length (missing terms weigh nothing).  A query's own row is known by
its id, so rows that share its id are no candidates of it, and each row of a
repeated candidate counts.  Weights beyond a long saturate; scores wrap like
long arithmetic.  Extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlens.session import ship_package

from . import common as C
from .registry import query

BLOCK = 4096
QUERY_BLOCK = 1024
GROUP = 4
_TOP = float(2 ** 63 - 1024)


def _weights(arr, scale: int):
    """(kept rows, offsets, weights) of an Arrow column of number lists."""
    arr = arr.cast(pa.large_list(pa.float64()))
    rows, parts = [], []
    off = np.asarray(arr.offsets)
    flat = arr.values.to_numpy(zero_copy_only=False)
    absent = np.asarray(arr.values.is_null()) if arr.values.null_count else None
    gone = np.asarray(arr.is_null())
    for k in range(len(arr)):
        x = flat[off[k]:off[k + 1]]
        if gone[k] or not np.isfinite(x).all() or (absent is not None and absent[off[k]:off[k + 1]].any()):
            continue
        rows.append(k)
        with np.errstate(over="ignore"):
            parts.append(np.clip(np.nan_to_num(np.floor(x * scale)), -_TOP, _TOP).astype(np.int64))
    lens = np.array([len(p) for p in parts], np.int64)
    return rows, lens, np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _block(ids, lens, flat):
    return [pa.array([ids.tobytes()], pa.binary()), pa.array([lens.tobytes()], pa.binary()),
            pa.array([flat.tobytes()], pa.binary())]


def _index(lens, flat):
    """Inverted index of a block: term -> (rows, weights), zeros left out."""
    term = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
    row = np.repeat(np.arange(len(lens)), lens)
    some = np.flatnonzero(flat)
    some = some[np.lexsort((row[some], term[some]))]
    t = term[some]
    at = np.flatnonzero(np.append(True, t[1:] != t[:-1])) if len(t) else np.zeros(0, np.int64)
    ends = np.append(at[1:], len(t))
    return {int(t[a]): (row[some[a:z]], flat[some[a:z]]) for a, z in zip(at, ends)}


def best(ids, index, query_id, terms, weights, k):
    """(ids, scores) of the best ``k`` of a block for one query, ties to smaller ids."""
    score = np.zeros(len(ids), np.int64)
    for t, w in zip(terms, weights):
        got = index.get(t)
        if got is not None:
            rows, post = got
            if len(rows) == len(ids):
                score += w * post
            else:
                score[rows] += w * post
    other = np.flatnonzero(ids != query_id)
    s = score[other]
    if len(s) > k:
        other = other[s >= np.partition(s, len(s) - k)[len(s) - k]]
    order = np.lexsort((ids[other], -score[other]))[:k]
    return ids[other[order]], score[other[order]]


def top_k(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", embedding: str = "embedding",
          k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the best ``k`` candidates of every row
    that ``is_query`` (a column over ``vectors``) holds for."""
    spark = vectors.sparkSession
    ship_package(spark)
    slim = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{embedding}`").alias("v"),
                          F.coalesce(is_query, F.lit(False)).alias("q")).filter("id is not null and v is not null")

    def rows_of(batch):
        rows, lens, flat = _weights(batch.column("v"), scale)
        return np.asarray(batch.column("id").take(pa.array(rows, pa.int64())), np.int64), lens, flat

    def candidates(batches):
        from pyspark import TaskContext
        seq, base = 0, TaskContext.get().partitionId() << 32
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                seq += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([base + seq], pa.int64()), *_block(*rows_of(b.slice(at, BLOCK)))],
                    ["block", "ids", "lens", "flat"])

    def queries(t: pa.Table) -> pa.Table:
        b = t.combine_chunks().to_batches()[0]
        return pa.table([b.column("qb").slice(0, 1), *_block(*rows_of(b))], names=["qb", "qids", "qlens", "qflat"])
    blocks = C.store(slim.select("id", "v").mapInArrow(candidates, "block long, ids binary, lens binary, flat binary"),
                     "op5-blocks")
    nq = max(1, -(-slim.filter("q").count() // QUERY_BLOCK))
    groups = max(1, -(-blocks.count() // GROUP))
    qs = slim.filter("q").select(F.pmod(F.xxhash64("id"), F.lit(nq)).cast("int").alias("qb"), "id", "v") \
        .groupBy("qb").applyInArrow(queries, "qb int, qids binary, qlens binary, qflat binary")
    qs = C.store(qs, "op5-queries").withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    cs = blocks.withColumn("grp", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")) \
        .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))

    def score(batches):
        def ints(x):
            return np.frombuffer(x.as_buffer(), np.int64) if len(x.as_buffer()) else np.zeros(0, np.int64)
        for b in batches:
            for j in range(b.num_rows):
                ids, lens, flat, qids, qlens, qflat = (ints(b.column(c)[j]) for c in range(6))
                index = _index(lens, flat)
                at = np.append(0, np.cumsum(qlens))
                out = [[], [], []]
                for i, q in enumerate(qids.tolist()):
                    w = qflat[at[i]:at[i + 1]]
                    terms = np.flatnonzero(w)
                    got, s = best(ids, index, q, terms.tolist(), w[terms], k)
                    out[0].append(np.full(len(got), q))
                    out[1].append(got)
                    out[2].append(s)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in out],
                                                     ["query_id", "vec_id", "score"])
    lists = cs.join(qs, ["qb", "grp"]).select("ids", "lens", "flat", "qids", "qlens", "qflat") \
        .mapInArrow(score, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return lists.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@query("op5_exact_topk", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, x -> floor(256 * CAST(x AS DOUBLE))) AS w
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND NOT list_bool_or(list_transform(embedding, x -> x IS NULL OR NOT isfinite(x)))
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
         vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""")
def op5(spark, sf_dir):
    return top_k(C.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
