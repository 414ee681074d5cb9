"""Operator 11: hard-negative mining over Hilbert-ordered blocks with zone maps.

A vector is a row of integer weights floor(scale * x); a row's score for an anchor is
their inner product.  An anchor's positives are its best ``positives`` other rows of
its label; the negatives of a positive with score p are the best rows of other labels
inside the window ``low`` * p <= 100 * score <= ``high`` * p.

1. Rows get a Hilbert key: their place on a Hilbert curve through a grid of
   ``2 ** BITS`` cells a dimension, between the table's smallest and largest weights.
2. Rows are range-partitioned and sorted by (label, key, id) and cut into blocks of at
   most ``BLOCK`` rows of one label, stored as Parquet: ids, weights, and the zone
   map, the smallest and largest weight of every dimension.  A label or a point of
   the curve that holds a third of all rows is many blocks.
3. The interval product of an anchor and a zone map bounds all scores of the block.
   Anchors first read the blocks of their own label whose upper bound reaches the
   fifth best score inside their own block; then the blocks of other labels whose
   bounds meet one of their windows.  The zone maps are read alone; what comes out is a
   row an (anchor group, block), with a bit an anchor.
4. Blocks are dealt into cells of bounded size, anchor groups into slices.  A task holds
   one cell and one slice and scores what chose each other; blocks travel once a slice,
   an anchor group once a cell that holds a block it chose.
5. What a cell gives an anchor is cut to the best few of each window before rows of
   one anchor meet.

Bounds, scores and windows are whole numbers, so nothing is lost to rounding.  Nothing
that grows with the table is broadcast or collected: joins name the sort-merge form, since
a stored table looks small to the planner (compressed, and before ``explode``).

Edge cases: rows with a null id or label, or a vector that is null or holds null or
non-finite components, take no part.  Vectors may differ in length (missing terms
weigh nothing).  A row with the anchor's id is not one of its others; rows repeated
under another id each count, ties going to the smaller id.  A window of a negative
score is empty.  Weights saturate at 2 ** 40; where inner products could pass 2 ** 52,
every block is read and scores are summed as longs.  Extra columns are not read; an
empty table gives an empty result.
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

BITS = 2
BLOCK = 512
BLOCKS_A_GROUP = 32       # anchors of so many neighbouring blocks make a group
ZONES = 256               # zone maps in a bundle
BUNDLES_A_CELL = 4
MOST_BYTES = 32 << 20     # blocks of a cell, anchors of a slice
CELL_BYTES = 2 << 20      # blocks of a cell while anchors, sent to every cell, weigh at most twice the blocks
_TOP = float(1 << 40)
_NONE = -np.iinfo(np.int64).max  # can be negated


def hilbert_keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """Place of every row of ``cells`` (unsigned, below ``2 ** bits``) on the Hilbert
    curve through its grid, as bytes that sort like the place.

    From the highest bit plane to the lowest, the curve in a sub-cube is the parent's
    with some axes mirrored and exchanged; undoing that from plane to plane and then
    Gray-decoding across the planes' bits gives the place."""
    x = cells.astype(np.uint32).T.copy()
    d = len(x)
    if not d:
        return [b""] * cells.shape[0]
    for plane in range(bits - 1, 0, -1):
        bit = np.uint32(1 << plane)
        below = np.uint32(bit - 1)
        for axis in range(d):
            mirrored = (x[axis] & bit) != 0
            swap = np.where(mirrored, 0, (x[0] ^ x[axis]) & below)
            x[0] ^= np.where(mirrored, below, swap)
            if axis:
                x[axis] ^= swap
    for axis in range(1, d):
        x[axis] ^= x[axis - 1]
    flip = np.zeros_like(x[0])
    for plane in range(bits - 1, 0, -1):
        bit = np.uint32(1 << plane)
        flip ^= np.where((x[d - 1] & bit) != 0, np.uint32(bit - 1), np.uint32(0))
    x ^= flip
    # interleave: the highest plane of every axis first
    planes = np.stack([(x >> np.uint32(p)) & np.uint32(1) for p in range(bits - 1, -1, -1)])
    return [r.tobytes() for r in np.packbits(planes.reshape(bits * d, -1).T.astype(np.uint8), axis=1)]


def _weights(column, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_list(pa.int64()))
    off = np.asarray(column.offsets)
    flat = column.values.to_numpy(zero_copy_only=False)[off[0]:off[-1]]
    lens = np.diff(off)
    if (lens == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(lens), dim), np.int64)
    out[np.arange(dim)[None, :] < lens[:, None]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray, small: bool) -> np.ndarray:
    """Exact inner products of the rows; ``small``: none passes 2 ** 52."""
    if small:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    with np.errstate(over="ignore"):
        return a @ b.T


def bounds(a: np.ndarray, lo: np.ndarray, hi: np.ndarray, small: bool):
    """(lower, upper) bounds of the scores of every anchor in every zone."""
    if not small:
        shape = (len(a), len(lo))
        return np.full(shape, _NONE), np.full(shape, -_NONE)
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    return products(up, lo, True) + products(down, hi, True), products(up, hi, True) + products(down, lo, True)


def window_of(p: np.ndarray, low: int, high: int):
    """Smallest and largest whole score s with low * p <= 100 * s <= high * p."""
    def floor(f, x):
        return f * (x // 100) + f * (x % 100) // 100
    return -floor(low, -p), floor(high, p)


def grid(row_bytes: int, anchor_bytes: int) -> tuple[int, int]:
    """(cells of blocks, slices of anchors).  Neither passes ``MOST_BYTES``; below that, more
    cells keep more tasks busy as long as the anchors sent to all of them stay about twice the blocks."""
    few = min(-(-row_bytes // CELL_BYTES), -(-2 * row_bytes // max(1, anchor_bytes)))
    return max(1, few, -(-row_bytes // MOST_BYTES)), max(1, -(-anchor_bytes // MOST_BYTES))


def best_of(ids, scores, ok, k):
    """(row, place) pairs of the best ``k`` places of every row of ``scores`` among
    those that are ``ok``, ties to smaller ids."""
    order = np.argsort(ids, kind="stable")
    s = np.where(ok, scores, _NONE)[:, order]
    if s.shape[1] > k:
        limit = -np.partition(-s, k - 1, axis=1)[:, k - 1:k]
        rows, at = np.nonzero((s >= limit) & ok[:, order])
    else:
        rows, at = np.nonzero(ok[:, order])
    by = np.lexsort((at, -s[rows, at], rows))
    rows, at = rows[by], at[by]
    first = np.searchsorted(rows, rows)
    cut = np.arange(len(rows)) - first < k
    return rows[cut], order[at[cut]]


def _ints(x, kind=np.int64):
    raw = x.as_buffer()
    return np.frombuffer(raw, kind) if raw is not None and len(raw) else np.zeros(0, kind)


def _binary(*arrays):
    return [pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in arrays]


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column, vec_id: str = "vec_id",
                   embedding: str = "embedding", positives: int = 5, negatives: int = 3, low: int = 50,
                   high: int = 95, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); ``is_anchor``
    and ``label`` are columns over ``vectors``.  See the module head."""
    spark = vectors.sparkSession
    ship_package(spark)
    v = F.col(f"`{embedding}`").cast("array<double>")
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    w = F.transform("v", lambda c: F.floor(F.greatest(F.least(c * F.lit(float(scale)), F.lit(_TOP)), F.lit(-_TOP))))
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), label.cast("string").alias("label"),
                          F.coalesce(is_anchor, F.lit(False)).alias("anchor"), v.alias("v")) \
        .filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~bad) \
        .select("id", "label", "anchor", w.cast("array<long>").alias("w"))
    reach = rows.agg(F.max(F.size("w")).alias("d"), F.max(F.array_max("w")).alias("hi"),
                     F.min(F.array_min("w")).alias("lo")).first()
    dim = int(reach["d"] or 0)
    least, most = int(reach["lo"] or 0), int(reach["hi"] or 0)
    widest = max(abs(least), abs(most), 1)
    small = widest * widest * max(1, dim) < 1 << 52
    kind = np.int32 if widest < 1 << 31 else np.int64

    # 1. the curve
    def curve(batches):
        step = max(1, most - least + 1) / (1 << BITS)
        for b in batches:
            x = _weights(b.column("w"), dim)
            cells = np.minimum((x - least) / step, (1 << BITS) - 1).astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("label"), b.column("anchor"),
                 pa.array([r.tobytes() for r in x.astype(kind)], pa.binary()),
                 pa.array(hilbert_keys(cells, BITS), pa.binary())], ["id", "label", "anchor", "w", "key"])
    keyed = rows.mapInArrow(curve, "id long, label string, anchor boolean, w binary, key binary")

    # 2. blocks of one label, with zone maps and the anchors that live in them
    def pack(batches):
        from pyspark import TaskContext
        base, seq, held = TaskContext.get().partitionId() << 32, 0, []

        def out():
            nonlocal seq
            seq += 1
            name = held[0][1]
            ids = np.array([r[0] for r in held], np.int64)
            x = np.frombuffer(b"".join(r[3] for r in held), kind).reshape(len(held), dim)
            own = np.flatnonzero([r[2] for r in held])
            seed = np.full(len(own), _NONE)
            if len(own) and len(held) > positives:
                s = np.where(ids[own][:, None] == ids[None, :], _NONE, products(x[own].astype(np.int64), x.astype(np.int64), small))
                seed = -np.partition(-s, positives - 1, axis=1)[:, positives - 1]
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([base + seq], pa.int64()), pa.array([name], pa.string()),
                 *_binary(x.min(axis=0), x.max(axis=0), ids, x, ids[own], x[own], seed)],
                ["block", "label", "lo", "hi", "ids", "w", "aids", "aw", "seeds"])
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("id", "label", "anchor", "w")]
            for r in zip(*cols):
                if held and (held[0][1] != r[1] or len(held) == BLOCK):
                    yield out()
                held.append(r)
        if held:
            yield out()
    blocks = C.store(keyed.repartitionByRange("label", "key", "id").sortWithinPartitions("label", "key", "id")
                     .mapInArrow(pack, "block long, label string, lo binary, hi binary, ids binary, w binary, "
                                       "aids binary, aw binary, seeds binary"), "op11-blocks")

    # anchors of neighbouring blocks, numbered from 0 within their group
    def gather(t: pa.Table) -> pa.Table:
        t = t.sort_by("block")
        labels = []
        for name, raw in zip(t.column("label").to_pylist(), t.column("aids").to_pylist()):
            labels += [name] * (len(raw) // 8)
        return pa.table([t.column("grp").slice(0, 1), pa.array([labels], pa.list_(pa.string())),
                         *[pa.array([b"".join(t.column(c).to_pylist())], pa.binary()) for c in ("aids", "aw", "seeds")]],
                        names=["grp", "labels", "aids", "aw", "seeds"])
    part, seq = F.expr("shiftright(block, 32)"), F.expr("block & 4294967295")
    group = (part * F.lit(1 << 32) + F.floor((seq - 1) / BLOCKS_A_GROUP)).cast("long")
    anchors = C.store(blocks.filter(F.octet_length("aids") > 0).select(group.alias("grp"), "block", "label", "aids", "aw", "seeds")
                      .groupBy("grp").applyInArrow(gather, "grp long, labels array<string>, aids binary, aw binary, seeds binary"),
                      "op11-anchors")

    # 3. zone maps alone, in bundles
    def bundle(batches):
        from pyspark import TaskContext
        base, seq, held = TaskContext.get().partitionId() << 32, 0, []

        def out():
            nonlocal seq
            seq += 1
            row = pa.RecordBatch.from_arrays(
                [pa.array([base + seq], pa.int64()), pa.array([[r[0] for r in held]], pa.list_(pa.int64())),
                 pa.array([[r[1] for r in held]], pa.list_(pa.string())),
                 pa.array([b"".join(r[2] for r in held)], pa.binary()), pa.array([b"".join(r[3] for r in held)], pa.binary())],
                ["bundle", "blocks", "zlabels", "lo", "hi"])
            held.clear()
            return row
        for b in batches:
            for r in zip(*[b.column(c).to_pylist() for c in ("block", "label", "lo", "hi")]):
                held.append(r)
                if len(held) == ZONES:
                    yield out()
        if held:
            yield out()
    zones = C.store(blocks.select("block", "label", "lo", "hi")
                    .mapInArrow(bundle, "bundle long, blocks array<long>, zlabels array<string>, lo binary, hi binary"), "op11-zones")
    # what there is: blocks, bytes of their rows, bytes of the anchors
    there = blocks.agg(F.count("block").alias("n"), F.sum(F.octet_length("ids")).alias("rows"), F.sum(F.octet_length("aids")).alias("own")).first()
    width = dim * np.dtype(kind).itemsize + 8
    row_bytes, anchor_bytes = (there["rows"] or 0) // 8 * width, (there["own"] or 0) // 8 * (width + 16 * positives)
    cells, slices = grid(row_bytes, anchor_bytes)
    zone_cells = max(1, -(-there["n"] // (ZONES * BUNDLES_A_CELL)))
    dealt = zones.withColumn("cell", F.pmod(F.xxhash64("bundle"), F.lit(zone_cells)).cast("int"))

    def chosen(table: DataFrame, choose, extra: str) -> DataFrame:
        """(block, grp, own): a bit for every anchor of the group, set where ``choose`` takes the block."""
        where = table.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(zone_cells - 1))))
        per_cell = dealt.groupBy("cell").agg(F.collect_list(F.struct("blocks", "zlabels", "lo", "hi")).alias("z"))

        def run(batches):
            for b in batches:
                for k in range(b.num_rows):
                    row = {c: b.column(c)[k] for c in b.schema.names}
                    mine = np.array(row["labels"].as_py(), object)
                    a, more = _ints(row["aw"], kind).reshape(len(mine), dim).astype(np.int64), _ints(row[extra])
                    for z in row["z"]:
                        names = np.array(z["blocks"].as_py(), np.int64)
                        lo, hi = (_ints(z[c], kind).reshape(len(names), dim).astype(np.int64) for c in ("lo", "hi"))
                        same = mine[:, None] == np.array(z["zlabels"].as_py(), object)[None, :]
                        take = choose(*bounds(a, lo, hi, small), same, more)
                        some = np.flatnonzero(take.any(axis=0))
                        own = [r.tobytes() for r in np.packbits(take[:, some], axis=0).T]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(names[some]), pa.array(np.full(len(some), row["grp"].as_py(), np.int64)), pa.array(own, pa.binary())],
                            ["block", "grp", "own"])
        return where.join(per_cell.hint("merge"), "cell").select("grp", "labels", "aw", extra, "z") \
            .mapInArrow(run, "block long, grp long, own binary")

    def scored(table: DataFrame, pairs: DataFrame, extra: str, best, keep: int) -> DataFrame:
        """(grp, no, nth, aid, id, score): of every anchor and list ``nth``, the best ``keep`` rows
        of each cell.  ``best``: (nth, row, place) arrays of the scores of a block."""
        cell = F.pmod(F.xxhash64("block"), F.lit(cells)).cast("int").alias("cell")
        sent = pairs.groupBy(cell, "grp").agg(F.collect_list(F.struct("block", "own")).alias("picks")) \
            .join(table.select("grp", "aids", "aw", extra).hint("merge"), "grp") \
            .withColumn("slice", F.pmod(F.xxhash64("grp"), F.lit(slices)).cast("int"))
        held = blocks.select("block", "ids", "w", cell, F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))

        def run(groups: pa.Table, held: pa.Table) -> pa.Table:
            place_of = {b: k for k, b in enumerate(held.column("block").to_pylist())}
            out = []
            for k in range(groups.num_rows):
                row = {c: groups.column(c)[k] for c in groups.schema.names}
                aids = _ints(row["aids"])
                a = _ints(row["aw"], kind).reshape(len(aids), dim).astype(np.int64)
                more, found = _ints(row[extra]).reshape(len(aids), -1), []
                for pick in row["picks"].as_py():
                    own = np.flatnonzero(np.unpackbits(np.frombuffer(pick["own"], np.uint8), count=len(aids)))
                    at = place_of[pick["block"]]
                    ids = _ints(held.column("ids")[at])
                    s = products(a[own], _ints(held.column("w")[at], kind).reshape(len(ids), dim).astype(np.int64), small)
                    found += [(own[r], np.full(len(r), nth), ids[place], s[r, place])
                              for nth, r, place in best(ids, s, aids[own][:, None] != ids[None, :], more[own])]
                if not found:
                    continue
                no, nth, ids, s = (np.concatenate(x) for x in zip(*found))
                by = np.lexsort((ids, -s, nth, no))
                key = (no * (positives + 1) + nth)[by]
                by = by[np.arange(len(by)) - np.searchsorted(key, key) < keep]
                out.append((np.full(len(by), row["grp"].as_py()), no[by], nth[by], aids[no[by]], ids[by], s[by]))
            merged = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0)] * 6
            kinds = (np.int64, np.int64, np.int32, np.int64, np.int64, np.int64)
            return pa.table([pa.array(x.astype(t)) for x, t in zip(merged, kinds)], names=["grp", "no", "nth", "aid", "id", "score"])
        return sent.groupBy("cell", "slice").cogroup(held.groupBy("cell", "slice")) \
            .applyInArrow(run, "grp long, no long, nth int, aid long, id long, score long")

    # positives: the best of each cell, then the best of all
    def positive(ids, s, other, seeds):
        yield 0, *best_of(ids, s, other, positives)
    reads = chosen(anchors, lambda lb, ub, same, seeds: same & (ub >= seeds[:, None]), "seeds")
    order = Window.partitionBy("grp", "no").orderBy(F.desc("positive_score"), "positive_id")
    pos = C.store(scored(anchors, reads, "seeds", positive, positives)
                  .select("grp", "no", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
                  .withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= positives), "op11-positives")

    # windows of an anchor: ``positives`` pairs of limits, empty ones where it has fewer
    def windows(t: pa.Table) -> pa.Table:
        n = t.column("aids")[0].as_buffer().size // 8
        lim = np.empty((n, positives, 2), np.int64)
        lim[:, :, 0], lim[:, :, 1] = 1, 0
        got = [np.array([r[c] for r in t.column("p")[0].as_py()], np.int64) for c in ("no", "nth", "positive_score")]
        lo, hi = window_of(got[2], low, high)
        lim[got[0], got[1] - 1, 0], lim[got[0], got[1] - 1, 1] = lo, hi
        return pa.table([t.column(c) for c in ("grp", "labels", "aids", "aw")] + _binary(lim),
                        names=["grp", "labels", "aids", "aw", "windows"])

    def with_windows(batches):
        for b in batches:
            for k in range(b.num_rows):
                yield from windows(pa.table(b.slice(k, 1))).to_batches()
    listed = pos.groupBy("grp").agg(F.collect_list(F.struct("no", "nth", "positive_score")).alias("p"))
    open_ = C.store(anchors.join(listed.hint("merge"), "grp").select("grp", "labels", "aids", "aw", "p")
                    .mapInArrow(with_windows, "grp long, labels array<string>, aids binary, aw binary, windows binary"),
                    "op11-windows")

    def meets(lb, ub, same, lim):
        lim = lim.reshape(len(lb), positives, 2)
        take = np.zeros(lb.shape, bool)
        for p in range(positives):
            lo, hi = lim[:, p, :1], lim[:, p, 1:]
            take |= (lo <= hi) & (ub >= lo) & (lb <= hi)
        return take & ~same

    def negative(ids, s, other, lim):
        lim = lim.reshape(len(s), positives, 2)
        for p in range(positives):
            yield p + 1, *best_of(ids, s, other & (s >= lim[:, p, :1]) & (s <= lim[:, p, 1:]), negatives)
    order = Window.partitionBy("grp", "no", "nth").orderBy(F.desc("negative_score"), "negative_id")
    neg = scored(open_, chosen(open_, meets, "windows"), "windows", negative, negatives) \
        .select("grp", "no", "nth", F.col("aid").alias("anchor_id"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score")) \
        .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return neg.join(pos.hint("merge"), ["grp", "no", "nth"]) \
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@query("op11_hard_negatives", """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS w
  FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL
    AND NOT coalesce(list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x))), false)
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.w, c.w) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) <= 3
""")
def op11(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(C.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)
