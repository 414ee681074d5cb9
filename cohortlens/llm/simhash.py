"""Operator 10: SimHash near-dedup with a pigeonring filter.

**Fingerprints.**  A bit is 1 if it is set in over half of the XXH64 hashes
(seed 42) of the document's word shingles, repeats included.  Bits are counted
in the byte lanes of 64-bit words, 255 shingles at a time.

**Pigeonring.**  The 64 bits are a ring of 16 segments of 4 bits.  If two
fingerprints differ in at most ``max_bits`` places, some segment begins a chain
in which the first l segments differ in at most floor(l * max_bits / 16) places,
for every l.  For 3 bits: 0 in the first 5 segments, at most 1 in the first 10,
2 in the first 15, 3 in all.  The first 5 segments and one of the two halves of
segments 6 to 10 (at most one place differs, so one half agrees) make the
bucket key: 32 keys of 28 or 32 bits for each distinct fingerprint.  Inside a
bucket the chain is checked at 10 and 15 segments before the full distance.

**Groups.**  Only distinct fingerprints are compared, so copies cost nothing.  A
bucket of more than ``BLOCK`` fingerprints is cut into blocks, and every pair of
blocks is a bucket of its own.  A bucket sends at most one edge for each of its
fingerprints (a local spanning forest), never all pairs.  Components come from
alternating stars over those edges.

Edge cases: null, empty and blank texts have the fingerprint zero and link like
any other; a text of fewer words than a shingle is one shingle; rows may repeat
or share an id; a null id never names a component unless all its ids are null;
extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.session import ship_package

from . import common as C
from .common import U
from .graph import components
from .registry import query

SEGMENTS = 16
BITS = 64 // SEGMENTS
BLOCK = 4096
_LANES = U(0x0101010101010101)


def budgets(max_bits: int) -> tuple[int, int]:
    """Longest chains with a budget of 0 and of 1 differing bits."""
    return tuple(max(n for n in range(1, SEGMENTS + 1) if n * max_bits // SEGMENTS <= b) for b in (0, 1))


# ---------------------------------------------------------------- fingerprints
def fingerprint_words(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints of documents whose shingle hashes stand in a row."""
    out = np.zeros(len(counts), U)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    n = counts[some]
    blocks = -(-n // 255)
    owner = np.repeat(np.arange(len(some)), blocks)
    first = np.cumsum(n) - n
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = first[owner] + 255 * nth
    ends = np.cumsum(blocks) - blocks
    half = n // 2
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> U(bit)) & _LANES, begin)
        per = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), ends, axis=0)
        for lane in range(8):
            out[some] |= (per[:, lane] > half).astype(U) << U(8 * lane + bit)
    return out


def _hashes(raw: bytes, width: int) -> list[int]:
    words = raw.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, 42)]
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s:e], 42) for s, e in zip(begins[:len(words) - width + 1].tolist(),
                                                     ends[width - 1:].tolist())]


def fingerprints(docs: DataFrame, doc_id: str, text: str, width: int, more: tuple = ()) -> DataFrame:
    """(doc_id, fp long, ``more``: long columns of ``docs``) of every row."""
    ship_package(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part, body, off in C.pieces(batch, "text"):
                raw = body.tobytes()
                per = [_hashes(raw[off[k]:off[k + 1]], width) for k in range(len(off) - 1)]
                counts = np.array([len(x) for x in per], np.int64)
                flat = np.array([h for x in per for h in x], U)
                fp = fingerprint_words(flat, counts).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp), *part.columns[2:]],
                                                 ["doc_id", "fp", *more])
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), *more) \
        .mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", "fp", *more)))


# ---------------------------------------------------------------- candidates
def ring_keys(fp, max_bits: int):
    """Bucket keys of a fingerprint column: array of (ring place and half, bits)."""
    none, one = budgets(max_bits)
    keys = []
    for i in range(SEGMENTS):
        r = fp if i == 0 else F.shiftleft(fp, BITS * i).bitwiseOR(F.shiftrightunsigned(fp, 64 - BITS * i))
        head = F.shiftrightunsigned(r, 64 - BITS * none)
        near = one - none
        if near < 2:
            keys.append(F.struct(F.lit(2 * i).alias("place"), head.alias("bits")))
            continue
        a = near - near // 2
        front = F.shiftrightunsigned(r, 64 - BITS * (none + a))
        back = F.shiftrightunsigned(r, 64 - BITS * one).bitwiseAND(F.lit((1 << BITS * (near - a)) - 1))
        keys.append(F.struct(F.lit(2 * i).alias("place"), front.alias("bits")))
        keys.append(F.struct(F.lit(2 * i + 1).alias("place"),
                             F.shiftleft(head, BITS * (near - a)).bitwiseOR(back).alias("bits")))
    return F.array(*keys)


def _near(a, b, place, max_bits):
    """Chain checks, then the full distance, of aligned fingerprints."""
    x = a ^ b
    turn = (place // 2 * BITS).astype(U)
    r = (x << turn) | np.where(turn > 0, x >> ((U(64) - turn) & U(63)), U(0))
    ok = np.ones(len(x), bool)
    for budget in range(1, max_bits):
        seen = max(n for n in range(1, SEGMENTS + 1) if n * max_bits // SEGMENTS <= budget)
        ok &= np.bitwise_count(r >> U(64 - BITS * seen)) <= budget
    return ok & (np.bitwise_count(x) <= max_bits)


def link_runs(place, bits, p, q, fp, max_bits):
    """Spanning edges (a, b) of the links inside runs of equal keys (sorted input)."""
    n = len(fp)
    if n < 2:
        return fp[:0], fp[:0]
    new = np.ones(n, bool)
    new[1:] = (place[1:] != place[:-1]) | (bits[1:] != bits[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])
    begins = np.flatnonzero(new)
    size = np.diff(np.append(begins, n))
    left = np.repeat(begins + size, size) - np.arange(n) - 1  # rows after this one in its run
    root = np.arange(n)

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i
    rows, d = np.flatnonzero(left >= 1), 1
    while len(rows):
        ok = rows[_near(fp[rows], fp[rows + d], place[rows], max_bits)]
        ok = ok[root[ok] != root[ok + d]]
        for i in ok.tolist():
            a, b = find(i), find(i + d)
            if a != b:
                root[max(a, b)] = min(a, b)
        while len(ok):
            up = root[root]
            if (up == root).all():
                break
            root = up
        d += 1
        rows = rows[left[rows] >= d]
    child = np.flatnonzero(root != np.arange(n))
    return fp[child], fp[root[child]]


def links(distinct: DataFrame, max_bits: int) -> DataFrame:
    """(a, b): spanning edges between distinct fingerprints (column ``fp``) whose
    transitive closure is that of all links within ``max_bits``."""
    spark = distinct.sparkSession
    ship_package(spark)
    keyed = distinct.select("fp", F.explode(ring_keys(F.col("fp"), max_bits)).alias("k")).select("fp", "k.place", "k.bits")
    hot = keyed.groupBy("place", "bits").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK) \
        .select("place", "bits", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    cut = keyed.join(hot, ["place", "bits"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))) \
        .withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .select("place", "bits", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "fp")
    dealt = cut.repartition("place", "bits", "p", "q").sortWithinPartitions("place", "bits", "p", "q")

    def run(batches):
        held = None
        for b in batches:
            cols = [b.column(j).to_numpy(zero_copy_only=False) for j in range(5)]
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
            # the last run may go on in the next batch
            last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1])
                                  | (cols[2] != cols[2][-1]) | (cols[3] != cols[3][-1]))
            at = int(last[-1]) + 1 if len(last) else 0
            held = [c[at:] for c in cols]
            if at:
                yield batch_of([c[:at] for c in cols])
        if held is not None:
            yield batch_of(held)

    def batch_of(cols):
        place, bits, p, q, fp = cols
        a, b = link_runs(place, bits, p, q, fp.view(U), max_bits)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _rooted(distinct: DataFrame, max_bits: int) -> DataFrame:
    """Distinct fingerprints (``fp`` and other columns) with the smallest
    fingerprint of their component as ``root``, stored."""
    edges = links(distinct.select("fp"), max_bits)
    roots = components(edges, "a", "b")
    return C.store(distinct.join(roots, distinct.fp == roots.node, "left")
                   .select(*distinct.columns, F.coalesce("root", "fp").alias("root")), "op10-tied")


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                       width: int = 3, max_bits: int = 3) -> DataFrame:
    """(doc_id, fp long, component_id): one row per input row; ``component_id`` is
    the smallest id that links reach.  See the module head."""
    rows = C.store(fingerprints(docs, doc_id, text, width), "op10-fp")
    tied = _rooted(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), max_bits)
    named = tied.groupBy("root").agg(F.min("low").alias("component_id"))
    of = tied.join(named, "root").select("fp", "component_id")
    return rows.join(of, "fp").select("doc_id", "fp", "component_id")


def simhash_representatives(docs: DataFrame, marks: tuple, doc_id: str = "doc_id", text: str = "text",
                            width: int = 3, max_bits: int = 3) -> DataFrame:
    """(doc_id, ``marks``): one row per component, that of its smallest id (null
    ids last), then of its smallest ``marks`` (long columns that tell rows apart)."""
    rows = C.store(fingerprints(docs, doc_id, text, width, marks), "op10-fp")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *marks)
    tied = _rooted(rows.groupBy("fp").agg(F.min(order).alias("best")), max_bits)
    return tied.groupBy("root").agg(F.min("best").alias("best")).select(*(f"best.{c}" for c in ("doc_id", *marks)))


@query("op10_simhash_near_dedup")
def op10(spark, sf_dir):
    out = simhash_components(C.table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
