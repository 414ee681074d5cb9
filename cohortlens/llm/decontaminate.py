"""Operator 9: benchmark decontamination by winnowing.

Words are runs of 0-9, a-z and bytes from 0x80 in the lower-cased UTF-8 text.  A
window is ``width`` consecutive words of an item; a shorter item is one window.

**Winnowing.**  Documents keep the smallest hash of their ``k``-word grams in
every row of ``width - k + 1`` grams, so each shared span of ``width`` words holds
a kept gram.  Items give all their grams.  A document's kept gram that an item
has too (a join) is a hit, and the hit is extended: every window of ``width``
words around it is looked up among the items' windows (a join on a 64-bit hash
with a second one beside it).  Items of m < ``width`` words are one gram of m
words; for each such m that occurs, documents keep all their m-word grams (rows
of one gram), so the guarantee holds for them too.

**Filter.**  Grams that no item has are thrown away before the shuffle by a Bloom
filter of the items' grams.  It always has ``BLOOM_BITS`` bits (the proven bound
of what is broadcast): a larger benchmark makes it let more through, and the join
behind it is exact.  It is built on the executors and merged bit by bit.

Edge cases: null, empty and word-free texts have no words and no hits; an item
without words has no window; items with equal texts each count; documents may
repeat or share an id (a row is known by id and text hash); null ids are kept;
extra columns are not read; empty tables give empty results or no hits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.session import ship_package

from . import common as C
from .common import U
from .registry import query

K = 5
BLOOM_BITS = 1 << 23
_SEGMENT = 1 << 13  # bytes of the filter in one row of its table


def _words(body, off):
    low = C.LOWER[body]
    starts, ends, first = C.word_spans(low, off, C.ALNUM)
    return C.word_codes(low, starts, ends), first


def _second(codes):
    """Independent word codes, for the second hash of a window."""
    return C.mix(codes * U(0xD6E8FEB86659FD93) + U(0x2545F4914F6CDD1D))


def _slots(h):
    return (h >> U(10)) % U(BLOOM_BITS), (h >> U(34)) % U(BLOOM_BITS)


def _bloom(grams: DataFrame) -> np.ndarray:
    """The Bloom filter of the ``gram`` column: a bool array of BLOOM_BITS."""
    def part(batches):
        bits = np.zeros(BLOOM_BITS, bool)
        for b in batches:
            h = b.column(0).to_numpy(zero_copy_only=False).view(U)
            for s in _slots(h):
                bits[s.astype(np.int64)] = True
        packed = np.packbits(bits)
        rows = [(i, packed[i * _SEGMENT:(i + 1) * _SEGMENT]) for i in range(len(packed) // _SEGMENT)]
        rows = [(i, x) for i, x in rows if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()),
                                          pa.array([x.tobytes() for _, x in rows], pa.binary())], ["seg", "bits"])

    def merge(t: pa.Table) -> pa.Table:
        bits = np.zeros(_SEGMENT, np.uint8)
        for x in t.column("bits").to_pylist():
            bits |= np.frombuffer(x, np.uint8)
        return pa.table({"seg": t.column("seg").slice(0, 1), "bits": pa.array([bits.tobytes()], pa.binary())})
    out = np.zeros(BLOOM_BITS // 8, np.uint8)
    for r in grams.mapInArrow(part, "seg int, bits binary").groupBy("seg") \
            .applyInArrow(merge, "seg int, bits binary").collect():  # BLOOM_BITS / 8 bytes at most
        out[r["seg"] * _SEGMENT:(r["seg"] + 1) * _SEGMENT] = np.frombuffer(r["bits"], np.uint8)
    return np.unpackbits(out).astype(bool)


def winnow(hashes: np.ndarray, at: np.ndarray, first_word_of: np.ndarray, span: int) -> np.ndarray:
    """Indices of the grams that are the smallest (rightmost if tied) of some
    ``span`` consecutive grams of one document."""
    n = len(hashes) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low, where = hashes[:n].copy(), np.arange(n)
    for j in range(1, span):
        better = hashes[j:j + n] <= low
        low = np.where(better, hashes[j:j + n], low)
        where = np.where(better, np.arange(j, j + n), where)
    ok = (at[span - 1:] - at[:n] == span - 1) & (first_word_of[span - 1:] == first_word_of[:n])
    chosen = np.zeros(len(hashes), bool)
    chosen[where[ok]] = True
    return np.flatnonzero(chosen)


def _item_windows(items: DataFrame, item_id: str, text: str, width: int):
    """(stored) windows (h, g, n, item) of all items, and their grams (gram)."""
    slim = items.select(F.col(f"`{item_id}`").cast("string").alias("item"), F.col(f"`{text}`").alias("text"))

    def run(batches):
        for b in batches:
            for part, body, off in C.pieces(b, "text"):
                codes, first = _words(body, off)
                count = np.diff(first)
                hs, gs, ns, own, gram = [], [], [], [], []
                for k in range(len(count)):
                    c = codes[first[k]:first[k + 1]]
                    n = min(len(c), width)
                    if not n:
                        continue
                    one = np.array([0, len(c)])
                    h, _ = C.gram_codes(c, one, n)
                    g, _ = C.gram_codes(_second(c), one, n)
                    hs.append(h)
                    gs.append(g)
                    ns.append(np.full(len(h), n))
                    own.append(np.full(len(h), k))
                    # the window's grams: all k-word grams, or the short item itself
                    gram.append([C.gram_codes(c[j:j + n], np.array([0, n]), K)[0].view(np.int64).tolist()
                                 if n == width else h.view(np.int64).tolist() for j in range(len(h))])
                if hs:
                    own = np.concatenate(own)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("item").take(pa.array(own, pa.int64())),
                         pa.array(np.concatenate(hs).view(np.int64)), pa.array(np.concatenate(gs).view(np.int64)),
                         pa.array(np.concatenate(ns), pa.int32()),
                         pa.array([x for y in gram for x in y], pa.list_(pa.int64()))], ["item", "h", "g", "n", "grams"])
    return slim.mapInArrow(run, "item string, h long, g long, n int, grams array<long>")


def _document_grams(docs: DataFrame, doc_id: str, text: str, width: int, shorts: list[int], bloom) -> DataFrame:
    """One row per document: (doc_id, th, n_words, hits array<struct<gram, windows>>)
    with the kept grams that pass the filter and the windows around them."""
    slim = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"),
                       F.xxhash64(F.col(f"`{text}`")).alias("th"))
    span = width - K + 1
    win_t = pa.struct([("pos", pa.int32()), ("n", pa.int32()), ("h", pa.int64()), ("g", pa.int64())])
    hit_t = pa.struct([("gram", pa.int64()), ("windows", pa.list_(win_t))])

    def passes(h):
        a, b = _slots(h)
        return bloom.value[a.astype(np.int64)] & bloom.value[b.astype(np.int64)]

    def run(batches):
        for b in batches:
            for part, body, off in C.pieces(b, "text"):
                codes, first = _words(body, off)
                doc_of = np.repeat(np.arange(len(off) - 1), np.diff(first))
                hits = {}
                h, at = C.gram_codes(codes, first, K)
                kept = winnow(h, at, doc_of[at] if len(at) else at, span)
                kept = kept[passes(h[kept])]
                if len(kept):
                    wh, wat = C.gram_codes(codes, first, width)
                    wg, _ = C.gram_codes(_second(codes), first, width)
                    for i in kept.tolist():
                        p = int(at[i])
                        lo, hi = np.searchsorted(wat, [p - span + 1, p + 1])
                        d = int(doc_of[p])
                        own = [{"pos": int(wat[j] - first[d]), "n": width, "h": int(wh[j].view(np.int64)),
                                "g": int(wg[j].view(np.int64))} for j in range(lo, hi) if doc_of[wat[j]] == d]
                        if own:
                            hits.setdefault(d, []).append({"gram": int(h[i].view(np.int64)), "windows": own})
                for m in shorts:
                    h, at = C.gram_codes(codes, first, m)
                    kept = np.flatnonzero(passes(h))
                    if len(kept):
                        g, _ = C.gram_codes(_second(codes), first, m)
                        for i in kept.tolist():
                            d = int(doc_of[at[i]])
                            hits.setdefault(d, []).append({"gram": int(h[i].view(np.int64)), "windows": [
                                {"pos": int(at[i] - first[d]), "n": m, "h": int(h[i].view(np.int64)),
                                 "g": int(g[i].view(np.int64))}]})
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("th"), pa.array(np.diff(first), pa.int64()),
                     pa.array([hits.get(d, []) for d in range(part.num_rows)], pa.list_(hit_t))],
                    ["doc_id", "th", "n_words", "hits"])
    return slim.mapInArrow(run, "doc_id long, th long, n_words long, "
                                "hits array<struct<gram:long,windows:array<struct<pos:int,n:int,h:long,g:long>>>>")


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", width: int = 10) -> DataFrame:
    """(doc_id, th, n_words, n_hit, items array<string> sorted): one row per input
    row; ``th`` is Spark's xxhash64 of the text.  See the module head."""
    spark = docs.sparkSession
    ship_package(spark)
    windows = C.store(_item_windows(items, item_id, item_text, width), "op9-windows")
    grams = windows.select(F.explode("grams").alias("gram")).distinct()
    shorts = sorted(r["n"] for r in windows.filter(F.col("n") < width).select("n").distinct().collect())
    bloom = spark.sparkContext.broadcast(_bloom(grams))
    rows = C.store(_document_grams(docs, doc_id, text, width, shorts, bloom), "op9-rows")
    # equal rows (same id and text) share their hits
    hits = rows.filter(F.size("hits") > 0).select("doc_id", "th", F.explode("hits").alias("x")) \
        .select("doc_id", "th", "x.gram", "x.windows").join(grams, "gram", "left_semi")
    wide = hits.select("doc_id", "th", F.explode("windows").alias("w")).select("doc_id", "th", "w.pos", "w.n", "w.h", "w.g").distinct()
    known = windows.select("h", "g", "n").distinct()
    found = C.store(wide.join(known, ["h", "g", "n"], "left_semi"), "op9-found")
    # words inside any occurrence: merge the intervals of a document
    spans = found.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set(F.struct("pos", "n"))).alias("s"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("hit"))
    n_hit = F.aggregate("s", zero, lambda a, x: F.struct(
        F.greatest(a["end"], x["pos"] + x["n"]).alias("end"),
        (a["hit"] + F.greatest(F.lit(0), x["pos"] + x["n"] - F.greatest(a["end"], x["pos"]))).alias("hit")), lambda a: a["hit"])
    spans = spans.select("doc_id", "th", n_hit.alias("n_hit"))
    own = found.select("doc_id", "th", "h", "g", "n").distinct() \
        .join(windows.select("h", "g", "n", "item").distinct(), ["h", "g", "n"]) \
        .groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("item")).alias("items"))
    per = spans.join(own, (spans.doc_id.eqNullSafe(own.doc_id)) & (spans.th == own.th), "left") \
        .select(spans.doc_id.alias("d"), spans.th.alias("t"), "n_hit", "items")
    return rows.select("doc_id", "th", "n_words").join(
        per, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left") \
        .select("doc_id", "th", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                F.coalesce("items", F.array().cast("array<string>")).alias("items"))


@query("op9_winnowing_decontamination", """
WITH b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark
), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents
), k AS (
  SELECT DISTINCT item, n, array_to_string(ws[i:i + n - 1], ' ') AS k
  FROM (SELECT item, ws, n, unnest(range(1, len(ws) - n + 2)) AS i
        FROM (SELECT item, ws, least(len(ws), 10) AS n FROM b WHERE len(ws) > 0))
), p AS (
  SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS k
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM k))
), f AS (SELECT DISTINCT doc_id, p.n, i, item FROM p JOIN k ON k.k = p.k AND k.n = p.n),
h AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM (SELECT doc_id, i, unnest(range(0, n)) AS j FROM f) GROUP BY doc_id),
o AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, item FROM f) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN o ON o.doc_id = d.doc_id
""")
def op9(spark, sf_dir):
    out = decontaminate(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.encode(F.concat_ws(",", "items"), "UTF-8"), 256).alias("items_sha256"),
                      (F.col("n_hit") > 0).alias("contaminated"))
