"""Operator 4: substring dedup over words by recompression.

A window is ``width`` consecutive words of one document; each word covered by a
window whose word sequence also starts in a document with a smaller id goes.

**Rounds.**  Every document is a row of symbols, at first its words.  A round
names runs (a repeated k times becomes the symbol of (a, k)) and then pairs: a
bit of every symbol's name says whether it opens or closes a pair, and an opening
symbol followed by a closing one becomes the symbol of the pair.  A name is a
function of its parts alone, so all executors name equal runs and pairs alike
with no table to build, send or join, and equal substrings get the same interior
symbols wherever they stand.

**Windows.**  What may depend on a window's surroundings is popped from its ends
in each round: the outermost runs (they may go on outside), then a closing symbol
at the left end and an opening one at the right end.  The rest lies inside in
every occurrence.  A window's name joins its popped symbols, from the lowest
level up, to its highest symbol; the sequence determines the window and is
determined by it.  Rounds go on until no window has symbols left.

**Sharing.**  Documents are packed in id order into chunks; a chunk sends every
name once (64 bits and 16 check bits), the bucket's task answers whether a chunk
before has it, and inside a chunk the smallest id decides.

Edge cases: null and empty texts have no words; documents with under ``width``
words are kept whole; repeated rows with one id are not "smaller" than each other
and stay together in a chunk; a null id counts as smaller than every other;
extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .common import U
from .registry import query

_A, _B, _C, _D = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0xD6E8FEB86659FD93)


def _push(acc, value):
    x = acc * _A + value
    x ^= x >> U(31)
    x *= _B
    x ^= x >> U(29)
    return x


def window_names(codes: np.ndarray, first: np.ndarray, width: int):
    """Names of all windows by recompression: (start words, 64-bit names, 16-bit checks)."""
    n = len(codes)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.arange(max(0, n - width + 1))
    at = at[doc[at] == doc[at + width - 1]] if len(at) else at
    name64, check = np.empty(len(at), U), np.empty(len(at), np.uint16)
    # of the windows that still have symbols: their number, what was popped, [lo, hi)
    live, left, right = np.arange(len(at)), np.full(len(at), U(width)), np.full(len(at), U(width + 1))
    sym, lo, hi, level = codes, at, at + width, 0

    def rest(some, *arrays):
        """Windows without symbols left get their names; the others go on."""
        if some.all():
            return arrays
        end = ~some
        a, z = left[end], right[end]
        name64[live[end]] = C.mix(a * _A ^ C.mix(z))
        check[live[end]] = (C.mix(a * _C + z * _D) >> U(48)).astype(np.uint16)
        return tuple(x[some] for x in arrays)
    while len(live):
        level += 1
        salt = np.array([level], U)
        # runs: the outermost ones are popped with the part that lies in the window
        start = np.ones(len(sym), bool)
        start[1:] = (sym[1:] != sym[:-1]) | (doc[1:] != doc[:-1])
        begins = np.flatnonzero(start)
        run = np.cumsum(start) - 1
        size = np.diff(np.append(begins, len(sym)))
        base = sym[begins]
        a, z = run[lo], run[hi - 1]
        left = _push(left, base[a] + (np.minimum((begins + size)[a], hi) - lo).astype(U) * _C)
        more = z > a
        right = np.where(more, _push(right, base[z] + (hi - begins[z]).astype(U) * _D), right)
        live, left, right, lo, hi = rest(z > a + 1, live, left, right, a + 1, z)
        if not len(live):
            break
        many = np.flatnonzero(size > 1)
        name = base.copy()
        name[many] = C.mix(base[many] * _A + size[many].astype(U) * _C + salt)
        doc = doc[begins]
        # pairs: an opening symbol joins the closing one after it
        opens = (C.mix(name + C.mix(salt)) >> U(33)) & U(1) == 1
        pop = ~opens[lo]
        left = np.where(pop, _push(left, name[lo] ^ _C), left)
        lo = lo + pop
        live, left, right, lo, hi = rest(hi > lo, live, left, right, lo, hi)
        pop = opens[hi - 1]
        right = np.where(pop, _push(right, name[hi - 1] ^ _D), right)
        hi = hi - pop
        live, left, right, lo, hi = rest(hi > lo, live, left, right, lo, hi)
        pair = np.zeros(len(name), bool)
        pair[:-1] = opens[:-1] & ~opens[1:] & (doc[1:] == doc[:-1])
        joined = np.flatnonzero(pair)
        name[joined] = C.mix(name[joined] * _A + name[joined + 1] * _B + C.mix(salt))
        keep = np.ones(len(name), bool)
        keep[joined + 1] = False
        place = np.cumsum(keep) - 1
        lo, hi = place[lo], place[hi - 1] + 1
        sym, doc = name[keep], doc[keep]
    return at, name64, check


def _windows(off, body, width):
    starts, ends, first = C.word_spans(body, off)
    return first, window_names(C.word_codes(body, starts, ends), first, width)


def _ranks(ids) -> np.ndarray:
    """Dense rank of sorted ids: rows that share an id share a rank."""
    out = np.zeros(len(ids), np.int64)
    for k in range(1, len(ids)):
        out[k] = out[k - 1] + (ids[k] != ids[k - 1])
    return out


def _remove(chunks: DataFrame, width: int) -> DataFrame:
    def run(batches):
        for _, ids, off, body, row in C.chunk_rows(batches):
            first, (at, names, _) = _windows(off, body, width)
            n = int(first[-1])
            _, index, back = np.unique(names, return_index=True, return_inverse=True)
            rank = np.repeat(_ranks(ids), np.diff(first))[at]
            gone = rank > rank[index][back]
            said = C.reply_values(row)
            if len(said):
                gone |= said[back]
            cover = np.zeros(n + 1, np.int32)
            np.add.at(cover, at[gone], 1)
            np.add.at(cover, at[gone] + width, -1)
            keep = np.cumsum(cover[:n]) == 0
            raw, kept, removed = body.tobytes(), [], []
            for d in range(len(ids)):
                words = raw[off[d]:off[d + 1]].split()
                own = keep[first[d]:first[d + 1]]
                out = words if own.all() else list(compress(words, own.tolist()))
                removed.append(len(words) - len(out))
                kept.append(b" ".join(out))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(np.diff(first), pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])
    return chunks.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def recompression_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 13) -> DataFrame:
    """(doc_id, n_words, n_removed, kept string): one row per input row; ``kept``
    is the kept words joined by a space.  See the module head."""
    chunks = C.store(C.pack(docs, doc_id, text, by_id=True), "op4-chunks")
    nb = C.buckets(chunks, C.text_size())

    def before(order, new, keys, extra, sizes):
        order, new = C.checked(order, new, extra)  # stable: a group's first is of the earliest chunk
        out = np.zeros(len(order), bool)
        out[order] = ~new
        return out, 0, 0

    def namer(off, body, row):
        _, names, check = _windows(off, body, width)[1]
        keys, at = np.unique(names, return_index=True)
        return keys, check[at]
    replies = C.store(C.answer(C.post(chunks, namer, nb), before, np.uint16).withColumn("part", F.lit(0)), "op4-names")
    return _remove(C.with_answers(chunks, replies), width)


@query("op4_recompression_dedup", """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
p AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)
), m AS (SELECT k, min(doc_id) AS lo FROM p GROUP BY k),
h AS (
  SELECT DISTINCT doc_id, i + j AS i
  FROM (SELECT p.doc_id, p.i, unnest(range(0, 13)) AS j FROM p JOIN m USING (k) WHERE m.lo < p.doc_id)
), t AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
r AS (
  SELECT t.doc_id, count(h.i) AS n_removed, string_agg(t.word, ' ' ORDER BY t.i) FILTER (WHERE h.i IS NULL) AS kept
  FROM t LEFT JOIN h ON h.doc_id = t.doc_id AND h.i = t.i GROUP BY t.doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN r ON r.doc_id = w.doc_id
""")
def op4(spark, sf_dir):
    return recompression_dedup(C.table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))
