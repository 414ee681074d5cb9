"""Shared pieces of the operators: text buffers, word hashing, chunk tables and
the name exchange.

**Chunks.** ``pack`` turns documents into rows of about ``CHUNK_BYTES`` of text
(whole documents, so a longer document makes a longer chunk) and writes them
under the shared folder.  A chunk has a stored id, so a task that is repeated on
another executor, and a second pass over the table, see the same chunk.

**Names.** An operator gives every chunk a sorted set of 64-bit names (hashes of
windows or words) with aligned check values.  ``post`` cuts that set into
buckets of the name space and sends one row per (chunk, bucket); repeats inside
a chunk are merged first, so a passage that a third of all documents share costs
one name per chunk, not one per document.  ``answer`` resolves a bucket in one
task (bounded by data / buckets) and sends back one value per name in the same
order, so neither texts nor document ids travel.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.session import scratch_dir, ship_package

CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 2 << 20
CHUNK_SCHEMA = "chunk long, doc_ids array<long>, ends array<long>, body binary"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
WORD = "[^\\x20\\x09-\\x0D]+"

U = np.uint64


# ---------------------------------------------------------------- Spark side
@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting for the length of one job, put back afterwards."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet under the shared folder and read it back
    (cuts lineage; a lost executor re-reads files).  The shuffle files of the
    job go as soon as it has ended.  The folder's path is kept on the result."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    with setting(spark, CLEANUP, "true"):
        df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a stored intermediate that no returned DataFrame reads."""
    path = getattr(df, "stored_at", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """At most ``n`` rows of ``df`` (one a key) with the smallest seeded hashes.
    Rows are first cut at a hash limit that leaves about 2 n of them, so what
    meets in one task for the final limit does not grow with the table."""
    share = min(1.0, 2.0 * n / max(1, df.count()))
    h = F.xxhash64(F.lit(seed), key)
    limit = int(-(1 << 63) + share * ((1 << 64) - 1))
    return df.filter(h <= F.lit(min(limit, (1 << 63) - 1))).orderBy(h, key).limit(n)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def buckets(chunks: DataFrame, size) -> int:
    """Name buckets of a stored chunk table: one for every ``BUCKET_BYTES`` of
    ``size`` (a column), so a bucket is bounded and a chunk's rows carry many names."""
    total = chunks.agg(F.sum(size)).first()[0] or 0
    return max(1, -(-int(total) // BUCKET_BYTES))


def text_size():
    return F.element_at("ends", -1)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    have = {c.lower() for c in df.columns}
    return stem if stem.lower() not in have else f"{stem}_{uuid.uuid4().hex[:8]}"


# ---------------------------------------------------------------- text buffers
def text_bytes(arr) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column and its n + 1 offsets; null is empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    arr = arr.cast(pa.large_string())
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = arr.buffers()
    off = np.frombuffer(offs, np.int64)[arr.offset:arr.offset + len(arr) + 1]
    body = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, off - off[0]


def pieces(batch, column: str, limit: int = CHUNK_BYTES):
    """Slices of an Arrow batch of about ``limit`` text bytes, so that work
    arrays stay small: (slice, bytes, offsets)."""
    body, off = text_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(off, off[at] + limit, side="left"))
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at), body[off[at]:off[to]], off[at:to + 1] - off[at]
        at = to


# ---------------------------------------------------------------- hashing
def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (xor-shift, multiply)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def splitmix(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U) + U(seed)) * U(0x9E3779B97F4A7C15))


BYTE_CODE = splitmix(256, 1000)
_POS = {"p": splitmix(1 << 12, 7) | U(1)}


def position_codes(n: int) -> np.ndarray:
    if n > len(_POS["p"]):
        _POS["p"] = splitmix(2 * n, 7) | U(1)
    return _POS["p"]


#: true for bytes of words: everything but space and 0x09-0x0D
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False
#: true for bytes of words in lower-cased text: 0-9, a-z, 0x80-0xFF
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def word_spans(body: np.ndarray, off: np.ndarray, is_word: np.ndarray = NOT_SPACE):
    """(starts, ends, first word of each document as n + 1 offsets); words never
    cross documents."""
    inside = is_word[body]
    n = len(body)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    begin[cut] = inside[cut]
    stop[cut - 1] = inside[cut - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_codes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 14) -> np.ndarray:
    """64-bit hash of every word's bytes (a sum of byte codes times position
    codes, mixed with the length), ``block`` words at a time to stay in cache."""
    out = np.empty(len(starts), U)
    for a in range(0, len(starts), block):
        begin = starts[a:a + block]
        lens = ends[a:a + block] - begin
        first = np.cumsum(lens) - lens
        within = np.arange(int(lens.sum())) - np.repeat(first, lens)
        at = within + np.repeat(begin, lens)
        v = BYTE_CODE[body[at]] * position_codes(int(lens.max()))[within]
        out[a:a + block] = mix(np.add.reduceat(v, first) + lens.astype(U) * U(0xD6E8FEB86659FD93))
    return out


def gram_codes(codes: np.ndarray, first: np.ndarray, k: int, seed: int = 0):
    """Hash of every ``k`` consecutive words that lie in one document: (hashes,
    index of the first word)."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    h = np.full(n, U(seed + k))
    for j in range(k):
        h = h * U(0x9E3779B97F4A7C15) + codes[j:j + n]
        h ^= h >> U(29)
    ok = np.ones(n, bool)
    for b in first[1:-1]:
        ok[max(0, b - k + 1):b] = False
    at = np.flatnonzero(ok)
    return mix(h[at]), at


# ---------------------------------------------------------------- chunks
def pack(docs: DataFrame, doc_id: str, text: str, by_id: bool = False) -> DataFrame:
    """Chunk table of ``docs`` (see the module head), not yet written.

    ``by_id``: documents are range-partitioned and sorted by id, chunk ids
    follow that order, and rows with one id stay in one chunk, so that the
    smaller of two chunk ids holds the smaller document ids (null ids first).
    Otherwise chunks are cut from the scan with no shuffle."""
    ship_package(docs.sparkSession)
    d = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    if by_id:
        d = d.repartitionByRange("doc_id").sortWithinPartitions("doc_id")

    def run(batches):
        from pyspark import TaskContext
        base, seq = TaskContext.get().partitionId() << 32, 0
        ids, sizes, parts, held = [], [], [], 0

        def out():
            nonlocal ids, sizes, parts, held, seq
            seq += 1
            row = pa.RecordBatch.from_arrays(
                [pa.array([base + seq], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                 pa.array([np.cumsum(sizes).tolist()], pa.list_(pa.int64())),
                 pa.array([b"".join(parts)], pa.binary())], ["chunk", "doc_ids", "ends", "body"])
            ids, sizes, parts, held = [], [], [], 0
            return row
        for b in batches:
            body, off = text_bytes(b.column(1))
            raw = body.tobytes()
            for k, i in enumerate(b.column(0).to_pylist()):
                if held >= CHUNK_BYTES and not (by_id and ids[-1] == i):
                    yield out()
                ids.append(i)
                part = raw[off[k]:off[k + 1]]
                sizes.append(len(part))
                parts.append(part)
                held += len(part) + 16
        if ids:
            yield out()
    return d.mapInArrow(run, CHUNK_SCHEMA)


def chunk_rows(batches):
    """Rows of a chunk table inside a task: (id, doc ids, offsets, bytes, other columns)."""
    for b in batches:
        names = b.schema.names
        for k in range(b.num_rows):
            row = {c: b.column(j)[k] for j, c in enumerate(names)}
            off = np.concatenate([[0], np.asarray(row["ends"].as_py(), np.int64)]).astype(np.int64)
            body = np.frombuffer(row["body"].as_buffer(), np.uint8) if off[-1] else np.zeros(0, np.uint8)
            yield row["chunk"].as_py(), row["doc_ids"].as_py(), off, body, row


# ---------------------------------------------------------------- name exchange
POST_SCHEMA = "bucket int, chunk long, keys binary, extra binary"
ANSWER_SCHEMA = "chunk long, bucket int, n int, value binary, distinct long, total long"


def edges_of(nb: int, part: int = 0, parts: int = 1) -> np.ndarray:
    """Lower limits of the buckets of one part of the name space, and its end."""
    lo, hi = (part << 64) // parts, ((part + 1) << 64) // parts
    return np.array([min(lo + (hi - lo) * b // nb, (1 << 64) - 1) for b in range(nb + 1)], dtype=object)


def cut(keys: np.ndarray, nb: int, part: int, parts: int) -> np.ndarray:
    """Where the buckets of a part begin in sorted ``keys`` (nb + 1 places)."""
    e = edges_of(nb, part, parts)
    at = np.searchsorted(keys, e.astype(U), side="left")
    if part == parts - 1:
        at[-1] = len(keys)
    return at


def post(chunks: DataFrame, namer, nb: int, part: int = 0, parts: int = 1) -> DataFrame:
    """``namer(off, body, row) -> (sorted distinct keys, aligned extra array or None)``."""
    ship_package(chunks.sparkSession)

    def run(batches):
        for cid, _, off, body, row in chunk_rows(batches):
            keys, extra = namer(off, body, row)
            at = cut(keys, nb, part, parts)
            some = np.flatnonzero(at[1:] > at[:-1])
            if len(some):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int32()), pa.array([cid] * len(some), pa.int64()),
                     pa.array([keys[at[b]:at[b + 1]].tobytes() for b in some], pa.binary()),
                     pa.array([b"" if extra is None else extra[at[b]:at[b + 1]].tobytes() for b in some],
                              pa.binary())],
                    ["bucket", "chunk", "keys", "extra"])
    return chunks.mapInArrow(run, POST_SCHEMA)


def answer(posted: DataFrame, judge, extra_type=None) -> DataFrame:
    """Resolve each bucket: ``judge(order, new, keys, extra, sizes) -> (values
    aligned with keys, distinct, total)``; rows come ordered by chunk, ``order``
    is the stable sort of the keys and ``new`` marks, in that order, the first
    of every group of equal names."""
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("chunk")
        bucket = t.column("bucket")[0].as_py()
        raw = t.column("keys").to_pylist()
        keys = np.frombuffer(b"".join(raw), U)
        extra = None if extra_type is None else np.frombuffer(b"".join(t.column("extra").to_pylist()), extra_type)
        sizes = np.array([len(x) // 8 for x in raw], np.int64)
        order = np.argsort(keys, kind="stable")
        s = keys[order]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        values, distinct, total = judge(order, new, keys, extra, sizes)
        ends = np.cumsum(sizes)
        blobs = [np.packbits(v).tobytes() if v.dtype == bool else v.tobytes()
                 for v in np.split(values, ends[:-1])]
        rest = [0] * (len(blobs) - 1)
        return pa.table({"chunk": t.column("chunk"), "bucket": pa.array([bucket] * len(blobs), pa.int32()),
                         "n": pa.array(sizes, pa.int32()), "value": pa.array(blobs, pa.binary()),
                         "distinct": pa.array([distinct, *rest], pa.int64()),
                         "total": pa.array([total, *rest], pa.int64())})
    return posted.groupBy("bucket").applyInArrow(run, ANSWER_SCHEMA)


def checked(order, new, extra):
    """``new`` with the check values taken into account: names whose
    64-bit keys agree by chance but whose checks differ stay apart."""
    c = extra[order]
    clash = ~new[1:] & (c[1:] != c[:-1])
    if not clash.any():
        return order, new
    gid = np.cumsum(new)
    again = np.lexsort((order, c, gid))
    g, c = gid[again], c[again]
    fresh_ = np.ones(len(g), bool)
    fresh_[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
    return order[again], fresh_


def several(order, new) -> np.ndarray:
    """Of every name, in the senders' order: did more than one chunk send it?"""
    gid = np.cumsum(new) - 1
    out = np.zeros(len(order), bool)
    out[order] = np.bincount(gid)[gid] > 1 if len(gid) else False
    return out


def with_answers(chunks: DataFrame, replies: DataFrame) -> DataFrame:
    """Every chunk with its replies: ``replies`` array<struct<part, bucket, n, value>>."""
    r = replies.groupBy("chunk").agg(F.collect_list(F.struct("part", "bucket", "n", "value")).alias("replies"))
    return chunks.join(r, "chunk", "left")


def reply_values(row, dtype=None) -> np.ndarray:
    """The values of a chunk's replies, in the order of its sorted names
    (bits when ``dtype`` is None)."""
    got = row["replies"].as_py() or []
    got.sort(key=lambda x: (x["part"], x["bucket"]))
    if dtype is not None:
        return np.frombuffer(b"".join(x["value"] for x in got), dtype)
    parts = [np.unpackbits(np.frombuffer(x["value"], np.uint8), count=x["n"]) for x in got]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)
