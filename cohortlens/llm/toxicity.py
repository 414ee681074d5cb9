"""Operator 2: toxicity by compression distance.

Two zstandard dictionaries are trained, one on characteristic words of toxic and
one on those of ordinary training texts, each placed before the same common base
trained on ordinary windows.  A window of ``WINDOW`` lower-cased words is
compressed with both; its distance is the ordinary length less the toxic length.
A document's figures are the mean, the highest distances and the shares of windows
beyond fixed distances; a logistic curve fitted on texts that the dictionaries
have not seen calibrates them to a score, and ``threshold`` decides.

Training reads at most ``SAMPLE`` labelled rows, chosen by a seeded hash (the only
bounded part; every whole text is scored).  Texts that share their smallest
five-word hash count once, so a group of copies teaches no words of its own.

Edge cases: null, empty and blank texts have no windows, all figures 0 and the
score the curve gives for that; with no usable labels, or one class only, scores
are 0; null labels and labels outside 0 and 1 are not read; ids may repeat or be
null; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.session import ship_package

from . import common as C
from .quality import fit_logistic
from .registry import query

SAMPLE = 12_000
WINDOW = 8
LEVEL = 3
DICTIONARY = 2048
BASE = 16 << 10
BASE_WINDOWS = 60_000
LIMITS = (1, 2, 3, 4, 6)
LEAST = 4  # documents that a characteristic word must stand in
THRESHOLD = 0.3


def windows(raw: bytes) -> list[bytes]:
    words = raw.lower().split()
    return [b" ".join(words[i:i + WINDOW]) for i in range(0, len(words), WINDOW)]


def _train(samples: list[bytes], size: int, k: int = 32, d: int = 8) -> bytes:
    """A trained dictionary's bytes; of samples too few to train on, the samples."""
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=d).as_bytes()[-size:]
    except (zstandard.ZstdError, ValueError, MemoryError):
        return b"".join(samples)[-size:]


def _sample_key(raw: bytes) -> int:
    w = raw.split()
    return min((xxhash.xxh64_intdigest(b" ".join(w[i:i + 5])) for i in range(max(1, len(w) - 4))), default=0)


def train(texts: list[bytes], labels: list[int]):
    """(toxic dictionary, ordinary dictionary, curve) or None without two classes."""
    seen, rows = set(), []
    for raw, y in zip(texts, labels):
        key = _sample_key(raw)
        if key not in seen:
            seen.add(key)
            rows.append((raw, y))
    for_words = [r for i, r in enumerate(rows) if i % 4]
    for_curve = [r for i, r in enumerate(rows) if i % 4 == 0]
    count = {0: Counter(), 1: Counter()}
    for raw, y in for_words:
        count[y].update(set(raw.lower().split()))
    n = {y: sum(1 for _, z in for_words if z == y) for y in (0, 1)}
    if not n[0] or not n[1]:
        return None

    def odds(w):
        return np.log((count[1][w] + .5) / (n[1] + 1)) - np.log((count[0][w] + .5) / (n[0] + 1))
    toxic = [w for w, c in sorted(count[1].items()) if c >= min(LEAST, n[1]) and odds(w) > min(3, np.log(n[0] + 1))]
    plain = [w for w, c in sorted(count[0].items()) if c >= min(20, n[0]) and odds(w) <= 0]
    rng = np.random.default_rng(0)

    def samples(words, often, cap):
        flat = [b" " + w for w in words for _ in range(min(often[w], cap))]
        rng.shuffle(flat)
        return [b"".join(flat[i:i + 12]) for i in range(0, len(flat), 12)]
    base = [w for raw, y in for_words if y == 0 for w in windows(raw)]
    rng.shuffle(base)
    base = _train(base[:BASE_WINDOWS], BASE, 50, 8)
    size = min(DICTIONARY, max(256, 2 * sum(len(w) + 1 for w in toxic)))
    dicts = (_train(samples(toxic, count[1], 1 << 30) * 3, size) + base,
             _train((samples(plain, count[0], 20) * 3)[:200_000], size) + base)
    measure = distances(*dicts)
    x = np.array([measure(raw) for raw, _ in for_curve]).reshape(len(for_curve), -1)
    y = np.array([y for _, y in for_curve], float)
    if len(y) == 0 or y.min() == y.max():
        x = np.array([measure(raw) for raw, _ in rows])
        y = np.array([y for _, y in rows], float)
    return *dicts, fit_logistic(np.hstack([x, x ** 2]), y)


def distances(toxic: bytes, plain: bytes):
    """A function: text bytes -> figures of its windows' distances."""
    def compressor(raw):
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False,
                                        write_checksum=False, write_dict_id=False).compress
    a, b = compressor(toxic), compressor(plain)

    def measure(raw: bytes) -> list[float]:
        w = windows(raw)
        if not w:
            return [0.0] * (len(LIMITS) + 4)
        d = np.array([len(b(x)) - len(a(x)) for x in w], float)
        top = -np.partition(-d, min(2, len(d) - 1))[:3]
        return [d.mean(), d.max(), top.mean(), *((d >= t).mean() for t in LIMITS), np.log1p(len(w))]
    return measure


def toxicity(docs: DataFrame, labels: DataFrame, train_on: Column, doc_id: str = "doc_id", text: str = "text",
             label_id: str = "doc_id", label: str = "toxic", sample: int = SAMPLE,
             threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted): one row per input row; ``train_on`` (a column
    over ``docs``) says which rows' labels may be learned from."""
    spark = docs.sparkSession
    ship_package(spark)
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"),
                       F.coalesce(train_on, F.lit(False)).alias("t"))
    known = labels.select(F.col(f"`{label_id}`").alias("id"), F.col(f"`{label}`").cast("int").alias("y")) \
        .filter("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    allowed = slim.filter("t").select(F.col("doc_id").alias("id")).distinct()
    taken = C.seeded_sample(known.join(allowed, "id", "left_semi"), "id", sample, 11)
    rows = slim.join(F.broadcast(taken), slim.doc_id == taken.id) \
        .select("id", "text", "y").orderBy("id", "text").limit(2 * sample).collect()  # bounded by the sample
    model = train([(r["text"] or "").encode() for r in rows], [r["y"] for r in rows])

    def run(batches):
        if model is not None:
            measure, (mean, scale, w) = distances(*model[:2]), model[2]
        for batch in batches:
            for part, body, off in C.pieces(batch, "text"):
                raw = body.tobytes()
                if model is None:
                    score = np.zeros(len(off) - 1)
                else:
                    x = np.array([measure(raw[off[k]:off[k + 1]]) for k in range(len(off) - 1)])
                    z = np.clip((np.hstack([x, x ** 2]) - mean) / scale, -8, 8) @ w[:-1] + w[-1]
                    score = np.round(1 / (1 + np.exp(-np.clip(z, -30, 30))), 9)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                    ["doc_id", "score", "predicted"])
    kind = dict(slim.dtypes)["doc_id"]
    return slim.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def remainder(doc_id: str, n: int) -> Column:
    return F.pmod(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")), F.lit(n))


@query("op2_toxicity")
def op2(spark, sf_dir):
    docs = C.table(spark, sf_dir, "documents")
    out = toxicity(docs, C.table(spark, sf_dir, "labels"), remainder("doc_id", 4) != 2)
    return out.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")
