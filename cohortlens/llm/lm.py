"""Operator 8: language-model scores of documents.

Texts are lower-cased (A-Z); tokens are words and one end.  Two parts:

* **Counts.**  Each chunk of documents sends its distinct words (64-bit hashes) with
  their counts in the training documents; a bucket adds them up over the corpus
  and answers the corpus count of each.  ``base_score`` is the add-one unigram.
* **Attention.**  Words are cut into subword ids of a public vocabulary (each
  distinct word of a chunk once).  A causal self-attention model (``attention.py``)
  learns from every id of every training document: the chunks are dealt over
  ``ROUNDS`` rounds; in a round the tasks pass once over all windows of their
  chunks, each chunk from the round's parameters, and the next parameters are the
  mean of the chunks', weighted by ids.  The first parameters are small seeded
  numbers, with the corpus shares of the classes as biases; nothing is fitted on
  the driver.  The shares of ids inside its classes are counts over all training
  documents.  Overlapping windows score each id once; a word's probability is the
  product over its ids.

``score`` mixes both for each token: log10(``MIX`` * add-one share + (1 - ``MIX``) *
attention probability).  As in the base, all unseen words share one event.

The vocabulary file is a parameter; the driver reads it once and the tasks get it
as a broadcast of fixed size.

Edge cases: null and empty texts are one end token; with no training documents
all counts are 0 and the model is untrained; ids may repeat; a null id is held in
(its remainder is null, so it is a training row of no fold: it is not learned
from and not held out); extra columns are not read; an empty table gives an empty
result.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import zlib
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.session import ship_package

from . import attention as A
from . import common as C
from .common import U
from .registry import query

VOCABULARY = "byte_bpe_50k.tiktoken"
ROUNDS = 6
RATE = 0.03  # of the first round; falls to a third in the last
SUMS = 32
MIX = 0.5
END = 50256  # an id that the vocabulary file leaves free
IDS = END + 1
_ENCODER: dict = {}


def read_vocabulary(path: str | None = None) -> bytes:
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path(VOCABULARY)
    with open(path, "rb") as f:
        return f.read()


def encoder(raw: bytes):
    """The byte-pair encoder of a vocabulary file's bytes and the byte length of
    each id, once per process.  A piece is a space and what follows up to the next.
    The special token stands in no text of words and is never made: without any, the
    encoder looks for an empty one at every byte."""
    key = zlib.crc32(raw)
    if key not in _ENCODER:
        import tiktoken
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
        _ENCODER[key] = tiktoken.Encoding("words", pat_str=" [^ ]+", mergeable_ranks=ranks,
                                           special_tokens={" \n ": END}), \
            np.bincount(list(ranks.values()), [len(b) for b in ranks], IDS).astype(np.int64)
    return _ENCODER[key]


def word_ids(encode: tuple, body: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(number of ids of each word, all ids in turn) of words of ``body``, none of
    which holds white space.  The words go to the encoder as one text; ids have known
    byte lengths, so they show where a word ends.  If one is not UTF-8, each is cut
    alone."""
    enc, size = encode
    upto = np.cumsum(ends - starts + 1)
    begin = upto - (ends - starts + 1)
    text = body.take(np.arange(upto[-1] if len(upto) else 0) + np.repeat(starts - 1 - begin, np.diff(upto, prepend=0)),
                     mode="wrap") if len(body) else body.copy()
    text[begin] = 0x20
    text = text.tobytes()
    try:
        ids = enc.encode_to_numpy(text.decode(), disallowed_special=())
    except UnicodeDecodeError:
        cut = [enc._core_bpe.encode_single_piece(text[a:b]) for a, b in zip(begin.tolist(), upto.tolist())]
        return np.array([len(x) for x in cut], np.int32), np.array([t for x in cut for t in x], np.uint16)
    last = np.searchsorted(np.cumsum(size[ids]), upto)
    return np.diff(last, prepend=-1).astype(np.int32), ids.astype(np.uint16)


def distinct(codes: np.ndarray):
    """As ``np.unique``: sorted values, where each stands first, the number of each
    code's value.  Only the distinct ones are sorted."""
    coded = pa.array(codes).dictionary_encode()
    values, number = coded.dictionary.to_numpy(), coded.indices.to_numpy()
    order = np.argsort(values)
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order))
    first = np.empty(len(order), np.int64)
    first[number[::-1]] = np.arange(len(codes))[::-1]
    return values[order], first[order], rank[number]


def begins_word(raw: bytes) -> np.ndarray:
    out = np.zeros(IDS, bool)
    for line in raw.splitlines():
        if line:
            token, rank = line.split()
            out[int(rank)] = base64.b64decode(token)[:1] == b" "
    return out


WORDS_SCHEMA = ("chunk long, doc_ids array<long>, first binary, words binary, keys binary, counts binary, "
                "lens binary, ids binary, learned long")


def _learned(i, folds: int, held: int) -> bool:
    return i is not None and zlib.crc32(str(i).encode()) % folds != held


def _words(docs: DataFrame, doc_id: str, text: str, folds: int, held: int, vocabulary) -> DataFrame:
    """Chunks as word numbers: ``keys`` sorted hashes of the distinct words,
    ``counts`` in training documents, ``lens``/``ids`` their subword ids, ``words``
    the number of each word in turn, ``first`` the documents' offsets into it."""
    def run(batches):
        encode = encoder(vocabulary.value)
        for cid, doc_ids, off, body, _ in C.chunk_rows(batches):
            low = C.LOWER[body]
            starts, ends, first = C.word_spans(low, off)
            keys, index, back = distinct(C.word_codes(low, starts, ends))
            train = np.array([_learned(i, folds, held) for i in doc_ids], bool)
            counts = np.bincount(back[np.repeat(train, np.diff(first))], minlength=len(keys)).astype(np.int32)
            lens, ids = word_ids(encode, low, starts[index], ends[index])
            yield pa.RecordBatch.from_arrays(
                [pa.array([cid], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())),
                 *(pa.array([x.tobytes()], pa.binary()) for x in
                   (first.astype(np.int64), back.astype(np.int32), keys, counts, lens, ids)),
                 pa.array([int(train.sum())], pa.int64())],
                ["chunk", "doc_ids", "first", "words", "keys", "counts", "lens", "ids", "learned"])
    return C.pack(docs, doc_id, text).mapInArrow(run, WORDS_SCHEMA)


_TYPES = {"first": np.int64, "words": np.int32, "keys": U, "counts": np.int32, "lens": np.int32, "ids": np.uint16}


def _rows(batches):
    for b in batches:
        for k in range(b.num_rows):
            row = {c: b.column(j)[k] for j, c in enumerate(b.schema.names)}
            yield row, {c: np.frombuffer(row[c].as_py(), t) if len(row[c].as_py()) else np.zeros(0, t)
                        for c, t in _TYPES.items() if c in row}


def _documents_ids(a, docs=None):
    """Subword ids with the end id after each document, and their offsets; with
    the word (or -1: end) of each token, each token's first id and the documents'
    offsets into the tokens."""
    first = a["first"]
    if docs is None:
        docs = np.arange(len(first) - 1)
    n = first[docs + 1] - first[docs]
    # tokens: the documents' words, each document followed by its end
    ends = np.cumsum(n + 1)
    total = int(ends[-1]) if len(ends) else 0
    is_end = np.zeros(total, bool)
    is_end[ends - 1] = True
    word = np.full(total, -1, np.int64)
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[docs], n)
    word[~is_end] = a["words"][at]
    lens = np.append(a["lens"], 1).astype(np.int64)
    begin = np.cumsum(lens) - lens
    pool = np.append(a["ids"], END).astype(np.int32)
    size = lens[word]  # -1 is the end's entry
    upto = np.concatenate([[0], np.cumsum(size)])
    ids = pool.take(np.arange(upto[-1]) + np.repeat(begin[word] - upto[:-1], size))
    ends = np.concatenate([[0], ends])
    return ids, upto[ends], word, upto[:-1], ends


def lm_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = 7, held: int = 2,
              vocabulary: str | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): one
    row per input row; documents with crc32(id as text) mod ``folds`` equal to
    ``held`` are not learned from.  See the module head."""
    spark = docs.sparkSession
    ship_package(spark)
    raw = read_vocabulary(vocabulary)
    words = C.store(_words(docs, doc_id, text, folds, held, spark.sparkContext.broadcast(raw)), "op8-words")
    nb = C.buckets(words, 6 * F.octet_length("lens"))  # 4 bytes of each word's 12 and more

    def post(batches):
        for row, a in _rows(batches):
            at = C.cut(a["keys"], nb, 0, 1)
            some = np.flatnonzero(at[1:] > at[:-1])
            if len(some):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int32()), pa.array([row["chunk"].as_py()] * len(some), pa.int64()),
                     *(pa.array([x[at[b]:at[b + 1]].tobytes() for b in some], pa.binary())
                       for x in (a["keys"], a["counts"]))], ["bucket", "chunk", "keys", "extra"])

    def add(order, new, keys, extra, sizes):
        gid = np.cumsum(new) - 1
        total = np.bincount(gid, extra[order]).astype(np.int64) if len(gid) else np.zeros(0, np.int64)
        out = np.empty(len(keys), np.int64)
        out[order] = total[gid]
        return out, int((total > 0).sum()), int(total.sum())
    posted = words.select("chunk", "keys", "counts").mapInArrow(post, C.POST_SCHEMA)
    replies = C.store(C.answer(posted, add, np.int32).withColumn("part", F.lit(0)), "op8-counts")
    sums = replies.agg(F.sum("distinct").alias("v"), F.sum("total").alias("n")).first()
    learned = int(words.agg(F.sum("learned").alias("n")).first()["n"] or 0)
    tokens, kinds = int(sums["n"] or 0) + learned, int(sums["v"] or 0) + (learned > 0)

    def id_counts(batches):
        total = np.zeros(IDS, np.int64)
        for _, a in _rows(batches):
            total += np.bincount(a["ids"], np.repeat(a["counts"], a["lens"]), IDS).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["id", "n"])
    counts = np.zeros(IDS)
    counts[END] = learned
    for r in words.select("counts", "lens", "ids").mapInArrow(id_counts, "id int, n long") \
            .groupBy("id").agg(F.sum("n").alias("n")).collect():  # at most one row an id of the vocabulary
        counts[r["id"]] = r["n"]

    codes = A.Codes(counts, begins_word(raw))
    model = A.start_model(codes)
    if learned:
        model = _learn(words, codes, model, folds, held)

    def score(batches):
        for row, a in _rows(batches):
            doc_ids = row["doc_ids"].as_py()
            c = np.append(C.reply_values(row, np.int64), learned)
            ids, upto, word, begin, first = _documents_ids(a)
            logs = A.token_logs(model, codes, ids, upto, END)
            att = np.add.reduceat(logs.astype(float), begin)
            c = c[word]
            base = np.log10((c + 1) / (tokens + kinds + 1))
            both = np.logaddexp(base * np.log(10) + np.log(MIX), np.log(1 - MIX) + att) / np.log(10)
            at = first[:-1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64()),
                 pa.array([i is not None and zlib.crc32(str(i).encode()) % folds == held for i in doc_ids]),
                 pa.array(np.diff(first), pa.int64()), pa.array(np.add.reduceat((c > 0).astype(np.int64), at)),
                 pa.array([tokens] * len(doc_ids), pa.int64()), pa.array(np.add.reduceat(base, at)),
                 pa.array(np.add.reduceat(both, at))],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return C.with_answers(words.drop("keys", "counts"), replies).mapInArrow(
        score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
               "base_score double, score double")


def _windows(codes, ids, first):
    """Learning windows of documents that stand in a row, and their classes."""
    x, place = A.spans(A.inputs(codes, ids, first, END), first, codes.symbol[END])
    return x, np.append(codes.cls[ids], -1).take(place, mode="wrap")


SUM_SCHEMA = "task int, ids long, windows long, total binary"


def _learn(words: DataFrame, codes, model: dict, folds: int, held: int) -> dict:
    """``model`` after ``ROUNDS`` rounds that together pass once over all windows
    of all training documents.  A task sends one sum of fixed size; sums are added
    in ``SUMS`` groups, then in one."""
    def passes(model, nth, rate):
        def run(batches):
            from pyspark import TaskContext
            total, seen, windows = 0.0, 0, 0
            for row, a in _rows(batches):
                own = row["doc_ids"].as_py()
                pick = np.array([k for k, i in enumerate(own) if _learned(i, folds, held)], np.int64)
                if not len(pick):
                    continue
                ids, upto, *_ = _documents_ids(a, pick)
                x, y = _windows(codes, ids, upto)
                total = total + A.packed(A.go_on(model, x, y, rate, row["chunk"].as_py() % (1 << 31))).astype(float) * len(ids)
                seen, windows = seen + len(ids), windows + len(x)
            if seen:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([TaskContext.get().partitionId() % SUMS], pa.int32()), pa.array([seen], pa.int64()),
                     pa.array([windows], pa.int64()), pa.array([total.tobytes()], pa.binary())],
                    ["task", "ids", "windows", "total"])
        return words.filter(F.pmod(F.xxhash64("chunk"), F.lit(ROUNDS)) == nth) \
            .select("chunk", "doc_ids", "first", "words", "lens", "ids").mapInArrow(run, SUM_SCHEMA)

    def add(t: pa.Table) -> pa.Table:
        t = t.sort_by([("ids", "ascending"), ("total", "ascending")])
        total = sum(np.frombuffer(v.as_buffer(), float) for v in t.column("total"))
        return pa.table({"task": pa.array([0], pa.int32()),
                         **{c: pa.array([sum(t.column(c).to_pylist())], pa.int64()) for c in ("ids", "windows")},
                         "total": pa.array([total.tobytes()], pa.binary())})
    for nth in range(ROUNDS):
        sums = passes(model, nth, RATE * 3.0 ** (-nth / max(1, ROUNDS - 1))) \
            .groupBy("task").applyInArrow(add, SUM_SCHEMA).groupBy("task").applyInArrow(add, SUM_SCHEMA).first()
        if sums:
            model = A.unpacked(np.frombuffer(sums["total"], float) / sums["ids"])
    return model


@query("op8_lm_scoring")
def op8(spark, sf_dir):
    return lm_scores(C.table(spark, sf_dir, "documents"))
