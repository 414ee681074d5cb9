"""A text classifier for D1-D4: softmax regression over hashed word n-grams.

A text's features are its words and word pairs, hashed to ``slots`` places, weighted
ln(1 + count) times the inverse document frequency of the training texts and scaled to
length 1, and a constant.  Slots that no training text uses weigh nothing.

Training reads every labelled text.  The features are stored once; each pass sends one
gradient sum of the model's fixed size per task, summed by ``CELLS`` cells before the
driver takes an accelerated step.  ``save_model`` writes the model as a new version of
a table and ``load_model`` reads the current one; ``TextModel`` is a scorer factory for
``operators.models``, so models are interchangeable in the score columns.

``max_tokens`` (the study's models cut texts at 512 tokens) is off by default: whole
texts are scored.  A batch is scored in runs of texts of similar length, so a run's
work arrays follow its own texts.  A null or empty text has the constant only.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WORD_PATTERN, tokens
from ..session import materialize, ship_package
from ..sources.sinks import read_versioned, replace_versioned

SLOTS = 1 << 14
PAIR = 1_000_003
CELLS = 16
RUN_WORDS = 1 << 18
_CODES: dict[str, int] = {}


def word_code(word: Column) -> Column:
    """28 bits of the word's MD5, which any engine can repeat."""
    return F.conv(F.substring(F.md5(word.cast("binary")), 1, 7), 16, 10).cast("long")


def _code(word: str) -> int:
    got = _CODES.get(word)
    if got is None:
        if len(_CODES) > 1 << 18:
            _CODES.clear()
        got = _CODES[word] = int(hashlib.md5(word.encode()).hexdigest()[:7], 16)
    return got


def text_slots(toks: Column, slots: int, max_tokens: int | None) -> Column:
    """The slots of a text's words and word pairs, repeats included."""
    words = F.slice(toks, F.lit(1), F.lit(max_tokens)) if max_tokens else toks
    codes = F.transform(words, word_code)
    pairs = F.when(F.size(codes) > 1, F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1),
                                                 F.slice(codes, F.lit(2), F.size(codes) - 1),
                                                 lambda a, b: F.pmod(a * PAIR + b, F.lit(slots)))) \
        .otherwise(F.array().cast("array<bigint>"))
    return F.concat(F.transform(codes, lambda c: F.pmod(c, F.lit(slots))), pairs).cast("array<int>")


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _sparse(slot_lists, idf):
    """Rows of slots (repeats counted) -> (text number, slot, value), scaled to length 1."""
    lens = np.array([len(s) for s in slot_lists], np.int64)
    text = np.repeat(np.arange(len(lens)), lens)
    flat = np.concatenate(slot_lists).astype(np.int64) if len(lens) else np.zeros(0, np.int64)
    key, n = np.unique(text * len(idf) + flat, return_counts=True)
    text, slot = key // len(idf), key % len(idf)
    x = np.log1p(n) * idf[slot]
    norm = np.sqrt(np.bincount(text, x * x, len(lens)))
    some = x > 0
    return text[some], slot[some], (x[some] / norm[text[some]])


def runs_of(sizes, most: int):
    """Bounds (begin, end) of runs of neighbours whose sizes add up to ``most`` at most;
    a larger one is a run of its own."""
    begin = held = 0
    for k, n in enumerate(sizes):
        if k > begin and held + n > most:
            yield begin, k
            begin, held = k, 0
        held += n
    if len(sizes):
        yield begin, len(sizes)


class TextModel:
    """A fitted model; called without arguments it gives ``predict(texts) -> (n, classes)``."""

    def __init__(self, weights: np.ndarray, idf: np.ndarray, max_tokens: int | None = None):
        self.weights, self.idf, self.max_tokens = weights, idf, max_tokens
        self.cache_key = hashlib.md5(weights.tobytes() + idf.tobytes() + repr(max_tokens).encode()).hexdigest()

    def __call__(self):
        slots = len(self.idf)
        word = re.compile(WORD_PATTERN)

        def slots_of(text):
            w = word.findall((text or "").lower())[:self.max_tokens]
            c = np.array([_code(x) for x in w], np.int64)
            return np.concatenate([c % slots, (c[:-1] * PAIR + c[1:]) % slots])

        def predict(texts):
            out = np.empty((len(texts), self.weights.shape[1]))
            order = sorted(range(len(texts)), key=lambda k: len(texts[k] or ""))
            run, held = [], 0
            for nth, k in enumerate(order):
                run.append((k, slots_of(texts[k])))
                held += len(run[-1][1])
                if held >= RUN_WORDS or nth == len(order) - 1:
                    text, slot, x = _sparse([s for _, s in run], self.idf)
                    z = np.tile(self.weights[-1], (len(run), 1))
                    for c in range(z.shape[1]):
                        z[:, c] += np.bincount(text, x * self.weights[slot, c], len(run))
                    out[[k for k, _ in run]] = softmax(z)
                    run, held = [], 0
            return out
        return predict


def fit_classifier(rows: DataFrame, text: str, label: Column, classes: int, passes: int = 20, step: float = 2.0,
                   ridge: float = 1e-4, slots: int = SLOTS, max_tokens: int | None = None) -> tuple[TextModel, list[float]]:
    """The model fitted on the rows whose ``label`` is in 0 .. classes - 1, every class
    weighing the same, and the mean loss before each pass."""
    spark = rows.sparkSession
    ship_package(spark)
    y = label.cast("int")
    feats = materialize(rows.filter(y.between(0, classes - 1))
                        .select(y.alias("y"), text_slots(tokens(text), slots, max_tokens).alias("s")), "classifier-features")
    sizes = {r["y"]: r["n"] for r in feats.groupBy("y").agg(F.count("*").alias("n")).collect()}  # a row a class
    n = sum(sizes.values())
    if not n:
        return TextModel(np.zeros((slots + 1, classes)), np.zeros(slots), max_tokens), []
    # a row a slot at most
    seen = feats.select(F.explode(F.array_distinct("s")).alias("slot")).groupBy("slot").agg(F.count("*").alias("n")).collect()
    df = np.zeros(slots)
    df[[r["slot"] for r in seen]] = [r["n"] for r in seen]
    idf = np.where(df > 0, np.log((1 + n) / (1 + df)) + 1, 0.0)
    weigh = np.array([n / (len(sizes) * sizes[c]) if c in sizes else 0.0 for c in range(classes)])
    w = v = np.zeros((slots + 1, classes))
    trace = []
    for t in range(passes):
        now = v

        def run(batches):
            from pyspark import TaskContext
            g, loss = np.zeros((slots + 1, classes)), 0.0
            for b in batches:
                every, col = b.column("y").to_numpy(), b.column("s")
                for lo, hi in runs_of(np.asarray(col.value_lengths()), RUN_WORDS):
                    ys = every[lo:hi]
                    texts, slot, x = _sparse([np.asarray(s.values) for s in col.slice(lo, hi - lo)], idf)
                    z = np.tile(now[-1], (len(ys), 1))
                    for c in range(classes):
                        z[:, c] += np.bincount(texts, x * now[slot, c], len(ys))
                    p = softmax(z)
                    loss -= float((weigh[ys] * np.log(p[np.arange(len(ys)), ys])).sum())
                    p[np.arange(len(ys)), ys] -= 1
                    p *= weigh[ys][:, None]
                    for c in range(classes):
                        g[:-1, c] += np.bincount(slot, x * p[texts, c], slots)
                    g[-1] += p.sum(axis=0)
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId() % CELLS], pa.int32()), pa.array([g.tobytes()], pa.binary()),
                 pa.array([loss])], ["cell", "g", "loss"])

        def add(table: pa.Table) -> pa.Table:
            g = sum(np.frombuffer(x, np.float64) for x in table.column("g").to_pylist())
            return pa.table({"g": pa.array([g.tobytes()], pa.binary()), "loss": pa.array([sum(table.column("loss").to_pylist())])})
        got = feats.mapInArrow(run, "cell int, g binary, loss double").groupBy("cell") \
            .applyInArrow(add, "g binary, loss double").collect()  # CELLS rows of the model's size at most
        g = sum(np.frombuffer(r["g"], np.float64) for r in got).reshape(slots + 1, classes) / n
        trace.append(sum(r["loss"] for r in got) / n)
        g[:-1] += ridge * v[:-1]
        ahead = v - step * g
        v, w = ahead + t / (t + 3) * (ahead - w), ahead
    return TextModel(w, idf, max_tokens), trace


def save_model(spark: SparkSession, model: TextModel, table: str) -> str:
    """Write the model as a new version of ``table``: one row a slot, slot -1 the constant."""
    idf = np.append(model.idf, 0.0)
    rows = [(k if k < len(model.idf) else -1, float(idf[k]), [float(x) for x in model.weights[k]],
             model.max_tokens, len(model.idf)) for k in range(len(idf))]
    return replace_versioned(spark.createDataFrame(
        rows, "slot int, idf double, weights array<double>, max_tokens int, slots int").coalesce(1), table)


def load_model(spark: SparkSession, table: str) -> TextModel:
    """The current version of a model table."""
    rows = sorted(read_versioned(spark, table).collect(), key=lambda r: (r["slot"] < 0, r["slot"]))
    return TextModel(np.array([r["weights"] for r in rows]), np.array([r["idf"] for r in rows[:-1]]), rows[0]["max_tokens"])
