"""Operator 7: quality classifier by hierarchical empirical Bayes.

A document classifier (logistic regression on a dozen text shape figures, fitted
in numpy on at most ``SAMPLE`` labelled rows, chosen by a seeded hash) gives each
document the probability that it is good.  Sites and paths then speak: grouped
aggregation over *all* documents gives each host, and each (host, path), its
count and its sum of probabilities.  The host posterior is the beta-binomial mean
shrunk to the global mean, the path posterior is shrunk to its host's; the prior
strengths come from the data by the method of moments.  A sparse host therefore
says little, a large one more.  The document itself is left out of its own groups'
sums.  Scores combine log odds: logit(document) + logit(path) - logit(global).

Edge cases: null, empty and blank texts have all figures 0; a null host or path
is a value of its own; with no labels, or labels of one class only, documents
score 0.5 at the document level; null labels and labels outside 0 and 1 are not
read; ids may repeat; extra columns are not read; an empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.session import ship_package

from . import common as C
from .registry import query

SAMPLE = 20_000
THRESHOLD = 0.5
UNIT = 1_000_000  # probabilities are summed as whole millionths, in any order alike
FIGURES = 11
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True
_SIGN = np.zeros(256, bool)
_SIGN[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:!?'\"-()"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_LINE = np.zeros(256, bool)
_LINE[10] = True


def figures(body: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Text shape figures of whole documents, one row each."""
    n = len(off) - 1
    starts, ends, first = C.word_spans(body, off)
    codes = C.word_codes(body, starts, ends)
    words = np.diff(first).astype(float)
    size = np.diff(off).astype(float)

    def per(values, edges):
        c = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
        return c[edges[1:]] - c[edges[:-1]]

    def share(a, b):
        return a / np.maximum(b, 1)
    lens = (ends - starts).astype(float)
    doc = np.repeat(np.arange(n), np.diff(first))
    order = np.lexsort((codes, doc))
    c, d = codes[order], doc[order]
    new = np.ones(len(c), bool)
    new[1:] = (c[1:] != c[:-1]) | (d[1:] != d[:-1])
    kinds = np.bincount(d[new], minlength=n).astype(float)
    again = np.zeros(len(codes))
    again[1:] = (codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])
    signs = _SIGN[body]
    out = np.stack([
        np.log1p(words), share(per(_LETTER[body], off), size), share(per(signs, off), size),
        share(per(_DIGIT[body], off), size), share(per(_STOP[body], off), words), share(per(_LINE[body], off), words),
        share(per(lens, first), words), np.sqrt(share(per(lens ** 2, first), words)), share(kinds, words),
        share(per(again, first), words),
        share(per((lens == 1) & (signs[starts] if len(starts) else np.zeros(0, bool)), first), words)], axis=1)
    return np.where(words[:, None] > 0, out, 0.0)


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1.0):
    """(mean, scale, weights with intercept) by Newton steps."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    pull = np.append(np.full(z.shape[1] - 1, ridge), 1e-3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (y - p) - pull * w
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(pull)
        step = np.linalg.solve(h, g)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def _squares(x):
    """Figures with the squares of the shares, so that middle ranges can be good."""
    return np.hstack([x, x ** 2])


def apply_logistic(model, x):
    if model is None:
        return np.full(len(x), 0.5)
    mean, scale, w = model
    z = np.clip((_squares(x) - mean) / scale, -8, 8) @ w[:-1] + w[-1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _figures_of(df: DataFrame, extra: str) -> DataFrame:
    """(figures array<double>, ``extra`` column) of the rows of (text, extra)."""
    def run(batches):
        for b in batches:
            for part, body, off in C.pieces(b, "text"):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(figures(body, off).tolist(), pa.list_(pa.float64())), part.column(extra)], ["figures", extra])
    return df.select("text", extra).mapInArrow(run, f"figures array<double>, {extra} int")


def learn(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label_id: str, label: str, sample: int):
    """Model of the bounded, seeded sample of labelled rows, or None."""
    known = labels.select(F.col(f"`{label_id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("int").alias("y")) \
        .filter("id is not null and y in (0, 1)").groupBy("id").agg(F.min("y").alias("y"))
    taken = C.seeded_sample(known, "id", sample, 7)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")) \
        .join(taken, "id")
    got = _figures_of(rows, "y").limit(2 * sample).collect()
    y = np.array([r["y"] for r in got], float)
    if len(y) == 0 or y.min() == y.max():
        return None
    return fit_logistic(_squares(np.array([r["figures"] for r in got])), y)


def _logit(p):
    q = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(q / (1 - q))


def quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column, doc_id: str = "doc_id",
            text: str = "text", label_id: str = "doc_id", label: str = "quality", sample: int = SAMPLE,
            threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """(row struct of the columns ``keep``, all by default, p_document, p_host, p_path, score, good): one
    row per input row.  See the module head."""
    spark = docs.sparkSession
    ship_package(spark)
    model = learn(docs, labels, doc_id, text, label_id, label, sample)
    row = F.struct(*[F.col(f"`{c}`") for c in (keep or docs.columns)])
    slim = docs.select(row.alias("row"), F.col(f"`{text}`").alias("text"), host.cast("string").alias("host"),
                       path.cast("string").alias("path"))

    @F.pandas_udf("long")
    def probability(texts: pd.Series) -> pd.Series:
        arr = pa.array(texts, pa.string())
        batch = pa.RecordBatch.from_arrays([arr], ["text"])
        parts = [apply_logistic(model, figures(body, off)) for _, body, off in C.pieces(batch, "text")]
        return pd.Series(np.rint(np.concatenate(parts) * UNIT).astype(np.int64) if parts else np.zeros(0, np.int64))
    scored = slim.withColumn("p", probability("text")).drop("text")
    scored = C.store(scored, "op7-scored")
    paths = C.store(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")), "op7-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    every = hosts.agg(F.sum("n").alias("N"), F.sum("s").alias("S")).first()
    total, mean = float(every["N"] or 1), float(every["S"] or 0) / UNIT / float(every["N"] or 1)

    def strength(groups, count):
        """Method of moments: group means vary by more than binomial noise."""
        share = F.col("s") / UNIT / F.col("n")
        v = groups.agg((F.sum(F.col("n") * (share - mean) * (share - mean)) / total).alias("v")).first()["v"] or 0.0
        noise = mean * (1 - mean) * (count - 1) / total
        between = max(v - noise, 1e-6)
        return float(np.clip(mean * (1 - mean) / between - 1, 1.0, 1e4))
    counts = paths.agg(F.count("*").alias("p")).first()["p"], hosts.count()
    k_path, k_host = strength(paths, counts[0]), strength(hosts, counts[1])
    prior = paths.withColumnsRenamed({"n": "np", "s": "sp", "host": "h1", "path": "p1"}).join(
        hosts.withColumnsRenamed({"n": "nh", "s": "sh", "host": "h2"}), F.col("h1").eqNullSafe(F.col("h2")))
    got = scored.join(prior, F.col("host").eqNullSafe(F.col("h1")) & F.col("path").eqNullSafe(F.col("p1")))
    p = F.col("p") / UNIT
    p_host = (F.col("sh") / UNIT - p + k_host * mean) / (F.col("nh") - 1 + k_host)
    got = got.withColumn("p_document", p).withColumn("p_host", p_host) \
        .withColumn("p_path", (F.col("sp") / UNIT - p + k_path * F.col("p_host")) / (F.col("np") - 1 + k_path))
    odds = _logit(F.col("p_document")) + _logit(F.col("p_path")) - F.lit(float(np.log(max(mean, 1e-6) / max(1 - mean, 1e-6))))
    got = got.withColumn("score", F.round(1 / (1 + F.exp(-odds)), 6))
    return got.select("row", "p_document", "p_host", "p_path", "score", (F.col("score") >= threshold).alias("good"))


@query("op7_quality_classifier")
def op7(spark, sf_dir):
    """documents has no URL: ``source`` takes the place of host, ``lang`` of path."""
    docs = C.table(spark, sf_dir, "documents")
    out = quality(docs, C.table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"), keep=["doc_id"])
    return out.select("row.doc_id", "p_document", "p_host", "p_path", "score", "good")
