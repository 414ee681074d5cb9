"""The trained scorer against plain Python, its table, its use in the score columns."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import classifier as CL
from cohortlens.operators import models as MD

SLOTS = 64
ROWS = [("good plain words here", 0), ("bad words, BAD bad", 1), ("plain text and more plain text", 0), ("bad", 1), ("", 0),
        (None, 1), ("x" * 50 + " bad text", 1), ("more good words", 0), ("third thing", 2), ("skip", None), ("skip", 7)] * 2


def plain_features(text):
    h = [int(hashlib.md5(w.encode()).hexdigest()[:7], 16) for w in re.findall("[a-z]+", (text or "").lower())]
    return Counter([c % SLOTS for c in h] + [(a * CL.PAIR + b) % SLOTS for a, b in zip(h, h[1:])])


def plain_fit(rows, k, passes, step=2.0, ridge=1e-4):
    rows = [(plain_features(t), y) for t, y in rows if y is not None and 0 <= y < k]
    n, sizes = len(rows), Counter(y for _, y in rows)
    df = Counter(s for f, _ in rows for s in f)
    idf = {s: math.log((1 + n) / (1 + d)) + 1 for s, d in df.items()}

    def scaled(f):
        x = {s: math.log(1 + c) * idf.get(s, 0.0) for s, c in f.items()}
        norm = math.sqrt(sum(v * v for v in x.values())) or 1.0
        return {**{s: v / norm for s, v in x.items()}, SLOTS: 1.0}

    def proba(w, x):
        z = [sum(v * w[s][c] for s, v in x.items()) for c in range(k)]
        e = [math.exp(a - max(z)) for a in z]
        return [a / sum(e) for a in e]
    data = [(scaled(f), y) for f, y in rows]
    w = [[0.0] * k for _ in range(SLOTS + 1)]
    v = [r[:] for r in w]
    losses = []
    for t in range(passes):
        g = [[0.0] * k for _ in w]
        loss = 0.0
        for x, y in data:
            cw = n / (len(sizes) * sizes[y])
            p = proba(v, x)
            loss -= cw * math.log(p[y]) / n
            for s, a in x.items():
                for c in range(k):
                    g[s][c] += a * cw * (p[c] - (c == y)) / n
        losses.append(loss)
        ahead = [[v[s][c] - step * (g[s][c] + (ridge * v[s][c] if s < SLOTS else 0)) for c in range(k)] for s in range(SLOTS + 1)]
        v = [[ahead[s][c] + t / (t + 3) * (ahead[s][c] - w[s][c]) for c in range(k)] for s in range(SLOTS + 1)]
        w = ahead
    return (lambda text: proba(w, scaled(plain_features(text)))), losses


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(k, t, y) for k, (t, y) in enumerate(rows)], "id int, txt string, y int")


@pytest.mark.parametrize("classes", [2, 3])
def test_equals_plain_python(spark, classes):
    model, losses = CL.fit_classifier(frame(spark), "txt", F.col("y"), classes, passes=6, slots=SLOTS)
    want, plain_losses = plain_fit(ROWS, classes, 6)
    assert np.allclose(losses, plain_losses, rtol=1e-9)
    texts = [t for t, _ in ROWS] + ["never seen words", "BAD plain " * 200]
    assert np.allclose(model()(texts), [want(t) for t in texts], rtol=1e-8, atol=1e-10)


def test_loss_falls_and_classes_are_told_apart(spark):
    model, losses = CL.fit_classifier(frame(spark), "txt", F.col("y"), 2, passes=40, slots=1 << 10)
    assert losses[-1] < 0.6 * losses[0]
    p = model()(["bad bad words", "good plain text"])
    assert p[0, 1] > 0.5 > p[1, 1]


def test_scores_do_not_depend_on_the_batch(spark, monkeypatch):
    model, _ = CL.fit_classifier(frame(spark), "txt", F.col("y"), 2, passes=3, slots=SLOTS)
    texts = [t for t, _ in ROWS]
    whole = model()(texts)
    monkeypatch.setattr(CL, "RUN_WORDS", 1)
    assert np.array_equal(whole, model()(texts)) and np.array_equal(whole[3:4], model()(texts[3:4]))


def test_truncation_is_a_parameter(spark):
    cut, _ = CL.fit_classifier(frame(spark), "txt", F.col("y"), 2, passes=3, slots=SLOTS, max_tokens=2)
    p = cut()(["good plain bad bad bad", "good plain"])
    assert np.allclose(p[0], p[1])


def test_versioned_table(spark, tmp_path):
    a, _ = CL.fit_classifier(frame(spark), "txt", F.col("y"), 2, passes=2, slots=SLOTS)
    b, _ = CL.fit_classifier(frame(spark), "txt", F.col("y"), 2, passes=4, slots=SLOTS, max_tokens=9)
    table = str(tmp_path / "model")
    for m in (a, b):
        CL.save_model(spark, m, table)
        got = CL.load_model(spark, table)
        assert np.array_equal(got.weights, m.weights) and np.array_equal(got.idf, m.idf) and got.max_tokens == m.max_tokens
        assert got.cache_key == m.cache_key


def test_models_are_interchangeable_in_the_score_columns(spark):
    d = frame(spark)
    two, _ = CL.fit_classifier(d, "txt", F.col("y"), 2, passes=3, slots=SLOTS)
    three, _ = CL.fit_classifier(d, "txt", F.col("y"), 3, passes=3, slots=SLOTS)
    for m, at in ((two, 1), (three, 0), (MD.LengthScorer(), 1)):
        got = [r.p for r in d.select("id", MD.class_probability(F.col("txt"), m, at).alias("p")).orderBy("id").collect()]
        assert np.allclose(got, m()([t or "" for t, _ in ROWS])[:, at])
        s = d.select(MD.post_scores(F.col("txt"), F.lit(""), m, at).alias("s")).select("s.*").collect()
        assert len(s) == len(ROWS) and all(r.sentiment_text == 0 for r in s)


def test_no_labelled_rows(spark):
    model, losses = CL.fit_classifier(frame(spark, [("a", None)]), "txt", F.col("y"), 2, slots=SLOTS)
    assert losses == [] and np.allclose(model()(["a", None]), 0.5)


def test_work_is_cut_into_bounded_runs(spark, monkeypatch):
    import pandas as pd
    from cohortlens.operators import classifier as CL
    from cohortlens.operators import models as MD
    assert list(CL.runs_of([3, 3, 9, 1, 1], 6)) == [(0, 2), (2, 3), (3, 5)] and not list(CL.runs_of([], 6))
    seen = []

    def predict(texts):
        seen.append(sum(map(len, texts)))
        return MD.LengthScorer()()(texts)
    monkeypatch.setattr(MD, "RUN_CHARS", 10)
    texts = pd.Series(["abcdef", None, "xyz", " ", "a" * 25, "bb"])
    got = MD._scores(predict, texts, 1)
    assert list(got) == [0.06, 0.0, 0.03, 0.0, 0.25, 0.02] and len(seen) > 2 and sorted(seen)[-2] <= 10
