"""Model adaptors.

A *scorer* is a user-supplied factory: ``factory() -> predict`` where
``predict(list[str]) -> numpy array (n_texts, n_classes)`` of probabilities.
The factory runs once per Python worker (cached), the texts arrive in Arrow
batches through iterator pandas UDFs, and only the scores come back to the JVM.
The engine ships no trained model; ``LengthScorer`` / ``LengthEmotionScorer``
are deterministic formula scorers used by the tests and fixture queries.
"""

from __future__ import annotations

from typing import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from ..params import EMOTION_LABELS

_CACHE: dict[object, Callable] = {}
RUN_CHARS = 1 << 22     # characters of texts that a scorer gets at once, one text at least


def _ship() -> None:
    """Make this package importable by the Python workers of the active session."""
    from pyspark.sql import SparkSession
    from ..session import ship_package
    spark = SparkSession.getActiveSession()
    if spark is not None:
        ship_package(spark)


def _cache_key(factory) -> object:
    """Identity of a scorer across tasks: every task unpickles its own copy of
    the factory, so the key is the factory's class and state (or an explicit
    ``cache_key`` attribute), not the object id."""
    explicit = getattr(factory, "cache_key", None)
    if explicit is not None:
        return explicit
    state = getattr(factory, "__dict__", None)
    return (type(factory).__module__, type(factory).__qualname__, repr(sorted(state.items())) if state else repr(factory)
            if not hasattr(factory, "__dict__") else "")


def _predictor(factory) -> Callable:
    """The loaded model, once per Python worker process (workers are reused
    across tasks), not once per task."""
    key = _cache_key(factory)
    if key not in _CACHE:
        _CACHE[key] = factory()
    return _CACHE[key]


def _blank(texts: Sequence[str]) -> np.ndarray:
    return np.array([len(t.translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).strip(" ")) == 0 for t in texts])


def _text(t) -> str:
    return t if isinstance(t, str) else "" if pd.isna(t) else str(t)


def _scores(predict, column, index: int, blank_zero: bool = False, size: int | None = None) -> np.ndarray:
    """The scores of ``size`` texts (null: empty), scored in runs of bounded length, so
    the memory follows the run, not the batch.  ``blank_zero``: blank ones score 0."""
    out = np.empty(len(column) if size is None else size)
    run, held, begin = [], 0, 0

    def score(end):
        out[begin:end] = predict(run)[:, index]
        if blank_zero:
            out[begin:end][_blank(run)] = 0.0
    for k, t in enumerate(column):
        t = _text(t)
        if run and held + len(t) > RUN_CHARS:
            score(k)
            run, held, begin = [], 0, k
        run.append(t)
        held += len(t)
    if run:
        score(len(out))
    return out


class LengthScorer:
    """Formula stand-in for a 2-class classifier: p1 = (len(text) % 101) / 100,
    0 for blank text; returns [1 - p1, p1]."""

    def __call__(self):
        def predict(texts: Sequence[str]) -> np.ndarray:
            n = np.array([len(t) for t in texts], dtype=np.int64)
            p = (n % 101) / 100.0
            p[_blank(texts)] = 0.0
            return np.stack([1.0 - p, p], axis=1)
        return predict


class LengthEmotionScorer:
    """Formula stand-in for the 7-emotion model: p_i = ((len(text) + i) % 7) / 21."""

    def __call__(self):
        def predict(texts: Sequence[str]) -> np.ndarray:
            n = np.array([len(t) for t in texts], dtype=np.int64)
            return np.stack([((n + i) % 7) / 21.0 for i in range(len(EMOTION_LABELS))], axis=1)
        return predict


def class_probability(text: Column, factory, index: int = 1) -> Column:
    """Probability of class ``index`` for each text (null text -> '')."""
    _ship()

    @pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict = _predictor(factory)
        for s in batches:
            yield pd.Series(_scores(predict, s, index), dtype="float64")
    return score(text)


def post_scores(title: Column, selftext: Column, factory, index: int = 1,
                zero_blank_each: bool = False) -> Column:
    """D3: three scores for a post in one function: title, selftext (0 when blank),
    and title + ' ' + selftext; ``zero_blank_each`` zeroes any blank text."""
    _ship()

    @pandas_udf("sentiment_title double, sentiment_text double, sentiment_complex double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        predict = _predictor(factory)
        for t, s in batches:
            both = (f"{_text(a)} {_text(b)}" for a, b in zip(t, s))
            yield pd.DataFrame({"sentiment_title": _scores(predict, t, index, zero_blank_each),
                                "sentiment_text": _scores(predict, s, index, True),
                                "sentiment_complex": _scores(predict, both, index, zero_blank_each, len(t))})
    return score(title, selftext)


def emotion_vector(text: Column, factory) -> Column:
    """Probability vector (fixed label order) for non-blank text; null otherwise."""
    _ship()

    @pandas_udf("array<double>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict = _predictor(factory)
        for s in batches:
            texts = s.fillna("").astype(str).tolist()
            if not texts:
                yield pd.Series([], dtype=object)
                continue
            probs = predict(texts)
            blank = _blank(texts)
            yield pd.Series([None if b else row.tolist() for row, b in zip(probs, blank)])
    return score(text)


def emotions_long(df: DataFrame, key: str, vec: str, labels: Sequence[str] = EMOTION_LABELS) -> DataFrame:
    """(key, label, p) rows via ``posexplode`` against the label array."""
    lab = F.array(*[F.lit(x) for x in labels])
    e = df.select(key, F.posexplode(vec).alias("pos", "p"))
    return e.select(key, F.element_at(lab, F.col("pos") + 1).alias("label"), "p")
