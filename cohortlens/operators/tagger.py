"""Hidden Markov part-of-speech tagger.

States are the lexicon's tags.  A token is observed as a *symbol*: every listed word
(pronouns, stop words) is its own, any other word is its suffix class with its first
letter, so the tables have a fixed size whatever the vocabulary.  The model starts
from the suffix rules (``start_model``) and is re-estimated from all texts
(``fit_tagger``): tasks run forward-backward over their pieces and send one row of
summed expected counts; only these sums, of the model's size, reach the driver.

A text's tokens are cut into pieces of ``PIECE`` tokens, each tagged on its own, so
the work and the state stay linear in the text's length.  ``hmm_tagger`` gives the best
path (Viterbi) as an Arrow function that steps through the places of many pieces at
once, to be passed as ``tagger`` to ``text.with_text_arrays``.  Both also take the
lower-cased text itself: its tokens are then cut in the task, from the bytes, so no
array of words is stored or sent to it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..params import Lexicon
from ..session import materialize, ship_package

PIECE = 32
BLOCK = 4096    # pieces that a task works on together
RUN_BYTES = 1 << 24
LETTERS = 26


@dataclass(frozen=True)
class TagModel:
    """``first`` (tags), ``move`` (tag x next tag), ``emit`` (symbol x tag): probabilities."""
    tags: tuple
    first: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def tag_names(lex: Lexicon) -> tuple:
    return tuple(dict.fromkeys(("PRP", *(t for _, t in lex.suffix_tags), lex.default_tag)))


def listed_words(lex: Lexicon) -> tuple:
    return tuple(dict.fromkeys((*lex.pronouns, *lex.stop_words)))


def rule_tags(lex: Lexicon) -> list[str]:
    """The tag that the suffix rules give every symbol."""
    own = ["PRP" if w in lex.pronouns else next((t for s, t in lex.suffix_tags if w.endswith(s)), lex.default_tag)
           for w in listed_words(lex)]
    return own + [t for t in (*(t for _, t in lex.suffix_tags), lex.default_tag) for _ in range(LETTERS)]


def symbol_of(token: Column, lex: Lexicon) -> Column:
    """Symbol number of a lower-cased token."""
    words = listed_words(lex)
    e = F.lit(len(words)) + F.pmod(F.ascii(token) - F.lit(97), F.lit(LETTERS))
    kind = F.lit(len(lex.suffix_tags))
    for k in range(len(lex.suffix_tags) - 1, -1, -1):
        kind = F.when(token.endswith(lex.suffix_tags[k][0]), F.lit(k)).otherwise(kind)
    listed = F.array_position(F.array(*[F.lit(w) for w in words]), token) if words else F.lit(0)
    return F.when(listed > 0, listed.cast("int") - 1).otherwise((e + kind * LETTERS).cast("int"))


def start_model(lex: Lexicon, trust: float = 0.9) -> TagModel:
    """Emissions follow the suffix rules with weight ``trust``, transitions are near
    uniform; small fixed differences keep the tags apart."""
    tags, rules = tag_names(lex), rule_tags(lex)
    t, s = len(tags), len(rules)
    tilt = lambda a, b, m: 1 + 0.01 * ((a + b) % m)
    emit = np.array([[(trust if rules[k] == tags[j] else (1 - trust) / max(1, t - 1)) * tilt(7 * k, 3 * j, 11)
                      for j in range(t)] for k in range(s)])
    move = np.array([[tilt(5 * i, 3 * j, 7) for j in range(t)] for i in range(t)])
    first = np.array([tilt(3 * j, 0, 5) for j in range(t)])
    return TagModel(tags, first / first.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def symbol_numbers(words: pa.Array, lex: Lexicon) -> np.ndarray:
    """``symbol_of`` of an Arrow array, in a task."""
    words = words.cast(pa.large_string())
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
    chars = np.append(np.frombuffer(words.buffers()[2] or b"", np.uint8), 0).astype(np.uint8)
    first = np.where(np.diff(ends) > 0, chars[ends[:-1]], 0).astype(np.int32)
    for k in np.flatnonzero(first > 127):  # beyond ASCII: the code point
        first[k] = ord(words[int(k)].as_py()[0])
    kind = np.full(len(words), len(lex.suffix_tags), np.int32)
    for k in range(len(lex.suffix_tags) - 1, -1, -1):
        kind[pc.ends_with(words, lex.suffix_tags[k][0]).to_numpy(zero_copy_only=False)] = k
    out = len(listed_words(lex)) + (first - 97) % LETTERS + kind * LETTERS
    listed = pc.index_in(words, pa.array(listed_words(lex), words.type)).fill_null(-1).to_numpy()
    return np.where(listed >= 0, listed, out).astype(np.int16)


def words_of(texts: pa.Array) -> pa.ListArray:
    """``text.tokens`` of an Arrow array of lower-cased texts: the runs of bytes a-z,
    which are never part of a longer character.  A null text has no words."""
    texts = texts.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]] if len(texts) else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    letter = (data - np.uint8(97)) < 26
    fresh = np.zeros(len(data) + 1, bool)   # no letter before, or another text
    fresh[0] = True
    fresh[1:len(data)] = ~letter[:-1]
    fresh[ends] = True
    begin = np.flatnonzero(letter & fresh[:-1])
    # letters before each word, the words' places in the letters alone
    at = np.append(np.cumsum(letter)[begin] - 1 if len(begin) else np.zeros(0, np.int64), letter.sum())
    words = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data[letter]))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(begin, ends), pa.int32()), words.cast(pa.string()))


def text_runs(col: pa.Array):
    """Slices of an Arrow column of about ``RUN_BYTES`` bytes each, one row at least."""
    n = max(1, min(len(col), -(-col.nbytes // RUN_BYTES)))
    for k in range(n):
        lo, hi = len(col) * k // n, len(col) * (k + 1) // n
        if hi > lo:
            yield col.slice(lo, hi - lo)


def piece_blocks(symbols: np.ndarray, lens: np.ndarray):
    """The pieces of texts of ``lens`` symbols, the longest first, in blocks of at most
    ``BLOCK``: (places of the block's pieces x ``PIECE`` in ``symbols``, their lengths)."""
    n = -(-lens // PIECE)
    text = np.repeat(np.arange(len(lens)), n)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    begin = (np.cumsum(lens) - lens)[text] + nth * PIECE
    size = np.minimum(lens[text] - nth * PIECE, PIECE)
    order = np.argsort(-size, kind="stable")
    for k in range(0, len(order), BLOCK):
        at = order[k:k + BLOCK]
        yield np.minimum(begin[at][:, None] + np.arange(PIECE), len(symbols) - 1), size[at]


def _live(lens: np.ndarray) -> np.ndarray:
    """How many pieces, the longest first, hold each place."""
    return (lens[None, :] > np.arange(lens.max(initial=0))[:, None]).sum(axis=1)


def expected_counts(symbols: np.ndarray, lens: np.ndarray, m: TagModel):
    """Forward-backward over padded pieces (rows of ``symbols``): expected counts of
    first tags, moves and emissions, and the log likelihood.  Pieces run the longest
    first, so those that hold a place are the first rows."""
    order = np.argsort(-lens, kind="stable")
    live = _live(lens)
    longest, t = len(live), len(m.tags)
    sym = np.ascontiguousarray(symbols[order, :longest].T)
    f = [None] * longest
    scale = [None] * longest
    for at in range(longest):
        k = live[at]
        x = m.first * m.emit[sym[at, :k]] if at == 0 else (f[at - 1][:k] @ m.move) * m.emit[sym[at, :k]]
        scale[at] = x.sum(axis=1, keepdims=True)
        f[at] = x / scale[at]
    b = np.ones((len(lens), t))
    move, emit = np.zeros((t, t)), np.zeros((len(m.emit), t))
    for at in range(longest - 1, -1, -1):
        if at + 1 < longest:
            k = live[at + 1]
            ahead = m.emit[sym[at + 1, :k]] * b[:k] / scale[at + 1]
            move += m.move * (f[at][:k].T @ ahead)
            b[:k] = ahead @ m.move.T
        k = live[at]
        gamma = f[at] * b[:k]
        for j in range(t):
            emit[:, j] += np.bincount(sym[at, :k], gamma[:, j], len(emit))
    first = (f[0] * b[:live[0]]).sum(axis=0) if longest else np.zeros(t)
    return first, move, emit, float(sum(np.log(x).sum() for x in scale))


def best_tags(symbols: np.ndarray, lens: np.ndarray, m: TagModel) -> np.ndarray:
    """The best path (tag numbers) of each padded piece, the longest first; of equal
    ones the tag named first in the model."""
    with np.errstate(divide="ignore"):
        first, move, emit = (np.where(x > 0, np.log(x), -1e300) for x in (m.first, m.move, m.emit))
    live = _live(lens)
    longest, t = len(live), len(m.tags)
    sym = np.ascontiguousarray(symbols[:, :longest].T)
    emit = np.ascontiguousarray(emit.T)
    v = [first[j] + emit[j][sym[0]] for j in range(t)] if longest else []
    out = np.zeros((longest, len(lens)), np.int8)
    back = np.zeros((longest, t, len(lens)), np.int8)
    done = np.zeros(len(lens), np.int8)

    def last(lo, hi):  # the pieces that end here
        best = v[0][lo:hi]
        for j in range(1, t):
            more = v[j][lo:hi] > best
            done[lo:hi][more] = j
            best = np.where(more, v[j][lo:hi], best)
    for at in range(1, longest):
        k, was = live[at], live[at - 1]
        last(k, was)
        into = []
        for j in range(t):
            best, via = v[0][:k] + move[0, j], back[at, j, :k]
            for i in range(1, t):
                x = v[i][:k] + move[i, j]
                via[x > best] = i
                np.maximum(best, x, out=best)
            into.append(best + emit[j][sym[at, :k]])
        v = into
    if longest:
        last(0, live[-1])
    for at in range(longest - 1, -1, -1):
        k = live[at]
        out[at, :k] = done[:k]
        if at:
            done[:k] = back[at, done[:k], np.arange(k)]
    return out.T


def fit_tagger(df: DataFrame, tokens: str, lex: Lexicon, passes: int = 3, prior: float = 0.1,
               model: TagModel | None = None) -> tuple[TagModel, list[float]]:
    """The model after ``passes`` re-estimations over all texts of ``df`` and the log
    likelihood before each.  ``tokens`` names the token arrays or the lower-cased texts.  ``prior`` counts are added to every cell; without them
    the log likelihood never falls."""
    ship_package(df.sparkSession)
    m = model or start_model(lex)
    t, s = len(m.tags), len(m.emit)

    def number(batches):
        for col in (c for b in batches for c in text_runs(b.column(0))):
            sym, lens = _column_symbols(col, lex)
            got = [(sym[at].astype(np.int16), size.astype(np.int16)) for at, size in piece_blocks(sym, lens)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k].tobytes() for x in got], pa.binary()) for k in (0, 1)], ["s", "n"])
    of_text = isinstance(df.schema[tokens].dataType, StringType)
    some = F.length(tokens) > 0 if of_text else F.size(tokens) > 0
    rows = materialize(df.select(F.col(tokens)).filter(some).mapInArrow(number, "s binary, n binary"), "tagger-pieces")
    trace = []
    for _ in range(passes):
        now = m

        def run(batches):
            total = np.zeros(t + t * t + s * t + 1)
            for b in batches:
                for sym, lens in zip(*(b.column(c) for c in (0, 1))):
                    lens = np.frombuffer(lens.as_buffer(), np.int16).astype(np.int64)
                    sym = np.frombuffer(sym.as_buffer(), np.int16).reshape(-1, PIECE)
                    a, mv, e, ll = expected_counts(sym, lens, now)
                    total += np.concatenate([a, mv.ravel(), e.ravel(), [ll]])
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["at", "x"])
        got = rows.mapInArrow(run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).orderBy("at").collect()
        x = np.array([r["x"] for r in got]) if got else np.zeros(t + t * t + s * t + 1)
        trace.append(float(x[-1]))
        first, move = x[:t] + prior, x[t:t + t * t].reshape(t, t) + prior
        emit = x[t + t * t:-1].reshape(s, t) + prior
        if not x[:t].sum():
            break  # no tokens at all: the model stays
        rows_ = move.sum(axis=1, keepdims=True)
        cols = emit.sum(axis=0)
        m = TagModel(m.tags, first / first.sum(), np.where(rows_ > 0, move / np.where(rows_ > 0, rows_, 1), m.move),
                     np.where(cols > 0, emit / np.where(cols > 0, cols, 1), m.emit))
    return m, trace


def _column_symbols(col, lex: Lexicon):
    """(symbols of all tokens, tokens a row) of an Arrow column of token arrays or of
    lower-cased texts; a null is empty."""
    if not pa.types.is_list(col.type):
        col = words_of(col)
    lens = np.asarray(col.value_lengths().fill_null(0)).astype(np.int64)
    return symbol_numbers(col.flatten(), lex), lens


def _ship() -> None:
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    if spark is not None:
        ship_package(spark)


def word_cutter():
    """``lower-cased text column -> tokens column``: ``text.tokens`` as an Arrow function,
    for plans that tag the same text (both run in one call of the task's worker)."""
    _ship()

    @F.arrow_udf("array<string>")
    def cut(col: pa.Array) -> pa.Array:
        return pa.concat_arrays([words_of(c) for c in text_runs(col)] or [words_of(col)])
    return cut


def hmm_tagger(m: TagModel, lex: Lexicon):
    """``tokens column -> tags column``: the best tag sequence of every piece, all
    pieces of a batch step by step together.  A column of lower-cased texts is taken
    in place of the tokens."""
    _ship()

    def tags_of(col: pa.Array) -> pa.Array:
        sym, lens = _column_symbols(col, lex)
        found = np.zeros(len(sym), np.int8)
        for at, size in piece_blocks(sym, lens):
            inside = np.arange(PIECE)[None, :size.max()] < size[:, None]
            found[at[:, :size.max()][inside]] = best_tags(sym[at], size, m)[inside]
        tags = pa.DictionaryArray.from_arrays(pa.array(found), pa.array(m.tags, pa.string())).cast(pa.string())
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lens)), pa.int32()), tags)

    @F.arrow_udf("array<string>")
    def tag(col: pa.Array) -> pa.Array:
        return pa.concat_arrays([tags_of(c) for c in text_runs(col)] or [tags_of(col)])
    return tag
