"""Forward-backward and the best path against enumeration of all tag sequences."""

import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortlens.functions import text as T
from cohortlens.operators import tagger as G
from cohortlens.params import FIXTURE_LEXICON as LEX

WORDS = ["it", "the", "that", "running", "nation", "badly", "cat", "dog", "zebra", "of", "xyz"]


def sentences(n=12, longest=6):
    r = np.random.default_rng(4)
    return [list(r.choice(WORDS, int(r.integers(1, longest + 1)))) for _ in range(n)]


def symbols(spark, rows):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(rows)], "k int, toks array<string>")
    out = df.select("k", F.transform("toks", lambda t: G.symbol_of(t, LEX)).alias("s")).orderBy("k").collect()
    return [r.s for r in out]


def paths(m, s):
    """(probability, tags) of every tag sequence of the symbols ``s``."""
    for z in itertools.product(range(len(m.tags)), repeat=len(s)):
        p = m.first[z[0]] * m.emit[s[0], z[0]]
        for a, b, o in zip(z, z[1:], s[1:]):
            p *= m.move[a, b] * m.emit[o, b]
        yield p, z


def test_symbols_follow_the_rules(spark):
    got = symbols(spark, [WORDS])[0]
    rules = G.rule_tags(LEX)
    assert [rules[s] for s in got] == ["PRP", "XX", "PRP", "VBG", "NN", "RB", "XX", "XX", "XX", "XX", "XX"]
    assert max(got) < len(rules) and got[6] != got[7]


def test_expected_counts_equal_enumeration(spark):
    m = G.start_model(LEX)
    rows = sentences(6, 4)
    sym = symbols(spark, rows)
    pad = np.zeros((len(rows), G.PIECE), int)
    for k, s in enumerate(sym):
        pad[k, :len(s)] = s
    first, move, emit, ll = G.expected_counts(pad, np.array([len(s) for s in sym]), m)
    f, a, e, want = np.zeros_like(first), np.zeros_like(move), np.zeros_like(emit), 0.0
    for s in sym:
        every = list(paths(m, s))
        total = sum(p for p, _ in every)
        want += math.log(total)
        for p, z in every:
            f[z[0]] += p / total
            for x, y in zip(z, z[1:]):
                a[x, y] += p / total
            for o, x in zip(s, z):
                e[o, x] += p / total
    assert math.isclose(ll, want, rel_tol=1e-10)
    for got, exact in ((first, f), (move, a), (emit, e)):
        assert np.allclose(got, exact, atol=1e-10)


def test_best_path_equals_enumeration(spark):
    rows = sentences()
    df = spark.createDataFrame([(k, x) for k, x in enumerate(rows)], "k int, toks array<string>")
    m, _ = G.fit_tagger(df, "toks", LEX, 2)
    tagged = df.select("k", G.hmm_tagger(m, LEX)(F.col("toks")).alias("t")).orderBy("k").collect()
    for s, row in zip(symbols(spark, rows), tagged):
        best = max(p for p, _ in paths(m, s))
        z = [m.tags.index(t) for t in row.t]
        p = next(p for p, y in paths(m, s) if list(y) == z)
        assert math.isclose(p, best, rel_tol=1e-9)


@pytest.mark.parametrize("prior", [0.0, 0.1])
def test_likelihood_never_falls(spark, prior):
    df = spark.createDataFrame([(x,) for x in sentences(40, 50)] + [([],), (None,)], "toks array<string>")
    m, ll = G.fit_tagger(df, "toks", LEX, 6, prior)
    assert len(ll) == 6 and ll[-1] > ll[0]
    if not prior:
        assert all(b >= a - 1e-9 * abs(a) for a, b in zip(ll, ll[1:]))
    assert np.allclose(m.move.sum(axis=1), 1) and np.allclose(m.emit.sum(axis=0), 1) and math.isclose(m.first.sum(), 1)


def test_as_the_tagger_of_with_text_arrays(spark):
    long = " ".join(WORDS * 9)
    df = spark.createDataFrame([(1, long), (2, ""), (3, None), (4, "it")], "id int, txt string")
    m = G.start_model(LEX)
    out = {r.id: r for r in T.with_text_arrays(df, "txt", LEX, tagger=G.hmm_tagger(m, LEX)).collect()}
    assert len(out[1]._tags) == len(out[1]._toks) == 99 and set(out[1]._tags) <= set(m.tags)
    assert out[2]._tags == [] and out[3]._tags == [] and len(out[4]._tags) == 1
    rule = {r.id: r for r in T.with_text_arrays(df, "txt", LEX).collect()}  # the suffix form stays the default
    assert rule[4]._tags == ["PRP"]


def test_empty_table_keeps_the_start(spark):
    df = spark.createDataFrame([], "toks array<string>")
    m, _ = G.fit_tagger(df, "toks", LEX, 2)
    assert np.array_equal(m.move, G.start_model(LEX).move)


def test_pieces_of_one_batch_are_tagged_like_single_ones(spark):
    # lengths around the piece and the block, nulls and empty texts between them
    r = np.random.default_rng(9)
    rows = [list(r.choice(WORDS, n)) for n in (1, 31, 32, 33, 64, 0, 200, 5)] + [None] + [list(r.choice(WORDS, 40)) for _ in range(60)]
    m = G.start_model(LEX)
    df = spark.createDataFrame(list(enumerate(rows)), "k int, toks array<string>").coalesce(1)
    was, G.BLOCK = G.BLOCK, 7
    try:
        sym = [G.symbol_numbers(pa.array(x or [], pa.string()), LEX) for x in rows]
        assert [list(x) for x in sym] == [x or [] for x in symbols(spark, rows)]
        got = {x.k: x.t for x in df.select("k", G.hmm_tagger(m, LEX)(F.col("toks")).alias("t")).collect()}
        for k, s in enumerate(sym):
            want = [m.tags[z] for a in range(0, len(s), G.PIECE)
                    for z in G.best_tags(np.pad(s[a:a + G.PIECE], (0, max(0, G.PIECE - len(s[a:])))).reshape(1, -1), np.array([len(s[a:a + G.PIECE])]), m)[0]]
            assert got[k] == want
        flat, lens = np.concatenate(sym), np.array([len(s) for s in sym])
        blocks = list(G.piece_blocks(flat, lens))
        assert max(len(n) for _, n in blocks) <= 7 and sum(int(n.sum()) for _, n in blocks) == len(flat)
    finally:
        G.BLOCK = was


def test_numbers_in_tasks_are_those_of_the_expression(spark):
    words = [*WORDS, "", "\u00e9t\u00e9ing", "\u4e2dly", "tion", "ing", "thing", "zly"]
    whole = pa.array(["x", *words, "y"], pa.string())
    assert list(G.symbol_numbers(whole.slice(1, len(words)), LEX)) == symbols(spark, [words])[0]
    assert len(G.symbol_numbers(pa.array([], pa.string()), LEX)) == 0


def test_best_path_is_no_expression_per_token(spark):
    df = spark.createDataFrame([(["it"],)], "toks array<string>")
    plan = df.select(G.hmm_tagger(G.start_model(LEX), LEX)(F.col("toks")).alias("t"))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "zip_with" not in plan


@pytest.mark.parametrize("part", [(0, None), (3, None), (5, 400), (0, 0)])
def test_words_of_bytes_are_the_tokens(part):
    """Words cut from the bytes of a column, sliced or not, are the pattern's."""
    rnd = random.Random(7)
    texts = ["", None, "abc", "a b", " a", "é a-bé", "ab", "cd", None, "x"] + [
        "".join(rnd.choice("ab -éz\n9ж") for _ in range(rnd.randrange(30))) for _ in range(1000)]
    col = pa.array(texts).slice(*part)
    assert G.words_of(col).to_pylist() == [re.findall("[a-z]+", x or "") for x in col.to_pylist()]


def test_tagger_takes_texts_for_tokens(spark):
    """Training and best path from the lower-cased text equal those from its token arrays."""
    texts = ["I am Here, running quickly", None, "", "é! we're  going-home", "you and they walked " * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, txt string") \
        .select("id", F.lower("txt").alias("low"), T.tokens("txt").alias("toks"))
    of_text, trace_text = G.fit_tagger(df, "low", LEX, 2)
    of_toks, trace_toks = G.fit_tagger(df, "toks", LEX, 2)
    assert np.allclose(of_text.emit, of_toks.emit) and np.allclose(of_text.move, of_toks.move)
    assert np.allclose(trace_text, trace_toks)
    got = df.select("id", "toks", G.word_cutter()(F.col("low")).alias("cut"), G.hmm_tagger(of_toks, LEX)(F.col("low")).alias("a"),
                    G.hmm_tagger(of_toks, LEX)(F.col("toks")).alias("b")).collect()
    assert len(got) == len(texts) and all(r["cut"] == r["toks"] and r["a"] == r["b"] for r in got)
