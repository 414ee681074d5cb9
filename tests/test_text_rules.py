"""F5 Treebank tokens on hand cases, D5 sentiment rule by rule and against plain Python."""

import math
import re

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import sentiment as SE
from cohortlens.functions import treebank as TB

CASES = {
    "Good muffins cost $3.88 in New York.": "Good muffins cost $ 3.88 in New York .",
    "Please buy me two of them.": "Please buy me two of them .",
    "They'll save and invest more.": "They 'll save and invest more .",
    "hi, my name can't hello,": "hi , my name ca n't hello ,",
    "I don't know": "I do n't know", "We're here": "We 're here", "I've gone": "I 've gone", "I'm in": "I 'm in",
    "He'd go": "He 'd go", "It's John's": "It 's John 's", "the dogs' bowl": "the dogs ' bowl",
    "Is it? Yes!": "Is it ? Yes !", '"Quoted" words': "`` Quoted '' words", 'say "this" now': "say `` this '' now",
    "(in brackets)": "( in brackets )", "[a] {b} <c>": "[ a ] { b } < c >", "wait... what": "wait ... what",
    "a--b": "a -- b", "10:30, 1,000": "10:30 , 1,000", "one: two": "one : two", "semi; colon": "semi ; colon",
    "you & me @ 5%": "you & me @ 5 %", "cannot go": "can not go", "gonna wanna": "gon na wan na", "gimme lemme": "gim me lem me",
    "e.g. this": "e.g. this", "end.)": "end . )", "café déjà 42": "café déjà 42", "": "", "   ": "",
    "SHOULDN'T": "SHOULD N'T", "no.1 item": "no.1 item",
}


def test_treebank_hand_cases(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*CASES, None])], "id int, t string")
    got = [r.x for r in df.select("id", TB.treebank_tokens(F.col("t")).alias("x")).orderBy("id").collect()]
    assert got == [c.split() for c in CASES.values()] + [[]]


def test_sentence_tokens_keep_each_final_period(spark):
    df = spark.createDataFrame([(["A b.", "C d."],), ([],)], "s array<string>")
    assert [r.x for r in df.select(TB.sentence_tokens(F.col("s")).alias("x")).collect()] == [["A", "b", ".", "C", "d", "."], []]


LEX = (("good", 2.0), ("bad", -2.5), ("fine", 0.8))


def plain(text, lex=dict(LEX), mods=SE.Modifiers()):
    words = re.findall("[A-Za-z']+", text or "")
    up = [bool(re.match(SE.UPPER, w)) for w in words]
    low = [w.lower() for w in words]
    mixed = any(up) and not all(up)
    boosters = dict(mods.boosters)
    but = next((i for i, w in enumerate(low) if w in mods.contrast), None)
    sign = lambda x: (x > 0) - (x < 0)
    total = 0.0
    for i, w in enumerate(low):
        if w not in lex:
            continue
        v = lex[w]
        if mixed and up[i]:
            v += sign(v) * SE.CAPITALS
        for d in (1, 2, 3):
            if i < d or low[i - d] in lex:
                continue
            b = boosters.get(low[i - d], 0.0)
            if b and mixed and up[i - d]:
                b += sign(b) * SE.CAPITALS
            v += (-b if v < 0 else b) * SE.DISTANCE[d - 1]
            if low[i - d] in mods.negations:
                v *= SE.NEGATION
        if but is not None:
            v *= SE.BEFORE_BUT if i < but else SE.AFTER_BUT if i > but else 1
        total += v
    q = (text or "").count("?")
    stress = min((text or "").count("!"), 4) * SE.EXCLAMATION + (SE.MANY_QUESTIONS if q > 3 else q * SE.QUESTION if q > 1 else 0)
    total += sign(total) * stress
    return total / math.sqrt(total * total + SE.SCALE)


TEXTS = ["good", "not good", "it is not really good", "very good", "so very really good", "GOOD day", "GOOD DAY", "VERY good",
         "good but bad", "bad but good", "good!", "good!!!!!!", "good?", "good??", "good?????", "never so bad", "hardly bad",
         "good bad fine", "not x y z good", "not x y good", "good not", "BAD news, not GOOD!", "", None, "no words of it",
         "don't say good", "bad very good", "but", "but good but bad"]


def scores(spark, how):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "id int, txt string")
    return [r.compound for r in how(df).orderBy("id").collect()]


def literal(df):
    return df.select("id", SE.compound(F.col("txt"), LEX).alias("compound"))


def test_every_rule_against_plain_python(spark):
    got = scores(spark, literal)
    for t, a in zip(TEXTS, got):
        assert math.isclose(a, plain(t), abs_tol=1e-12), t


def test_rules_move_the_score_the_right_way(spark):
    s = dict(zip(TEXTS, scores(spark, literal)))
    assert s["not good"] < 0 < s["good"] < s["very good"] < s["so very really good"]
    assert s["VERY good"] > s["very good"] and s["GOOD day"] > s["good"] == s["GOOD DAY"]
    assert s["good"] < s["good!"] < s["good!!!!!!"] and s["good?"] == s["good"] < s["good??"] < s["good?????"]
    assert s["good but bad"] < s["bad but good"] and s["never so bad"] > 0 > s["hardly bad"]
    assert s["not x y good"] < 0 < s["not x y z good"] and s[""] == s[None] == s["no words of it"] == 0


def test_lexicon_table_gives_the_same(spark):
    lex = spark.createDataFrame(LEX, "word string, valence double")
    assert scores(spark, lambda df: SE.with_table_compound(df, "id", "txt", lex)) == scores(spark, literal)


def test_a_large_lexicon_is_not_a_literal():
    with pytest.raises(ValueError):
        SE.compound(F.lit("x"), [(f"w{k}", 1.0) for k in range(SE.LITERAL + 1)])
