"""Lexicon sentiment that knows negation and emphasis.

Each lexicon word's valence is changed by what stands around it, in the published order
of rules: capitals in a text of mixed case, then for one to three words back a booster
(weaker with distance) and a negation, then a contrasting "but"; exclamation and
question marks stress the sum, which is scaled to s / sqrt(s^2 + 15).

The scan is a fold over the three distances inside a transform over the words, without
Python.  A lexicon of at most ``LITERAL`` words is a constant map; a larger one is a
table (``with_table_compound``), joined to the distinct words of the texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the published rules
CAPITALS = 0.733
NEGATION = -0.74
DISTANCE = (1.0, 0.95, 0.9)
BEFORE_BUT, AFTER_BUT = 0.5, 1.5
EXCLAMATION, EXCLAMATIONS = 0.292, 4
QUESTION, QUESTIONS, MANY_QUESTIONS = 0.18, 3, 0.96
SCALE = 15.0
BOOST = 0.293
# end of fixed values
LITERAL = 512
WORDS = "[A-Za-z']+"
UPPER = "^[A-Z']*[A-Z][A-Z']+$"


@dataclass(frozen=True)
class Modifiers:
    """Boosters (word, change), negations and contrasting words, lower case."""
    boosters: tuple = (("absolutely", BOOST), ("completely", BOOST), ("extremely", BOOST), ("really", BOOST), ("so", BOOST),
                       ("very", BOOST), ("almost", -BOOST), ("barely", -BOOST), ("hardly", -BOOST), ("slightly", -BOOST))
    negations: tuple = ("cannot", "can't", "don't", "doesn't", "didn't", "isn't", "never", "no", "nor", "not", "nothing",
                        "wasn't", "without", "won't")
    contrast: tuple = ("but",)


FIXTURE_MODIFIERS = Modifiers(boosters=(("in", BOOST), ("a", -BOOST)), negations=("is",), contrast=("that",))


def _map(pairs) -> Column:
    return F.create_map(*[F.lit(x) for w, v in pairs for x in (w, float(v))])


def _in(words, x: Column) -> Column:
    return F.array_contains(F.array(*[F.lit(w) for w in words]), x) if words else F.lit(False)


def _once(x: Column, f) -> Column:
    """``f(x)`` with ``x`` worked out once."""
    return F.transform(F.array(x), f)[0]


def compound_of(text: Column, valence, mods: Modifiers = Modifiers()) -> Column:
    """The compound score; ``valence`` maps a lower-cased word (column) to its
    valence, null for words outside the lexicon.  0 for a text without lexicon words."""
    t = F.coalesce(text, F.lit(""))
    boosters = _map(mods.boosters) if mods.boosters else None

    def marks(c):
        return F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))

    def scored(w):  # w: array<struct<upper, low, v>>
        of_text = F.struct((F.exists(w, lambda x: x["upper"]) & F.exists(w, lambda x: ~x["upper"])).alias("mixed"),
                           F.array_position(F.transform(w, lambda x: _in(mods.contrast, x["low"])), F.lit(True)).alias("but"))
        return _once(of_text, lambda c: summed(w, c["mixed"], c["but"]))

    def summed(w, mixed, but):
        def word(x, i):
            start = F.when(mixed & x["upper"], x["v"] + F.signum(x["v"]) * CAPITALS).otherwise(x["v"])

            def back(v, d):  # what the word d places before does to the valence so far
                def by(b):
                    boost = F.lit(0.0)
                    if boosters is not None:
                        e = F.try_element_at(boosters, b["low"])
                        e = F.when(mixed & b["upper"], e + F.signum(e) * CAPITALS).otherwise(e)
                        boost = F.coalesce(F.when(v < 0, -e).otherwise(e), F.lit(0.0)) * F.element_at(
                            F.array(*[F.lit(x) for x in DISTANCE]), d)
                    return F.when(b["v"].isNotNull(), v).otherwise(
                        (v + boost) * F.when(_in(mods.negations, b["low"]), F.lit(NEGATION)).otherwise(F.lit(1.0)))
                return F.when(i >= d, by(F.element_at(w, F.greatest(i - d, F.lit(0)) + 1))).otherwise(v)
            v = F.aggregate(F.array(*[F.lit(d) for d in (1, 2, 3)]), start, back)
            turn = F.when((but > 0) & (i < but - 1), F.lit(BEFORE_BUT)).when((but > 0) & (i > but - 1), F.lit(AFTER_BUT)) \
                .otherwise(F.lit(1.0))
            return F.when(x["v"].isNull(), F.lit(0.0)).otherwise(v * turn)
        s = F.aggregate(F.transform(w, word), F.lit(0.0), lambda a, b: a + b)
        questions = marks("?")
        stress = F.least(marks("!"), F.lit(EXCLAMATIONS)) * F.lit(EXCLAMATION) + F.when(
            questions > QUESTIONS, F.lit(MANY_QUESTIONS)).when(questions > 1, questions * F.lit(QUESTION)).otherwise(F.lit(0.0))
        return _once(s + F.signum(s) * stress, lambda z: z / F.sqrt(z * z + F.lit(SCALE)))
    words = F.transform(F.regexp_extract_all(t, F.lit(WORDS), 0), lambda w: F.struct(
        w.rlike(UPPER).alias("upper"), F.lower(w).alias("low"), valence(F.lower(w)).cast("double").alias("v")))
    return _once(words, scored)


def compound(text: Column, lexicon, mods: Modifiers = Modifiers()) -> Column:
    """The score under a literal lexicon of (word, valence) pairs."""
    if len(lexicon) > LITERAL:
        raise ValueError(f"a lexicon of more than {LITERAL} words is a table: use with_table_compound")
    m = _map(lexicon) if lexicon else None
    return compound_of(text, (lambda w: F.try_element_at(m, w)) if m is not None else (lambda w: F.lit(None).cast("double")), mods)


def with_table_compound(df: DataFrame, key: str, text: str, lexicon: DataFrame, mods: Modifiers = Modifiers(),
                        name: str = "compound") -> DataFrame:
    """``df`` (one row a ``key``) with the score under a lexicon table (word, valence).
    Only (key, distinct word) pairs meet the table; a text gets back its own words."""
    low = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORDS), 0), F.lower))
    hits = df.select(key, F.explode(low).alias("word")).join(lexicon.select("word", F.col("valence").cast("double")), "word") \
        .groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("word", "valence"))).alias("_lexicon"))
    none = F.create_map().cast("map<string,double>")
    joined = df.join(hits, key, "left").withColumn("_lexicon", F.coalesce("_lexicon", none))
    return joined.withColumn(name, compound_of(F.col(text), lambda w: F.try_element_at(F.col("_lexicon"), w), mods)).drop("_lexicon")


def compound_sql(src: str, lexicon, mods: Modifiers) -> str:
    """Common tables ending in ``cp`` (id, s): the oracle of the relation ``src`` (id, txt)."""
    values = " ".join(f"when '{w}' then {float(v)!r}" for w, v in lexicon)
    boosts = " ".join(f"when '{w}' then {float(v)!r}" for w, v in mods.boosters)
    quoted = lambda ws: "(" + ", ".join(f"'{w}'" for w in ws) + ")"
    steps = ""
    before = "x0"
    for d in (1, 2, 3):
        e = f"(b{d} + case when mixed and u{d} then sign(b{d}) * {CAPITALS} else 0 end)"
        steps += f""",
w{d} as (select *, case when lag(low, {d}) over p is null or lag(v, {d}) over p is not null then x{d - 1}
    else (x{d - 1} + coalesce(case when x{d - 1} < 0 then -{e} else {e} end, 0.0) * {DISTANCE[d - 1]})
      * case when lag(low, {d}) over p in {quoted(mods.negations)} then {NEGATION} else 1.0 end end x{d}
  from (select *, case lag(low, {d}) over p {boosts} end b{d}, lag(upper, {d}) over p u{d} from {'w0' if d == 1 else f'w{d - 1}'}
        window p as (partition by id order by i)) window p as (partition by id order by i))"""
    return f"""ww as (select id, i, w, lower(w) low, regexp_matches(w, '{UPPER.replace(chr(39), chr(39) * 2)}') upper, case lower(w) {values} end v
  from (select id, unnest(ws) w, unnest(range(len(ws))) i from (
    select id, regexp_extract_all(coalesce(txt, ''), '{WORDS.replace(chr(39), chr(39) * 2)}') ws from {src}))),
w0 as (select *, case when mixed and upper then v + sign(v) * {CAPITALS} else v end x0 from (
  select *, bool_or(upper) over q and bool_or(not upper) over q mixed,
         min(case when low in {quoted(mods.contrast)} then i end) over q but_at from ww window q as (partition by id))){steps},
sm as (select id, sum(coalesce(x3, 0.0) * case when i < but_at then {BEFORE_BUT} when i > but_at then {AFTER_BUT} else 1.0 end) s
  from w3 group by id),
mk as (select id, length(coalesce(txt, '')) - length(replace(coalesce(txt, ''), '!', '')) ex,
       length(coalesce(txt, '')) - length(replace(coalesce(txt, ''), '?', '')) qu from {src}),
cp as (select id, coalesce(s, 0.0) + sign(coalesce(s, 0.0)) * (least(ex, {EXCLAMATIONS}) * {EXCLAMATION}
  + case when qu > {QUESTIONS} then {MANY_QUESTIONS} when qu > 1 then qu * {QUESTION} else 0.0 end) s from mk left join sm using (id))"""
