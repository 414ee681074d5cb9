"""Queries: the hidden Markov tagger (D6) and what uses it.

The oracle repeats the training in SQL: forward-backward and the best path are
recursive common tables that step through the places of all pieces at once.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import aggregates as A
from ..operators import scores as S
from ..operators import tagger as G
from ..params import ADVERB_TAGS, FIXTURE_LEXICON as LEX, NOUN_TAGS, PRONOUN_TAGS, VERB_TAGS, PosScoreWeights
from ..session import materialize
from . import sqltext as Q
from . import views as V
from .catalog import query

PASSES, PRIOR = 3, 0.1
TAGS = G.tag_names(LEX)
N = range(len(TAGS))


def _each(text: str, sep: str = ", ") -> str:
    return sep.join(text.replace("#", str(j)) for j in N)


def _symbol_sql(t: str) -> str:
    words = G.listed_words(LEX)
    listed = " ".join(f"when '{w}' then {k}" for k, w in enumerate(words))
    kinds = " ".join(f"when suffix({t}, '{s}') then {k}" for k, (s, _) in enumerate(LEX.suffix_tags))
    return (f"case {t} {listed} else {len(words)} + (ascii({t}) - 97) % {G.LETTERS}"
            f" + {G.LETTERS} * (case {kinds} else {len(LEX.suffix_tags)} end) end")


def _training_sql() -> str:
    m = G.start_model(LEX)
    emit = ", ".join(f"({s}, {', '.join(repr(float(x)) for x in row)})" for s, row in enumerate(m.emit))
    move = ", ".join(f"{float(m.move[i, j])!r} m{i}{j}" for i in N for j in N)
    first = ", ".join(f"{float(m.first[j])!r} p{j}" for j in N)
    steps = [f"""recursive x0 as materialized (select *, {Q.tokens('txt')} toks from (
  select *, {Q.post_text('title', 'selftext')} txt from xtexts)),
sq as materialized (select id, tok, pos, pos // {G.PIECE} piece, pos % {G.PIECE} loc, {_symbol_sql('tok')} s
  from (select id, unnest(toks) tok, unnest(range(len(toks))) pos from x0)),
ends as materialized (select id, piece, max(loc) loc from sq group by all),
e0 as materialized (select * from (values {emit}) v(s, {_each('e#')})),
p0 as materialized (select {first}, {move})"""]
    total = _each("u#", " + ")
    for p in range(PASSES):
        into = ", ".join(f"({' + '.join(f'w.f{i} * m{i}{j}' for i in N)}) * e{j} u{j}" for j in N)
        out = ", ".join(f"({' + '.join(f'm{i}{j} * q.e{j} * w.b{j}' for j in N)}) / c b{i}" for i in N)
        pairs = ", ".join(f"sum(f.f{i} * m{i}{j} * q.e{j} * b.b{j} / n.c) + {PRIOR} x{i}{j}" for i in N for j in N)
        norm = ", ".join(f"x{i}{j} / ({' + '.join(f'x{i}{k}' for k in N)}) m{i}{j}" for i in N for j in N)
        steps.append(f"""
q{p} as materialized (select * from sq join e{p} using (s)),
f{p} as (
  select id, piece, loc, c, {_each('u# / c f#')} from (select *, {total} c from (
    select id, piece, loc, {_each('p# * e# u#')} from q{p}, p{p} where loc = 0))
  union all
  select id, piece, loc, c, {_each('u# / c f#')} from (select *, {total} c from (
    select q.id, q.piece, q.loc, {into} from f{p} w join q{p} q on q.id = w.id and q.piece = w.piece and q.loc = w.loc + 1, p{p}))),
fm{p} as materialized (select * from f{p}),
b{p} as (
  select id, piece, loc, {_each('1.0::double b#')} from ends
  union all
  select w.id, w.piece, w.loc - 1, {out}
  from b{p} w join q{p} q on q.id = w.id and q.piece = w.piece and q.loc = w.loc
  join fm{p} f on f.id = w.id and f.piece = w.piece and f.loc = w.loc, p{p} where w.loc > 0),
bm{p} as materialized (select * from b{p}),
g{p} as materialized (select s, loc, {_each('f# * b# g#')} from fm{p} join bm{p} using (id, piece, loc) join sq using (id, piece, loc)),
c{p} as materialized (select {pairs} from fm{p} f join q{p} q on q.id = f.id and q.piece = f.piece and q.loc = f.loc + 1
  join fm{p} n on n.id = q.id and n.piece = q.piece and n.loc = q.loc
  join bm{p} b on b.id = q.id and b.piece = q.piece and b.loc = q.loc, p{p}),
h{p} as (select {_each(f'sum(g#) + {PRIOR} x#')} from g{p} where loc = 0),
e{p + 1} as materialized (select s, {_each('x# / sum(x#) over () e#')} from (
  select e0.s, {_each(f'coalesce(sum(g#), 0.0) + {PRIOR} x#')} from e0 left join g{p} using (s) group by e0.s)),
p{p + 1} as materialized (select {_each('x# / t p#')}, {norm}
  from (select *, {_each('x#', ' + ')} t from h{p}), c{p})""")
    return "with " + ",".join(steps)


def _path_sql() -> str:
    """``tg`` (id, tok, pos, tag): the best path under the last parameters."""
    cand = ", ".join(f"[{', '.join(f'w.v{i} + ln(m{i}{j})' for i in N)}] l{j}" for j in N)
    return f"""{_training_sql()},
qv as materialized (select * from sq join e{PASSES} using (s)),
vt as (
  select id, piece, loc, {_each('ln(p#) + ln(e#) v#')}, {_each('0::bigint k#')} from qv, p{PASSES} where loc = 0
  union all
  select id, piece, loc, {_each('list_max(l#) + ln(e#) v#')}, {_each('cast(list_position(l#, list_max(l#)) as bigint) k#')} from (
    select q.*, {cand} from vt w join qv q on q.id = w.id and q.piece = w.piece and q.loc = w.loc + 1, p{PASSES})),
vm as materialized (select id, piece, loc, [{_each('v#')}] v, [{_each('k#')}] k from vt),
bt as (
  select id, piece, loc, cast(list_position(v, list_max(v)) as bigint) tag, k from vm join ends using (id, piece, loc)
  union all
  select m.id, m.piece, m.loc, w.k[w.tag], m.k from bt w join vm m on m.id = w.id and m.piece = w.piece and m.loc = w.loc - 1),
tg as materialized (select sq.id, tok, pos, [{', '.join(f"'{t}'" for t in TAGS)}][tag] tag
  from bt join sq using (id, piece, loc))"""


def _xtexts(spark, sf):
    """Texts, also lower-cased: their tokens are cut where they are needed."""
    x = V.xtexts(spark, sf).withColumn("txt", T.post_text("title", "selftext"))
    return x.select("id", "cohort", "community_grp", "txt", F.lower("txt").alias("_low"))


def _tagged(spark, sf):
    x = materialize(_xtexts(spark, sf).drop("_low"), "tagger-texts")  # read by the training and by the tagging
    x = x.withColumn("_low", F.lower("txt"))
    model, _ = G.fit_tagger(x, "_low", LEX, PASSES, PRIOR)
    # one projection: tokens and tags of a text come from one call of the worker
    return x.select("id", "cohort", "community_grp", "txt", G.word_cutter()(F.col("_low")).alias("_toks"),
                    G.hmm_tagger(model, LEX)(F.col("_low")).alias("_tags"))


@query("hmm_model", "D6", f"""{_training_sql()}
select tag, next_tag, round(p, 6) probability from ({' union all '.join(
    f"select '{TAGS[i]}' tag, '{TAGS[j]}' next_tag, m{i}{j} p from p{PASSES}" for i in N for j in N)})""")
def hmm_model(spark, sf):
    """Transition probabilities after the training passes over all texts."""
    m, _ = G.fit_tagger(_xtexts(spark, sf), "_low", LEX, PASSES, PRIOR)
    rows = [(a, b, float(m.move[i, j])) for i, a in enumerate(m.tags) for j, b in enumerate(m.tags)]
    return spark.createDataFrame(rows, "tag string, next_tag string, probability double")


@query("hmm_tag_tokens", "D6", f"{_path_sql()}\nselect id, tag, count(*) n from tg group by all")
def hmm_tag_tokens(spark, sf):
    return A.exploded_counts(_tagged(spark, sf), ["id"], F.col("_tags"), "tag")


@query("hmm_pos_counts", "A13 D6", f"""{_path_sql()}
select cohort, community_grp, tag, count(*) n from tg join x0 using (id) group by all""")
def hmm_pos_counts(spark, sf):
    return A.exploded_counts(_tagged(spark, sf), ["cohort", "community_grp"], F.col("_tags"), "tag")


def _per_text_sql() -> str:
    prp = f"tag in {Q.lit_list(PRONOUN_TAGS)}"
    person = {"first_person_singular": LEX.first_singular, "first_person_plural": LEX.first_plural, "second_person": LEX.second_person}
    counts = [f"count(*) filter (tag in {Q.lit_list(v)}) {k}" for k, v in
              (("num_nouns", NOUN_TAGS), ("num_verbs", VERB_TAGS), ("num_adverbs", ADVERB_TAGS))]
    counts += [f"count(*) filter ({prp} and tok in {Q.lit_list(v)}) {k}_pronouns" for k, v in person.items()]
    return f"""{_path_sql()},
per as (select id, {', '.join(counts)}, count(*) filter ({prp}) prps from tg group by id),
ft as (select x0.id, cohort, community_grp, txt, toks, len(toks) words, coalesce(prps, 0) prps,
  {', '.join(f'coalesce({k}, 0) {k}' for k in ('num_nouns', 'num_verbs', 'num_adverbs', *(f'{p}_pronouns' for p in person)))},
  prps0 - first0 third_person_pronouns
  from x0 left join (select *, prps prps0, {' + '.join(f'{p}_pronouns' for p in person)} first0 from per) per using (id))"""


def _share(n: str, d: str) -> str:
    return f"round(coalesce(cast({n} as double) / nullif(cast({d} as double), 0), 0.0), 6)"


@query("hmm_text_features", "D9 D6", f"""{_per_text_sql()}
select id, cohort, community_grp, num_nouns, num_verbs, num_adverbs, first_person_singular_pronouns,
  first_person_plural_pronouns, second_person_pronouns, coalesce(third_person_pronouns, 0) third_person_pronouns,
  {', '.join(f"{_share(f'num_{k}s', 'words')} {k}_ratio" for k in ('noun', 'verb', 'adverb'))},
  {', '.join(f"{_share(f'{k}_pronouns', 'prps')} {k}_ratio" for k in
             ('first_person_singular', 'first_person_plural', 'second_person', 'third_person'))},
  round({Q.fk_grade('txt', 'toks')}, 6) readability_score, {Q.keyword('txt', LEX.keywords)} keyword_score,
  cast(words as bigint) text_length
from ft""")
def hmm_text_features(spark, sf):
    x = _tagged(spark, sf)
    feats = T.language_features("txt", F.col("_toks"), F.col("_tags"), LEX)
    return x.select("id", "cohort", "community_grp", *[c.alias(k) for k, c in feats.items()])


_W = PosScoreWeights()


@query("hmm_pos_score", "D8 D6", f"""{_per_text_sql()}
select id, cohort, community_grp, case when not {Q.is_blank('txt')} then round(
  {_W.noun_ratio} * coalesce(cast(num_nouns as double) / nullif(words, 0), 0.0)
  + {_W.first_person_singular_ratio} * coalesce(cast(first_person_singular_pronouns as double) / nullif(words, 0), 0.0)
  + {_W.keyword_score} * cast({Q.keyword('txt', LEX.keywords)} as int) + {_W.text_length} * words, 6) end pos_score
from ft""")
def hmm_pos_score(spark, sf):
    x = _tagged(spark, sf)
    return x.select("id", "cohort", "community_grp", S.pos_score("txt", F.col("_toks"), F.col("_tags"), LEX).alias("pos_score"))
