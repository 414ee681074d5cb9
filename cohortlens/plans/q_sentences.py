"""Queries: learned sentence boundaries (F6), Treebank tokens (F5), sentiment with modifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sentiment as SE
from ..functions import text as T
from ..functions import treebank as TB
from ..operators import sentences as SN
from ..params import FIXTURE_LEXICON as LEX
from ..session import materialize
from . import sqltext as Q
from . import views as V
from .catalog import query

ENDS = "[.!?]+[\"'')\\]]*$"


def _ptype(t: str) -> str:
    bare = f"case when suffix(lower({t}), '.') then left(lower({t}), length(lower({t})) - 1) else lower({t}) end"
    return f"(case when regexp_matches({bare}, '{SN.TYPE}') then {bare} end)"


def _wtype(t: str) -> str:
    bare = f"regexp_replace(lower({t}), '^[^a-z]+|[^a-z]+$', '', 'g')"
    return f"(case when regexp_matches({bare}, '^[a-z]+$') then {bare} end)"


def _log(x: str) -> str:
    return f"(case when {x} > 0 then ln({x}) else 0.0 end)"


def _fit(here: str, there: str) -> str:
    return (f"(ab * {_log(here)} + (a - ab) * {_log(f'1 - {here}')} + (cb - ab) * {_log(there)}"
            f" + (nn - a - cb + ab) * {_log(f'1 - {there}')})")


def _learned(best: str) -> str:
    """The texts, their tokens and the learned types; ``best``: the order and limit of these."""
    return f"""with tx as materialized (select cast(id as varchar) id, {Q.post_text('title', 'selftext', False)} txt from docs
  union all select id, body from turns),
tk as materialized (select id, i, t, lag(t) over (partition by id order by i) b, lead(t) over (partition by id order by i) nx
  from (select id, unnest(toks) t, unnest(range(len(toks))) i from (
    select id, list_filter(string_split_regex(coalesce(txt, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') toks from tx))),
tt as materialized (select *, {_ptype('t')} pt, {_wtype('t')} wt from tk),
c1 as (select pt type, count(*) n, cast(count(*) filter (suffix(t, '.')) as bigint) n_period from tt group by pt),
a1 as (select cast(sum(n) as double) nn, cast(sum(n_period) as double) pp from c1),
abbr as materialized (select type, n, n_period,
  -2.0 * ((n_period * {_log('pp / nn')} + (n - n_period) * {_log('1 - pp / nn')})
          - (n_period * ln({SN.ALMOST}) + (n - n_period) * ln({SN.RARE})))
  * exp(-cast(length(replace(type, '.', '')) as double)) * (length(type) - length(replace(type, '.', '')) + 1)
  * pow(cast(length(replace(type, '.', '')) as double), n_period - n) score
  from c1, a1 where type is not null and n_period > 0),
short as materialized (select type from abbr where score >= {SN.ABBREVIATION_SCORE}{best}),
sure as materialized (select *, coalesce(regexp_matches(b, '{ENDS}'), false)
  and not coalesce(suffix(b, '.') and {_ptype('b')} in (select type from short), false) after_end from tt),
c2 as (select wt type, count(*) n, cast(count(*) filter (after_end) as bigint) n_after from sure group by wt),
a2 as (select cast(sum(n) as double) nn, cast(sum(n_after) as double) a from c2),
st0 as (select *, cb / nn p, ab / a p1, coalesce((cb - ab) / nullif(nn - a, 0), 0.0) p2
  from (select type, n, n_after, cast(n as double) cb, cast(n_after as double) ab, nn, a from c2, a2 where type is not null and n_after > 0)),
st as materialized (select type, n, n_after, -2.0 * ({_fit('p', 'p')} - {_fit('p1', 'p2')}) score, p1 > p more from st0),
starts as materialized (select type from st where score >= {SN.STARTER_SCORE} and more{best})"""


_BASE = _learned(f" order by score desc, type limit {SN.MOST}")


def _texts(spark, sf):
    d = V.docs(spark, sf).select(F.col("id").cast("string").alias("id"), T.post_text("title", "selftext", False).alias("txt"))
    return materialize(d.unionByName(V.turns(spark, sf).select("id", F.col("body").alias("txt"))), "sentence-texts")


@query("abbreviations", "F6", f"{_BASE}\nselect type, n, n_period, round(score, 6) score from abbr where score >= {SN.ABBREVIATION_SCORE}")
def abbreviations(spark, sf):
    return SN.abbreviations(_texts(spark, sf), "txt")


@query("sentence_starters", "F6", f"""{_BASE}
select type, n, n_after, round(score, 6) score from st where score >= {SN.STARTER_SCORE} and more""")
def sentence_starters(spark, sf):
    x = _texts(spark, sf)
    return SN.starters(x, "txt", SN.top_types(SN.abbreviations(x, "txt")))


_SPLIT = f"""{_learned('')},
br as (select id, i, t, nx is not null and regexp_matches(t, '{ENDS}') and (
    not (suffix(t, '.') and coalesce(pt in (select type from short), false))
    or (regexp_matches(nx, '^[^a-zA-Z]*[A-Z]') and coalesce({_wtype('nx')} in (select type from starts), false))) ends from tt),
pc as (select id, i, t, coalesce(sum(ends::int) over (partition by id order by i rows between unbounded preceding and 1 preceding), 0) k from br),
ss as (select id, k, string_agg(t, ' ' order by i) s from pc group by id, k)"""


@query("sentences_learned", "F6", f"""{_SPLIT}
select tx.id, cast(count(s) as bigint) n_sentences, cast(coalesce(max(length(s)), 0) as bigint) longest,
       coalesce(md5(string_agg(s, chr(10) order by k)), '') digest
from tx left join (select * from ss where regexp_matches(s, '[A-Za-z0-9]')) using (id) group by tx.id""")
def sentences_learned(spark, sf):
    """Every text's sentences: their number, the longest one's length, a digest of all."""
    x = _texts(spark, sf)
    s = F.col("s")
    x = SN.with_sentences(x, "txt", "s", *SN.learn(x, "txt"))
    return x.select("id", F.size(s).cast("bigint").alias("n_sentences"),
                    F.coalesce(F.array_max(F.transform(s, F.length)), F.lit(0)).cast("bigint").alias("longest"),
                    F.when(F.size(s) > 0, F.md5(F.encode(F.array_join(s, "\n"), "UTF-8"))).otherwise("").alias("digest"))


@query("treebank_tokens", "F5", f"""{_SPLIT},
tb as (select id, k, {TB.tokens_sql('s')} toks from ss where regexp_matches(s, '[A-Za-z0-9]'))
select tx.id, cast(coalesce(sum(len(toks)), 0) as bigint) n_tokens,
       coalesce(md5(string_agg(array_to_string(toks, ' '), ' ' order by k)), '') digest
from tx left join tb using (id) group by tx.id""")
def treebank_tokens(spark, sf):
    """Every text's Treebank tokens, sentence by sentence: their number and a digest."""
    x = _texts(spark, sf)
    x = materialize(SN.with_sentences(x, "txt", "s", *SN.learn(x, "txt")).select("id", "s"), "sentences")
    x = x.select("id", TB.sentence_tokens(F.col("s")).alias("t"))
    return x.select("id", F.size("t").cast("bigint").alias("n_tokens"),
                    F.when(F.size("t") > 0, F.md5(F.encode(F.array_join("t", " "), "UTF-8"))).otherwise("").alias("digest"))


_COMPOUND = f"""with tx as (select cast(id as varchar) id, {Q.post_text('title', 'selftext')} txt from docs
  union all select id, body from turns),
{SE.compound_sql('tx', LEX.valence, SE.FIXTURE_MODIFIERS)}
select id, round(s / sqrt(s * s + {SE.SCALE}), 6) compound from cp"""


def _plain_texts(spark, sf):
    d = V.docs(spark, sf).select(F.col("id").cast("string").alias("id"), T.post_text("title", "selftext").alias("txt"))
    return d.unionByName(V.turns(spark, sf).select("id", F.col("body").alias("txt")))


@query("compound_modifiers", "D5", _COMPOUND)
def compound_modifiers(spark, sf):
    """Compound sentiment of every text with negation, boosters, capitals, contrast and marks."""
    return _plain_texts(spark, sf).select("id", SE.compound(F.col("txt"), LEX.valence, SE.FIXTURE_MODIFIERS).alias("compound"))


@query("compound_table", "D5", _COMPOUND)
def compound_table(spark, sf):
    """The same with the lexicon as a joined table."""
    lexicon = spark.createDataFrame([(w, float(v)) for w, v in LEX.valence], "word string, valence double")
    return SE.with_table_compound(_plain_texts(spark, sf), "id", "txt", lexicon, SE.FIXTURE_MODIFIERS).select("id", "compound")
