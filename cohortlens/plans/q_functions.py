"""Queries: scalar functions (F1-F16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tags as G
from ..functions import text as T
from ..functions import time as TM
from ..params import FIXTURE_GROUPS, FIXTURE_LEXICON as LEX
from . import sqltext as Q
from . import views as V
from .catalog import query

DOC_TEXT_SQL = Q.post_text("title", "selftext")


def _doc_text(spark, sf):
    d = V.docs(spark, sf).select("id", T.post_text("title", "selftext").alias("txt"))
    return T.with_text_arrays(d, "txt", LEX)


def _doc_sql(select: str) -> str:
    return f"""
with d as (select id, {DOC_TEXT_SQL} txt from docs),
dt as (select *, {Q.tags('toks', LEX)} tags from (select *, {Q.tokens('txt')} toks from d))
select id, {select} from dt"""


# epoch -> UTC day / month; 0, '' and unparsable values stay untagged
_EPOCH_SQL = ("case when try_cast(cast(created_utc as varchar) as bigint) <> 0 "
              "then epoch_ms(try_cast(cast(created_utc as varchar) as bigint) * 1000) end")


@query("tag_day", "F1", f"select id, strftime({_EPOCH_SQL}, '%Y-%m-%d') as created_day from posts")
def tag_day(spark, sf):
    return V.posts(spark, sf).select("id", TM.day_tag(F.col("created_utc")).alias("created_day"))


@query("tag_month", "F2", f"select link_id as id, strftime({_EPOCH_SQL}, '%Y-%m') as month from replies")
def tag_month(spark, sf):
    return V.replies(spark, sf).select(F.col("link_id").alias("id"), TM.month_tag(F.col("created_utc")).alias("month"))


_RAW_EPOCH_SQL = ("case score when 0 then '0' when 1 then 'x' when 2 then '' when 3 then null "
                  "else cast(created_utc as varchar) end")


@query("month_rejects", "F2", f"""
with e as (select link_id id, {_RAW_EPOCH_SQL} epoch from replies),
w as (select *, case when epoch is null or trim(epoch) = '' then 'missing'
                     when try_cast(epoch as bigint) is null then 'not a number'
                     when try_cast(epoch as bigint) = 0 then 'zero' end reason from e)
select reason, count(*) n, min(id) first_id from w where reason is not null group by reason""")
def month_rejects(spark, sf):
    """Rows that get no month, counted by reason (the scores stand in for bad epochs)."""
    raw = F.when(F.col("score") == 0, "0").when(F.col("score") == 1, "x").when(F.col("score") == 2, "") \
        .when(F.col("score") != 3, F.col("created_utc").cast("string"))
    r = V.replies(spark, sf).select(F.col("link_id").alias("id"), TM.epoch_reject(raw).alias("reason"))
    return r.filter("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"),
                                                                F.min("id").alias("first_id"))


@query("tag_community_grp", "F3", "select id, community, community_grp from tposts")
def tag_community_grp(spark, sf):
    return V.posts(spark, sf).select("id", "community", G.community_group("community", FIXTURE_GROUPS)
                                     .alias("community_grp"))


@query("assemble_text", "F4", f"""
select 'post' kind, cast(id as varchar) id, {DOC_TEXT_SQL} txt from docs
union all
select 'reply' kind, id, coalesce(body, '') txt from turns""")
def assemble_text(spark, sf):
    d = V.docs(spark, sf).select(F.lit("post").alias("kind"), F.col("id").cast("string").alias("id"),
                                 "title", "selftext", F.lit(None).cast("string").alias("body"))
    t = V.turns(spark, sf).select(F.lit("reply").alias("kind"), "id", F.lit(None).cast("string").alias("title"),
                                  F.lit(None).cast("string").alias("selftext"), "body")
    u = d.unionByName(t)
    return u.select("kind", "id", T.assemble_text("kind", "title", "selftext", "body").alias("txt"))


@query("tokens", "F5", _doc_sql("cast(len(toks) as bigint) n_tokens, array_to_string(toks, ' ') tokens"))
def tokens(spark, sf):
    d = _doc_text(spark, sf)
    return d.select("id", F.size("_toks").cast("bigint").alias("n_tokens"),
                    F.array_join("_toks", " ").alias("tokens"))


@query("sentences", "F6", _doc_sql(f"cast({Q.n_sentences('txt')} as bigint) n_sentences"))
def sentences(spark, sf):
    d = V.docs(spark, sf).select("id", T.post_text("title", "selftext").alias("txt"))
    return d.select("id", F.size(T.sentences("txt")).cast("bigint").alias("n_sentences"))


@query("clean_tokens", "F7", _doc_sql(
    f"cast(len(list_filter(toks, lambda w: w not in {Q.lit_list(LEX.stop_words)})) as bigint) n_clean, "
    f"array_to_string(list_filter(toks, lambda w: w not in {Q.lit_list(LEX.stop_words)}), ' ') clean"))
def clean_tokens(spark, sf):
    d = _doc_text(spark, sf)
    c = T.clean_tokens(F.col("_toks"), LEX)
    return d.select("id", F.size(c).cast("bigint").alias("n_clean"), F.array_join(c, " ").alias("clean"))


@query("pos_ratios", "F8 D6", _doc_sql(", ".join(f"round({v}, 6) {k}" for k, v in
                                                Q.pos_ratio_cols("toks", "tags").items())))
def pos_ratios(spark, sf):
    d = _doc_text(spark, sf)
    return d.select("id", *[c.alias(k) for k, c in T.pos_ratios(F.col("_toks"), F.col("_tags")).items()])


@query("pronoun_shares", "F9", _doc_sql(", ".join(
    (f"round({v}, 6) {k}" if k.endswith("ratio") else f"{v} {k}")
    for k, v in Q.pronoun_cols("toks", LEX).items())))
def pronoun_shares(spark, sf):
    d = _doc_text(spark, sf)
    return d.select("id", *[c.alias(k) for k, c in T.pronoun_features(F.col("_toks"), F.col("_tags"), LEX).items()])


@query("keyword_flag", "F10", _doc_sql(f"{Q.keyword('txt', LEX.keywords)} keyword_score"))
def keyword_flag(spark, sf):
    d = V.docs(spark, sf).select("id", T.post_text("title", "selftext").alias("txt"))
    return d.select("id", T.keyword_flag("txt", LEX.keywords).alias("keyword_score"))


@query("readability", "F11", _doc_sql(
    f"round({Q.fk_grade('txt', 'toks')}, 6) fk_grade, round({Q.reading_ease('txt', 'toks')}, 6) reading_ease"))
def readability(spark, sf):
    d = _doc_text(spark, sf)
    return d.select("id", T.fk_grade("txt", F.col("_toks")).alias("fk_grade"),
                    T.reading_ease("txt", F.col("_toks")).alias("reading_ease"))


@query("log_scale", "F12 A9", """
with a as (select cast(created_day as varchar) created_day, community_grp, avg(score) avg_score from tev group by all)
select created_day, community_grp, round(avg_score, 6) avg_score,
       round(case when avg_score + 1e-9 > 0 then ln(avg_score + 1e-9) end, 6) log_score from a""")
def log_scale(spark, sf):
    a = V.tev(spark, sf).groupBy(F.col("created_day").cast("string").alias("created_day"), "community_grp") \
        .agg(F.avg("score").alias("avg_score"))
    return a.withColumn("log_score", TM.log_scale(F.col("avg_score")))


@query("decay", "F13 W3", """
with d as (select author, created_day, count(*) n from ev group by all),
m as (select max(created_day) mx from d)
select author, cast(created_day as varchar) created_day, n,
       round(exp(-0.05 * cast(date_diff('day', created_day, mx) as double)), 6) decay from d, m""")
def decay(spark, sf):
    from ..operators import windows as W
    d = V.ev(spark, sf).groupBy("author", "created_day").agg(F.count(F.lit(1)).alias("n"))
    d = W.days_ago(d)
    return d.select("author", F.col("created_day").cast("string").alias("created_day"), "n",
                    TM.decay(F.col("days_ago"), 0.05).alias("decay"))


@query("split_name", "F14", """
with n as (select distinct concat(community_grp, '-com-', month) name from treplies
           union select distinct concat(community_grp, '-sub-', month) name from tposts)
select name, split_part(name, '-', 1) grp, split_part(name, '-', 2) type,
       cast(cast(try_strptime(nullif(regexp_extract(name, '(\\d{4}-\\d{2})', 1), '') || '-01', '%Y-%m-%d')
            as date) as varchar) as month
from n""")
def split_name(spark, sf):
    r = V.treplies(spark, sf).select(F.concat("community_grp", F.lit("-com-"), "month").alias("name"))
    p = V.tposts(spark, sf).select(F.concat("community_grp", F.lit("-sub-"), "month").alias("name"))
    n = r.union(p).distinct()
    g, t, m = TM.split_name(F.col("name"))
    return n.select("name", g.alias("grp"), t.alias("type"), m.cast("string").alias("month"))


@query("zero_rule", "F15", """
select link_id, parent_id, author, score, is_submitter,
       case when score = 0 then 2.0 else cast(score as double) end s_write,
       case when score = 0 then (case when coalesce(is_submitter, false) then -1.0 else 1.0 end)
            else cast(score as double) end s_report
from replies""")
def zero_rule(spark, sf):
    r = V.replies(spark, sf)
    k = F.lit("reply")
    return r.select("link_id", "parent_id", "author", "score", "is_submitter",
                    G.zero_rule(F.col("score"), k, "write").alias("s_write"),
                    G.zero_rule(F.col("score"), k, "report", is_submitter=F.col("is_submitter")).alias("s_report"))


@query("safe_score", "F16", """
with raw as (select id, parent_id raw from ev union all select id, community raw from ev)
select id, raw, try_cast(coalesce(raw, '0') as bigint) parsed,
       try_cast(coalesce(raw, '0') as bigint) is not null ok from raw""")
def safe_score(spark, sf):
    e = V.ev(spark, sf)
    raw = e.select("id", F.col("parent_id").alias("raw")).union(e.select("id", F.col("community").alias("raw")))
    parsed = G.safe_bigint(F.col("raw"), default=0)
    return raw.select("id", "raw", parsed.alias("parsed"), parsed.isNotNull().alias("ok"))
