"""Queries: grouped aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.tags import cell_code, cell_parts
from ..operators import aggregates as A
from ..operators import relational as R
from ..params import FIXTURE_GROUPS, FIXTURE_LEXICON as LEX
from . import sqltext as Q
from . import views as V
from ..session import materialize
from .catalog import query

TOK = Q.tokens("txt")
TAGS = Q.tags("toks", LEX)


def _xtext(spark, sf):
    """Text posts with the assembled text, token and tag arrays."""
    x = V.xtexts(spark, sf).withColumn("txt", T.post_text("title", "selftext"))
    return T.with_text_arrays(x, "txt", LEX)


XTEXT_SQL = f"""xt as (select *, {TAGS} tags from (
  select *, {TOK} toks from (select *, {Q.post_text('title', 'selftext')} txt from xtexts)))"""


@query("distinct_users", "A1 U1", """
select distinct author from (select author from posts union all select author from replies)
where author is not null""")
def distinct_users(spark, sf):
    return A.distinct_values((V.posts(spark, sf), "author"), (V.replies(spark, sf), "author"))


@query("community_having", "A2", """
select community, count(*) n from replies group by community having count(*) > 4000""")
def community_having(spark, sf):
    return A.count_having(V.replies(spark, sf), "community", 4000)


@query("community_users", "A3", """
select community, count(distinct author) unique_users from replies group by community""")
def community_users(spark, sf):
    return A.distinct_per_key(V.replies(spark, sf), "community", "author", "unique_users")


@query("weighted_sums", "A4", """
select author, sum(coalesce(sentiment_complex * 2.0, 0.0)) total_score, sum(2.0) total_weight
from posts group by author""")
def weighted_sums(spark, sf):
    return A.weighted_sums(V.posts(spark, sf), "author", "sentiment_complex", 2.0)


@query("mean_of_means", "A5 P6", """
with k as (
  select 'post' kind, author, community_grp, cohort, sentiment_complex s from cposts
   where author is distinct from '[deleted]'
  union all
  select 'reply' kind, author, community_grp, cohort, sentiment s from creplies
   where author is distinct from '[deleted]'),
m as (select kind, author, community_grp, cohort, avg(s) m from k group by all)
select author, community_grp, cohort, round(avg(m), 6) mean_sentiment from m group by all""")
def mean_of_means(spark, sf):
    tp, tr = V.tposts(spark, sf), V.treplies(spark, sf)
    p = tp.select("author", "community_grp", F.col("sentiment_complex").alias("s"))
    r = tr.select("author", "community_grp", F.col("sentiment").alias("s"))
    u = R.drop_sentinel(R.union_activity(p, r))
    # the cohort is constant per author: attach it to the (author, group) means, not to rows
    m = A.mean_of_means(u, ["author", "community_grp"], "kind", "s", "mean_sentiment")
    return m.join(V.cohorts_of(tp, tr), on="author", how="inner")


@query("activity_ratio", "A6", """
with k as (select 'post' kind, author, community_grp, cohort from cposts
           union all select 'reply' kind, author, community_grp, cohort from creplies),
per as (select cohort, kind, author, count(*) t,
               count(*) filter (where community_grp = 'SW') sw,
               count(*) filter (where community_grp = 'MH') mh,
               count(*) filter (where community_grp = 'Otr') ot from k group by all),
a as (select cohort, avg(sw / t) sw, avg(mh / t) mh, avg(ot / t) ot from per group by cohort),
l as (select unnest(['SW', 'MH', 'Otr']) cohort)
select l.cohort,
  case when l.cohort = 'Otr' then 0.0 else round(coalesce(a.sw, 0.0), 6) end "SW",
  case when l.cohort = 'Otr' then 0.0 else round(coalesce(a.mh, 0.0), 6) end "MH",
  case when l.cohort = 'Otr' then 1.0 else round(coalesce(a.ot, 0.0), 6) end "Otr"
from l left join a on l.cohort = a.cohort""")
def activity_ratio(spark, sf):
    tp, tr = V.tposts(spark, sf), V.treplies(spark, sf)
    p = tp.select("author", "community_grp")
    r = tr.select("author", "community_grp")
    return A.activity_ratio(R.union_activity(p, r), FIXTURE_GROUPS, cohorts=V.cohorts_of(tp, tr))


@query("user_cohort", "A7", "select author, cohort from cohorts")
def user_cohort(spark, sf):
    return V.cohorts(spark, sf)


@query("group_mean", "A8", """
select cohort, community_grp, round(avg(sentiment), 6) mean_score from creplies group by all""")
def group_mean(spark, sf):
    # rows -> (author, group) partial sums -> cohort attached -> cell means
    return A.cell_means(V.reply_cells(spark, sf), ["cohort", "community_grp"])


@query("daily_group_avg", "A9", """
select cast(created_day as varchar) created_day, community_grp, round(avg(score), 6) avg_score
from tev group by all""")
def daily_group_avg(spark, sf):
    e = V.tev(spark, sf).withColumn("created_day", F.col("created_day").cast("string"))
    return A.daily_group_avg(e, "created_day", "community_grp", "score")


@query("daily_counts", "A10", """
select author, cast(created_day as varchar) created_day, count(*) activity_count from ev group by all""")
def daily_counts(spark, sf):
    e = V.ev(spark, sf).withColumn("created_day", F.col("created_day").cast("string"))
    return A.daily_counts(e)


@query("monthly_contacts", "A11", """
with k as (select author, month, null::varchar partner, community_grp, cohort from cposts
           union all select author, month, partner, community_grp, cohort from creplies)
select author, month, count(*) interactions, count(distinct partner) partners,
       count(distinct community_grp) "groups", min(cohort) cohort
from k group by author, month""")
def monthly_contacts(spark, sf):
    p = V.tposts(spark, sf).select("author", "month", F.lit(None).cast("string").alias("partner"), "community_grp")
    r = V.treplies(spark, sf).select("author", "month", "partner", "community_grp")
    return A.monthly_contacts(p.unionByName(r), grp_labels=FIXTURE_GROUPS.labels, cohorts=V.cohorts(spark, sf))


@query("user_rollup", "A12 D5", f"""
with k as (select author, body txt from turns
           union all select author, {Q.post_text('title', 'selftext')} txt from docs),
s as (select author, txt, {Q.compound(Q.tokens('txt'), LEX)} sent from k)
select author, cast(sum(length(coalesce(txt, '')) + 1) as bigint) text_chars,
       round(sum(sent), 6) sentiment_sum, count(*) n_texts, round(avg(sent), 6) avg_sentiment
from s group by author""")
def user_rollup(spark, sf):
    t = V.turns(spark, sf).select("author", F.col("body").alias("txt"))
    d = V.docs(spark, sf).select("author", T.post_text("title", "selftext").alias("txt"))
    k = t.unionByName(d)
    k = k.withColumn("sent", T.compound_sentiment(T.tokens("txt"), LEX))
    return A.user_rollup(k, "author", "txt", F.col("sent"))


@query("user_texts", "A12", f"""
with k as (select author, 'reply' kind, id, body txt from turns
           union all select author, 'post', cast(id as varchar), {Q.post_text('title', 'selftext')} from docs)
select author, row_number() over (partition by author order by kind, id, txt) as position, txt from k""")
def user_texts(spark, sf):
    """The texts behind ``user_rollup``, one row each in order."""
    t = V.turns(spark, sf).select("author", F.lit("reply").alias("kind"), "id", F.col("body").alias("txt"))
    d = V.docs(spark, sf).select("author", F.lit("post").alias("kind"), F.col("id").cast("string").alias("id"),
                                 T.post_text("title", "selftext").alias("txt"))
    return A.user_texts(t.unionByName(d), "author", ["kind", "id"], "txt")


PIECE = 5000


@query("user_joined_text", "A12", f"""
with k as (select author, 'reply' kind, id, body txt from turns
           union all select author, 'post', cast(id as varchar), {Q.post_text('title', 'selftext')} from docs),
j as (select author, string_agg(' ' || coalesce(txt, ''), '' order by kind, id, txt) s from k group by author)
select author, piece, substr(s, piece * {PIECE} + 1, {PIECE}) txt
from (select author, s, unnest(range(0, cast(ceil(length(s) / {PIECE}.0) as bigint))) piece from j)""")
def user_joined_text(spark, sf):
    """The joined text per user, in pieces of a bounded number of characters."""
    t = V.turns(spark, sf).select("author", F.lit("reply").alias("kind"), "id", F.col("body").alias("txt"))
    d = V.docs(spark, sf).select("author", F.lit("post").alias("kind"), F.col("id").cast("string").alias("id"),
                                 T.post_text("title", "selftext").alias("txt"))
    return A.joined_text(t.unionByName(d), "author", ["kind", "id"], "txt", PIECE)


@query("pos_counts", "A13 D6", f"""
with {XTEXT_SQL}
select cohort, community_grp, tag, count(*) n from (select cohort, community_grp, unnest(tags) tag from xt)
group by all""")
def pos_counts(spark, sf):
    return A.exploded_counts(_xtext(spark, sf), ["cohort", "community_grp"], F.col("_tags"), "tag")


@query("word_counts", "A14 F7", f"""
with {XTEXT_SQL}
select cohort, community_grp, word, count(*) n
from (select cohort, community_grp, unnest(list_filter(toks, lambda w: w not in {Q.lit_list(LEX.stop_words)})) word
      from xt) group by all""")
def word_counts(spark, sf):
    x = _xtext(spark, sf)
    return A.exploded_counts(x, ["cohort", "community_grp"], T.clean_tokens(F.col("_toks"), LEX), "word")


@query("day_group_text", "A15 A16 F11", f"""
with {XTEXT_SQL},
b as (select cast(created_day as varchar) created_day, cohort, community_grp, toks, tags,
             {Q.reading_ease('txt', 'toks')} ease from xt),
tg as (select created_day, cohort, community_grp, tag, count(*) n
       from (select created_day, cohort, community_grp, unnest(tags) tag from b) group by all),
wd as (select created_day, cohort, community_grp, word, count(*) n
       from (select created_day, cohort, community_grp, unnest(toks) word from b) group by all),
tw as (select created_day, cohort, community_grp, arg_min(word, (-n, word)) word, max(n) freq from wd group by all),
sc as (select created_day, cohort, community_grp, cast(sum(len(toks)) as bigint) text_length,
              round(sum(ease), 6) readability from b group by all)
select tg.created_day, tg.cohort, tg.community_grp, tg.tag, tg.n, coalesce(tw.word, '') word,
       cast(coalesce(tw.freq, 0) as bigint) freq, sc.text_length, sc.readability
from tg join sc using (created_day, cohort, community_grp)
left join tw using (created_day, cohort, community_grp)""")
def day_group_text(spark, sf):
    keys = ["created_day", "cohort", "community_grp"]
    # day and groups as one long: what is counted and sorted by group has a short key
    x = _xtext(spark, sf).withColumn("_cell", cell_code(*keys, FIXTURE_GROUPS))
    # tokens, tags and the per-text readability are computed once and written
    # under the checkpoint folder; the three aggregates below read them
    x = materialize(x.select("_cell", "_toks", "_tags", T.reading_ease("txt", F.col("_toks")).alias("_ease")),
                    "day-group-text")
    tg = A.exploded_counts(x, ["_cell"], F.col("_tags"), "tag")
    wd = A.exploded_counts(x, ["_cell"], F.col("_toks"), "word")
    tw = A.top_item(wd, ["_cell"], "word").withColumnRenamed("n", "freq")
    sc = x.groupBy("_cell").agg(F.sum(F.size("_toks")).cast("bigint").alias("text_length"),
                                F.sum("_ease").alias("readability"))
    day, cohort, grp = cell_parts("_cell", FIXTURE_GROUPS)
    return (tg.join(sc, on="_cell", how="inner").join(tw, on="_cell", how="left")
            .select(day.cast("string").alias("created_day"), cohort.alias("cohort"), grp.alias("community_grp"),
                    "tag", "n", F.coalesce("word", F.lit("")).alias("word"),
                    F.coalesce("freq", F.lit(0)).cast("bigint").alias("freq"), "text_length", "readability"))


@query("top_word", "A16 A14", f"""
with {XTEXT_SQL},
wd as (select cohort, community_grp, word, count(*) n
       from (select cohort, community_grp, unnest(list_filter(toks, lambda w: w not in {Q.lit_list(LEX.stop_words)})) word
             from xt) group by all)
select cohort, community_grp, arg_min(word, (-n, word)) word, max(n) n from wd group by all""")
def top_word(spark, sf):
    x = _xtext(spark, sf)
    wd = A.exploded_counts(x, ["cohort", "community_grp"], T.clean_tokens(F.col("_toks"), LEX), "word")
    return A.top_item(wd, ["cohort", "community_grp"], "word")


@query("histogram", "A17", """
with v as (select cast(sentiment as double) x from replies where sentiment is not null),
mm as (select min(x) lo, max(x) hi from v),
c as (select case when hi = lo then 0 else least(floor((x - lo) / ((hi - lo) / 30.0)), 29) end bin, count(*) n
      from v, mm group by 1),
e as (select unnest(range(0, 30)) bin, lo, hi from mm)
select cast(e.bin as bigint) bin, round(lo + e.bin * ((hi - lo) / 30.0), 6) bin_lo,
       round(lo + (e.bin + 1) * ((hi - lo) / 30.0), 6) bin_hi, cast(coalesce(c.n, 0) as bigint) n
from e left join c on e.bin = c.bin""")
def histogram(spark, sf):
    return A.histogram(V.replies(spark, sf), "sentiment", 30)


@query("value_freq", "A18", "select community, count(*) n from replies group by community")
def value_freq(spark, sf):
    return A.value_freq(V.replies(spark, sf), "community")


@query("scalars", "A19", """
select cast(max(score) as double) max_value, round(quantile_cont(cast(score as double), 0.9), 6) quantile_value
from replies""")
def scalars(spark, sf):
    return A.scalars(V.replies(spark, sf), "score", 0.9)


@query("matrix_totals", "A20", """
select coalesce(cohort, 'ALL') cohort, coalesce(community_grp, 'ALL') community_grp, count(*) n
from creplies group by cube(cohort, community_grp)""")
def matrix_totals(spark, sf):
    return A.matrix_totals(V.reply_cells(spark, sf, None), "cohort", "community_grp", weight="_n")


@query("matrix_mean_all", "A21", """
with c as (select cohort, community_grp, avg(sentiment) m from creplies group by all)
select cohort, community_grp, round(m, 6) mean_score from c
union all
select cohort, 'ALL' community_grp, round(avg(m), 6) mean_score from c group by cohort""")
def matrix_mean_all(spark, sf):
    cells = A.cell_means(V.reply_cells(spark, sf), ["cohort", "community_grp"])
    return A.matrix_mean_all(cells, "cohort", "community_grp", "mean_score", cells_given=True)
