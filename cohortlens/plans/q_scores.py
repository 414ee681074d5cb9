"""Queries: composite scores and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models as MD
from ..operators import scores as S
from ..params import RankWeights
from . import views as V
from ..session import materialize, remove
from .catalog import query

RANK = RankWeights()          # study defaults: N = 500, lowest first


@query("sentiment_rank", "D17 P6 A4 J7 J8 K2 W1", """
with u as (
  select author, coalesce(sentiment_complex * 2.0, 0.0) ws, 2.0 w, 1 p from posts
   where author is distinct from '[deleted]' and author is not null
  union all
  select author, coalesce(sentiment * 1.0, 0.0) ws, 1.0 w, 0 p from replies
   where author is distinct from '[deleted]' and author is not null),
g as (select author, sum(ws) / sum(w) score from u group by author having sum(p) > 0),
t as (select author, score from g order by round(score, 9) nulls last, author limit 500)
select cast(row_number() over (order by round(score, 9) nulls last, author) as bigint) as rank,
       author, round(score, 6) as score
from t""")
def sentiment_rank(spark, sf):
    return S.sentiment_rank(V.posts(spark, sf), V.replies(spark, sf), rw=RANK)


# ---------------------------------------------------------------- shared oracle fragments
from ..functions import text as T  # noqa: E402
from ..params import FIXTURE_GROUPS, FIXTURE_LEXICON as LEX  # noqa: E402
from . import sqltext as Q  # noqa: E402
from .q_models import SCORER, _p_sql  # noqa: E402

# D14 (write rule) on fixture replies: authors with a post only
D14_SQL = """d14r as (select *, case when score = 0 then 2.0 else cast(score as double) end s from treplies
              where author in (select author from tposts)),
d14f as (select *, row_number() over (partition by author, community_grp, month, parent_id
                                     order by created_utc, score, is_submitter) rn from d14r),
d14 as (select author, community_grp, month, sum(3.0 * s + case when rn > 1 then 9.0 * s else 0.0 end) graph
        from d14f group by all)"""
# D15 (write rule) on fixture posts
D15_SQL = """d15 as (select author, community_grp, month,
        sum(0.5 * case when score = 0 then -0.5 else cast(score as double) end
            + 0.5 * cast(coalesce(num_comments, 0) as double)) graph from tposts group by all)"""
# D12 over cohort-tagged posts and replies
D12_SQL = """d12u as (select author, month, community_grp, cohort, null::varchar partner from cposts
                      union all select author, month, community_grp, cohort, partner from creplies),
d12g as (select community_grp, author, month, count(*) interactions, count(distinct partner) partners,
                1::bigint "groups", min(cohort) cohort from d12u group by community_grp, author, month),
d12s as (select *, cast(1.0 * interactions + 2.0 * partners + 3.0 * "groups" as double) comm_score from d12g),
d12q as (select community_grp, quantile_cont(comm_score, 0.9) t, min(comm_score) lo0 from d12s group by 1),
d12 as (select s.*, coalesce((least(comm_score, t) - least(lo0, t)) / nullif(t - least(lo0, t), 0), 0.0)
               normalized_score from d12s s join d12q using (community_grp))"""
# D11 per row kind
D11_SQL = """d11c as (select 'post' kind, author, created_day, count(*) activity_count from posts group by all
                      union all select 'reply' kind, author, created_day, count(*) from replies group by all),
d11m as (select kind, max(created_day) mx from d11c group by kind),
d11x as (select c.*, cast(date_diff('day', created_day, mx) as bigint) days_ago,
                activity_count * exp(-0.05 * cast(date_diff('day', created_day, mx) as double)) raw
         from d11c c join d11m using (kind)),
d11mm as (select kind, min(raw) lo, max(raw) hi from d11x group by kind),
d11 as (select kind, author, created_day, activity_count, days_ago,
               coalesce((raw - lo) / nullif(hi - lo, 0), 0.0) time_based from d11x join d11mm using (kind))"""
# D16 per-user month matrix (report rule), users = post authors
D16_SQL = """with us as (select distinct author from cposts),
p16 as (select * from tposts where author in (select author from us)),
r16 as (select *, case when score = 0 then (case when coalesce(is_submitter, false) then -1.0 else 1.0 end)
                  else cast(score as double) end s from treplies where author in (select author from us)),
r16f as (select *, row_number() over (partition by author, community_grp, month, parent_id
                                     order by created_utc, score, is_submitter) rn from r16),
rep as (select author, community_grp, month, 'reply' kind,
               sum(3.0 * s + case when rn > 1 then 9.0 * s else 0.0 end) graph from r16f group by all),
pos as (select author, community_grp, month, 'post' kind,
               sum(0.5 * case when score = 0 then (case when coalesce(num_comments, 0) = 0 then -1.0 else 1.0 end)
                              else cast(score as double) end
                   + 0.5 * cast(coalesce(num_comments, 0) as double)) graph from p16 group by all),
am as (select distinct author, month from (select author, month from p16 union all select author, month from r16)),
cells as (select * from (values ('SW', 'reply'), ('SW', 'post'), ('MH', 'reply'), ('MH', 'post'),
                                ('Otr', 'reply'), ('Otr', 'post')) t(community_grp, kind)),
d16 as (select am.author, am.month, cells.community_grp, cells.kind, coalesce(x.graph, 0.0) graph
        from am cross join cells
        left join (select * from rep union all select * from pos) x
          on x.author = am.author and x.month = am.month and x.community_grp = cells.community_grp
         and x.kind = cells.kind)"""


def _x_text(spark, sf):
    x = V.xtexts(spark, sf).withColumn("txt", T.post_text("title", "selftext"))
    return T.with_text_arrays(x, "txt", LEX)


_XT_SQL = f"""xt as (select *, {Q.tags('toks', LEX)} tags from (
  select *, {Q.tokens('txt')} toks from (select *, {Q.post_text('title', 'selftext')} txt from xtexts)))"""
_FPS_SQL = Q.ratio(Q.count_in(Q.pronoun_words("toks", LEX), LEX.first_singular), "len(toks)")
_POS_SQL = (f"case when not {Q.is_blank('txt')} then 0.0 + -1.5 * {Q.pos_ratio_cols('toks', 'tags')['noun_ratio']}"
            f" + 1.0 * {_FPS_SQL} + 2.0 * cast({Q.keyword('txt', LEX.keywords)} as double)"
            f" + 0.005 * cast(len(toks) as double) end")

# D8 of every text of both kinds, one value an id (documents: the post's id, turns: the reply's parent_id)
_POS_BY_ID_SQL = f"""pt as (select id, {Q.post_text('title', 'selftext')} txt from (
        select cast(id as varchar) id, title, selftext from docs
        union all select id, null title, body selftext from turns)),
pk as (select *, {Q.tags('toks', LEX)} tags from (select *, {Q.tokens('txt')} toks from pt)),
ps as (select id, max({_POS_SQL}) pos from pk group by id)"""


def _pos_by_id(spark, sf):
    d = V.docs(spark, sf).select(F.col("id").cast("string").alias("id"), "title", "selftext")
    t = V.turns(spark, sf).select("id", F.lit(None).cast("string").alias("title"), F.col("body").alias("selftext"))
    x = T.with_text_arrays(d.unionByName(t).select("id", T.post_text("title", "selftext").alias("txt")), "txt", LEX)
    return x.groupBy("id").agg(F.max(S.pos_score("txt", F.col("_toks"), F.col("_tags"), LEX)).alias("pos"))


# D13 of both kinds, each with its own threshold
D13_SQL = """x13 as (select 'post' kind, p.id, p.author, p.community_grp, p.month, p.created_day, sentiment_complex sent,
        d11.time_based, d12.comm_score
      from tposts p
      left join (select * from d11 where kind = 'post') d11 on p.author = d11.author and p.created_day = d11.created_day
      left join d12 on p.author = d12.author and p.community_grp = d12.community_grp and p.month = d12.month
      union all
      select 'reply', r.parent_id, r.author, r.community_grp, r.month, r.created_day, sentiment,
        d11.time_based, d12.comm_score
      from treplies r
      left join (select * from d11 where kind = 'reply') d11 on r.author = d11.author and r.created_day = d11.created_day
      left join d12 on r.author = d12.author and r.community_grp = d12.community_grp and r.month = d12.month),
m13 as (select kind, max(comm_score) mx from x13 group by kind),
d13 as (select x13.*, case when coalesce(mx, 0.0) * 0.5 <> 0
                  then least(coalesce(comm_score, 0.0) / (coalesce(mx, 0.0) * 0.5), 1.0) else 0.0 end
             + case when coalesce(time_based, 0.0) >= 0.01 then coalesce(time_based, 0.0) else 0.0 end time_based_score
        from x13 join m13 using (kind))"""


def _tagged(spark, sf, shared: bool = False):
    """Group-tagged posts and replies.  ``shared``: a composite plan reads them
    in several branches, so they are written once under the checkpoint folder
    (lineage cut; each branch reads files, not the upstream joins)."""
    tp, tr = V.tposts(spark, sf), V.treplies(spark, sf)
    if shared:
        tp = materialize(tp.drop("community", "created_utc"), "tposts")
        tr = materialize(tr.drop("community", "link_id"), "treplies")
    return tp, tr


def _d11(spark, sf, tp=None, tr=None):
    tp = V.posts(spark, sf) if tp is None else tp
    tr = V.replies(spark, sf) if tr is None else tr
    p = S.activity_score(tp).withColumn("kind", F.lit("post"))
    r = S.activity_score(tr).withColumn("kind", F.lit("reply"))
    return p.unionByName(r)


def _d12(spark, sf, tp=None, tr=None):
    if tp is None:
        tp, tr = _tagged(spark, sf)
    # aggregate first, attach the cohort to the (group, author, month) result
    return S.comm_scores(tp, tr, FIXTURE_GROUPS, cohorts=V.cohorts_of(tp, tr))


def _d14(spark, sf, tp=None, tr=None):
    if tp is None:
        tp, tr = _tagged(spark, sf)
    return S.reply_interaction(tr, tp.select("author"))


def _d15(spark, sf, tp=None):
    return S.post_interaction(V.tposts(spark, sf) if tp is None else tp)


@query("activity_score", "D11 A10 W3 F13 W4", f"""
with {D11_SQL}
select kind, author, cast(created_day as varchar) created_day, activity_count, days_ago,
       round(time_based, 6) time_based from d11""")
def activity_score(spark, sf):
    return _d11(spark, sf).withColumn("created_day", F.col("created_day").cast("string"))


@query("comm_score", "D12 U1 A11 W5", f"""
with {D12_SQL}
select community_grp, author, month, cohort, interactions, partners, "groups", round(comm_score, 6) comm_score,
       round(normalized_score, 6) normalized_score from d12""")
def comm_score(spark, sf):
    return _d12(spark, sf)


def _time_scored(rows, kind, d11, d12):
    """D13 of one kind: the threshold is that of its own rows.  Each join is stored, so its
    shuffles go before those of the next, and what it was made of goes too."""
    own = d11.filter(F.col("kind") == kind).select("author", "created_day", "time_based")
    days = materialize(rows.join(own, on=["author", "created_day"], how="left"), f"{kind}-days")
    x = materialize(days.join(d12, on=["author", "community_grp", "month"], how="left"), f"{kind}-scores")
    remove(rows.sparkSession, days.stored_at)
    return S.time_score(x).withColumn("kind", F.lit(kind))


@query("time_score", "D13 S14 D11 D12", f"""
with {D11_SQL}, {D12_SQL}, {D13_SQL}
select kind, id, author, round(time_based, 6) time_based, round(comm_score, 6) comm_score,
       round(time_based_score, 6) time_based_score
from d13""")
def time_score(spark, sf):
    tp, tr = _tagged(spark, sf, shared=True)
    cols = ["author", "created_day", "community_grp", "month"]
    d11 = _d11(spark, sf, tp, tr)
    d12 = _d12(spark, sf, tp, tr).select("author", "community_grp", "month", "comm_score")
    p = _time_scored(tp.select("id", *cols), "post", d11, d12)
    r = _time_scored(tr.select(F.col("parent_id").alias("id"), *cols), "reply", d11, d12)
    return p.unionByName(r).select("kind", "id", "author", "time_based", "comm_score", "time_based_score")


@query("reply_interaction", "D14 W2 F15 J8", f"""
with {D14_SQL}
select author, community_grp, month, round(graph, 6) graph from d14""")
def reply_interaction(spark, sf):
    return _d14(spark, sf)


@query("post_interaction", "D15 F15", f"""
with {D15_SQL}
select author, community_grp, month, round(graph, 6) graph from d15""")
def post_interaction(spark, sf):
    return _d15(spark, sf)


@query("user_month_scores", "D16", D16_SQL + """
select author, month, community_grp, kind, round(graph, 6) graph from d16""")
def user_month_scores(spark, sf):
    users = V.known(V.tposts(spark, sf)).select("author").distinct()   # = authors of cposts
    return S.user_month_scores(V.tposts(spark, sf), V.treplies(spark, sf), users, FIXTURE_GROUPS)


@query("integrated_rank", "D18 A5 K2 W1", """
with u as (select author, coalesce(cast(sentiment_complex as double), 0.0) * 2.0 sentiment from posts
            where author is not null
           union all
           select author, coalesce(cast(sentiment as double), 0.0) * 1.0 sentiment from replies
            where author is not null),
m as (select author, avg(sentiment) sentiment from u group by author),
s as (select author, 0.0 + 50.0 * (sentiment - 0.0) / 1.0 score from m),
t as (select * from s order by round(score, 9) desc nulls last, author limit 500)
select cast(row_number() over (order by round(score, 9) desc nulls last, author) as bigint) as rank, author,
       round(score, 6) score from t""")
def integrated_rank(spark, sf):
    rw = RankWeights(descending=True)
    cols_p = {"sentiment": "sentiment_complex", "pos": "pos_score", "graph": "graph", "time_based": "time_based_score"}
    cols_r = {"sentiment": "sentiment", "pos": "pos_score", "graph": "graph", "time_based": "time_based_score"}
    return S.integrated_rank(V.posts(spark, sf), V.replies(spark, sf), cols_p, cols_r, rw)


FOUR = RankWeights(descending=True, components=(("sentiment", 50.0), ("pos", 4.0), ("graph", -0.5),
                                                ("time_based", 3.0)))


def _day_cells(rows, sentiment, text_id, pos):
    """Rows of known authors reduced to (author, group, month, day) cells with
    their count and mean row scores: the score lookups join cells, not rows."""
    return V.known(rows).join(pos.withColumnRenamed("id", text_id), on=text_id, how="left") \
        .groupBy("author", "community_grp", "month", "created_day").agg(
            F.count(F.lit(1)).alias("_n"), F.avg(F.coalesce(F.col(sentiment), F.lit(0.0))).alias("sentiment"),
            F.avg(F.coalesce(F.col("pos"), F.lit(0.0))).alias("pos"))


@query("integrated_rank_weighted", "D18 D8 D13 D14 D15", f"""
with {D11_SQL}, {D12_SQL}, {D13_SQL}, {D14_SQL}, {D15_SQL}, {_POS_BY_ID_SQL},
u as (select d13.author, coalesce(sent, 0.0) * 2.0 sentiment, coalesce(ps.pos, 0.0) * 2.0 pos,
             coalesce(d15.graph, 0.0) * 2.0 graph, time_based_score * 2.0 tb
      from d13 left join ps using (id) left join d15 using (author, community_grp, month)
      where kind = 'post' and d13.author is not null
      union all
      select d13.author, coalesce(sent, 0.0), coalesce(ps.pos, 0.0), coalesce(d14.graph, 0.0), time_based_score
      from d13 left join ps using (id) left join d14 using (author, community_grp, month)
      where kind = 'reply' and d13.author is not null),
m as (select author, avg(sentiment) sentiment, avg(pos) pos, avg(graph) graph, avg(tb) tb from u group by author),
s as (select author, 50.0 * sentiment + 4.0 * pos - 0.5 * graph + 3.0 * tb score from m),
t as (select * from s order by round(score, 9) desc nulls last, author limit 500)
select cast(row_number() over (order by round(score, 9) desc nulls last, author) as bigint) as rank, author,
       round(score, 6) score from t""")
def integrated_rank_weighted(spark, sf):
    """D18 with a non-zero weight for each of its four components."""
    keys = ["author", "community_grp", "month"]
    tp, tr = _tagged(spark, sf, shared=True)
    pos, d11 = materialize(_pos_by_id(spark, sf), "pos"), _d11(spark, sf, tp, tr)
    d12 = materialize(_d12(spark, sf, tp, tr).select(*keys, "comm_score"), "comm")
    d14, d15 = materialize(_d14(spark, sf, tp, tr), "reply-graph"), _d15(spark, sf, tp)
    sides = []
    for kind, rows, sentiment, text_id, graph in (("reply", tr, "sentiment", "parent_id", d14), ("post", tp, "sentiment_complex", "id", d15)):
        cells = materialize(_day_cells(rows, sentiment, text_id, pos), f"{kind}-cells")
        if kind == "reply":
            remove(spark, tr.stored_at)  # all that reads it is stored
        scored = _time_scored(cells, kind, d11, d12)
        remove(spark, cells.stored_at)
        sides.append(scored.join(graph, on=keys, how="left"))
    cols = {"sentiment": "sentiment", "pos": "pos", "graph": "graph", "time_based": "time_based_score"}
    return S.integrated_rank(sides[1], sides[0], cols, cols, FOUR, row_weight="_n")


MULTI = RankWeights(descending=True, components=(("sentiment", 2.0), ("pos", 1.0), ("graph", -1.0),
                                                 ("time_based", -1.0)))


@query("integrated_rank_multi", "D19 J7 D8 D12 D14 D15", f"""
with {D12_SQL}, {D14_SQL}, {D15_SQL}, {_POS_BY_ID_SQL},
a as (select author, coalesce(cast(sentiment_complex as double), 0.0) * 2.0 sentiment from posts
       where author is not null
      union all
      select author, coalesce(cast(sentiment as double), 0.0) * 1.0 sentiment from replies where author is not null),
ma as (select author, avg(sentiment) sentiment from a group by author),
b as (select p.author, coalesce(ps.pos, 0.0) * 2.0 pos, coalesce(d15.graph, 0.0) * 2.0 graph, coalesce(d12.comm_score, 0.0) * 2.0 tb
      from cposts p left join d15 using (author, community_grp, month)
      left join d12 using (author, community_grp, month) left join ps on ps.id = p.id
      union all
      select r.author, coalesce(ps.pos, 0.0) * 1.0 pos, coalesce(d14.graph, 0.0) * 1.0 graph, coalesce(d12.comm_score, 0.0) * 1.0 tb
      from creplies r left join d14 using (author, community_grp, month)
      left join d12 using (author, community_grp, month) left join ps on ps.id = r.parent_id),
mb as (select author, avg(pos) pos, avg(graph) graph, avg(tb) tb from b group by author),
m as (select coalesce(ma.author, mb.author) author, coalesce(sentiment, 0.0) sentiment, coalesce(pos, 0.0) pos,
             coalesce(graph, 0.0) graph, coalesce(tb, 0.0) tb
      from ma full outer join mb on ma.author = mb.author),
s as (select author, 0.0 + 2.0 * (sentiment - 0.0) / 1.0 + 1.0 * (pos - 0.0) / 1.0 + -1.0 * (graph - 0.0) / 1.0
                     + -1.0 * (tb - 0.0) / 1.0 score from m),
t as (select * from s order by round(score, 9) desc nulls last, author limit 500)
select cast(row_number() over (order by round(score, 9) desc nulls last, author) as bigint) as rank, author,
       round(score, 6) score from t""")
def integrated_rank_multi(spark, sf):
    keys = ["author", "community_grp", "month"]
    tp, tr = _tagged(spark, sf, shared=True)
    d12 = _d12(spark, sf, tp, tr).select(*keys, "comm_score")
    # the cohort lookup of cposts/creplies only drops null authors here: a filter does that
    # rows collapse to (author, group, month) cells with their row count before the score lookups
    pos = _pos_by_id(spark, sf)
    n = [F.count(F.lit(1)).alias("_n"), F.avg(F.coalesce(F.col("pos"), F.lit(0.0))).alias("pos")]
    cp = V.known(tp).join(pos, on="id", how="left").groupBy(*keys).agg(*n)
    cr = V.known(tr).join(pos.withColumnRenamed("id", "parent_id"), on="parent_id", how="left").groupBy(*keys).agg(*n)
    sp = cp.join(_d15(spark, sf, tp), on=keys, how="left").join(d12, on=keys, how="left")
    sr = cr.join(_d14(spark, sf, tp, tr), on=keys, how="left").join(d12, on=keys, how="left")
    std = {"pos": "pos", "graph": "graph", "time_based": "comm_score"}
    return S.integrated_rank_multi(tp, tr, sp, sr, ("sentiment_complex", "sentiment"), std, MULTI, std_weight="_n")


@query("ranked_activity", "D20 J3 U1 D3", f"""
with u as (
  select author, coalesce(sentiment_complex * 2.0, 0.0) ws, 2.0 w, 1 p from posts
   where author is distinct from '[deleted]' and author is not null
  union all
  select author, coalesce(sentiment * 1.0, 0.0) ws, 1.0 w, 0 p from replies
   where author is distinct from '[deleted]' and author is not null),
g as (select author, sum(ws) / sum(w) score from u group by author having sum(p) > 0),
t as (select author, score from g order by round(score, 9) nulls last, author limit 500),
rk as (select cast(row_number() over (order by round(score, 9) nulls last, author) as bigint) as rank, author,
              score integrated_score from t)
select rank, author, round(integrated_score, 6) integrated_score, 'post' activity_type, community,
       d.title "text", d.selftext, created_utc, score original_score, round(d.title_score, 6) title_score,
       round(d.text_score, 6) text_score, round(sentiment_complex, 6) sentiment_score
from posts p join rk using (author) left join (
  select cast(id as varchar) id, title, selftext, {_p_sql('title')} title_score, {_p_sql('selftext')} text_score from docs) d using (id)
union all
select rank, author, round(integrated_score, 6), 'reply', community, t.body, null::varchar, created_utc,
       score, null::double, null::double, round(sentiment, 6)
from replies join rk using (author) left join turns t on t.id = replies.parent_id""")
def ranked_activity(spark, sf):
    # the ranking cuts the posts, and their ids the texts, before any text moves
    ranking = materialize(S.sentiment_rank(V.posts(spark, sf), V.replies(spark, sf), rw=RANK), "ranking")
    p = V.posts(spark, sf).join(F.broadcast(ranking.select("author")), on="author", how="left_semi")
    d = V.docs(spark, sf).select(F.col("id").cast("string").alias("id"), "title", "selftext") \
        .join(p.select("id"), on="id", how="left_semi")
    d = d.select("id", "title", "selftext", MD.post_scores(F.col("title"), F.col("selftext"), SCORER, 1).alias("s")) \
        .select("id", "title", "selftext", "s.sentiment_title", "s.sentiment_text")
    p = p.join(d, on="id", how="left")
    # a reply's text: the turn that its parent id names
    r = V.replies(spark, sf).join(F.broadcast(ranking.select("author")), on="author", how="left_semi")
    t = V.turns(spark, sf).select(F.col("id").alias("parent_id"), "body").join(r.select("parent_id"), "parent_id", "left_semi")
    r = r.join(t, on="parent_id", how="left")
    return S.ranked_activity(ranking, p, r, post_text="title", post_selftext="selftext", reply_text="body")


# ---------------------------------------------------------------- D8-D10 language scores
@query("pos_score", "D8 F8 F9 F10", f"""
with {_XT_SQL}
select id, cohort, community_grp, round({_POS_SQL}, 6) pos_score from xt""")
def pos_score(spark, sf):
    x = _x_text(spark, sf)
    return x.select("id", "cohort", "community_grp",
                    S.pos_score("txt", F.col("_toks"), F.col("_tags"), LEX).alias("pos_score"))


_FEAT_SQL = Q.feature_cols("txt", "toks", "tags", LEX)


@query("text_features", "D9 F5-F11", f"""
with {_XT_SQL}
select id, cohort, community_grp,
  {', '.join((f'round({v}, 6) {k}' if ('ratio' in k or k == 'readability_score') else f'{v} {k}')
             for k, v in _FEAT_SQL.items())}
from xt""")
def text_features(spark, sf):
    x = _x_text(spark, sf)
    feats = T.language_features("txt", F.col("_toks"), F.col("_tags"), LEX)
    return x.select("id", "cohort", "community_grp", *[c.alias(k) for k, c in feats.items()])


@query("length_score", "D10 D9", f"""
with {_XT_SQL},
f as (select id, cohort, community_grp, {', '.join(f'{v} {k}' for k, v in _FEAT_SQL.items())} from xt)
select id, cohort, community_grp,
  round(case when text_length is not null and cast(text_length as double) <> 0
             then 0.0 + -1.5 * (noun_ratio / cast(text_length as double))
                  + 1.0 * (first_person_singular_ratio / cast(text_length as double)) end, 6) length_score
from f""")
def length_score(spark, sf):
    x = _x_text(spark, sf)
    feats = T.language_features("txt", F.col("_toks"), F.col("_tags"), LEX)
    f = x.select("id", "cohort", "community_grp", *[c.alias(k) for k, c in feats.items()])
    cols = {k: F.col(k) for k in feats}
    return f.select("id", "cohort", "community_grp", S.length_score(cols).alias("length_score"))
