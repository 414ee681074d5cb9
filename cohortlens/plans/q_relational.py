"""Queries: projections, filters, joins, unions, sort/top-k (P, J, U, K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import relational as R
from . import views as V
from .catalog import query


# ------------------------------------------------------------------ P1-P10
@query("project_columns", "P1", "select id, author, community, score from posts")
def project_columns(spark, sf):
    return R.project_columns(V.posts(spark, sf), ["id", "author", "community", "score"])


@query("coalesce_columns", "P2", "select id, coalesce(parent_id, link_id) as parent_id, author from turns")
def coalesce_columns(spark, sf):
    t = V.turns(spark, sf).select("id", "parent_id", "link_id", "author")
    return R.coalesce_columns(t, "parent_id", "link_id")


@query("tag_constant", "P3", "select id, author, 'SW' as community_grp from docs")
def tag_constant(spark, sf):
    return R.tag_constant(V.docs(spark, sf).select("id", "author"), "community_grp", "SW")


@query("filter_community_ci", "P4", """
select id, author, community from posts
where lower(coalesce(community, '')) in ('1-urgent/f', '2-high/o')""")
def filter_community_ci(spark, sf):
    p = V.posts(spark, sf).select("id", "author", "community")
    return R.filter_in_ci(p, "community", ["1-Urgent/F", "2-HIGH/o"])


@query("filter_community_cs", "P5", """
select id, author, community from posts where community in ('1-URGENT/F', '2-HIGH/O')""")
def filter_community_cs(spark, sf):
    p = V.posts(spark, sf).select("id", "author", "community")
    return R.filter_in_cs(p, "community", ["1-URGENT/F", "2-HIGH/O"])


@query("filter_sentinel", "P6", "select id, author from posts where author is distinct from '[deleted]'")
def filter_sentinel(spark, sf):
    return R.drop_sentinel(V.posts(spark, sf).select("id", "author"))


@query("filter_missing", "P7", """
select id, author, sentiment_complex from posts where author is null or sentiment_complex is null""")
def filter_missing(spark, sf):
    p = V.posts(spark, sf).select("id", "author", "sentiment_complex")
    return R.filter_missing(p, ["author", "sentiment_complex"])


@query("filter_month", "P8", "select id, author, created_utc from posts where month = '1997-06'")
def filter_month(spark, sf):
    return R.filter_month(V.posts(spark, sf).select("id", "author", "created_utc", "month"), "1997-06").drop("month")


@query("filter_numeric", "P9", """
select id, try_cast(parent_id as double) as parent_id from ev where try_cast(parent_id as double) is not null""")
def filter_numeric(spark, sf):
    return R.filter_numeric(V.ev(spark, sf).select("id", "parent_id"), "parent_id")


@query("filter_nonzero", "P10", """
select link_id, parent_id, author, score from replies where score is distinct from 0""")
def filter_nonzero(spark, sf):
    return R.filter_nonzero(V.replies(spark, sf).select("link_id", "parent_id", "author", "score"), "score")


# ------------------------------------------------------------------ J1-J9
@query("semi_users", "J1", """
select link_id, parent_id, author, score from replies
where author in (select author from posts where community = '1-URGENT/F')""")
def semi_users(spark, sf):
    users = V.posts(spark, sf).filter(F.col("community") == "1-URGENT/F").select("author")
    return R.semi_join(V.replies(spark, sf).select("link_id", "parent_id", "author", "score"), users)


@query("attach_cohort", "J2 A7", "select id, author, community_grp, cohort from cposts")
def attach_cohort(spark, sf):
    return V.cposts(spark, sf).select("id", "author", "community_grp", "cohort")


@query("ratio_left_join", "J4 A3", """
with act as (select author, community from posts union all select author, community from replies),
tot as (select community, count(distinct author) unique_users from act group by community),
sw as (select community, count(distinct a.author) sw_users from act a join cohorts c on a.author = c.author
       where c.cohort = 'SW' group by community)
select t.community, t.unique_users, cast(coalesce(s.sw_users, 0) as bigint) sw_users,
       round(cast(coalesce(s.sw_users, 0) as double) / t.unique_users, 6) ratio
from tot t left join sw s on t.community = s.community""")
def ratio_left_join(spark, sf):
    tp, tr = V.tposts(spark, sf), V.treplies(spark, sf)
    # distinct (community, author) pairs first: the cohort lookup joins pairs, not rows
    pairs = V.known(tp.select("author", "community").unionByName(tr.select("author", "community"))).distinct()
    tot = pairs.groupBy("community").agg(F.count(F.lit(1)).alias("unique_users"))
    sw_pairs = pairs.join(V.cohorts_of(tp, tr).filter(F.col("cohort") == "SW"), on="author", how="inner")
    sw = sw_pairs.groupBy("community").agg(F.count(F.lit(1)).alias("sw_users"))
    return R.ratio_left_join(tot, sw, "community", "unique_users", "sw_users")


@query("unique_match_transfer", "J5", """
with e as (select id, author, community, score, cast(floor(created_utc / 3600) as bigint) as hour from ev),
t as (select * from e where community <> 'purchase'), s as (select * from e where community = 'purchase'),
n as (select author, hour, count(*) n_t from t group by author, hour),
v as (select author, hour, arg_max(score, id) v from s group by author, hour)
select 'target' side, t.id, t.author, t.hour, null status, case when n.n_t = 1 then v.v end transferred
from t join n on t.author = n.author and t.hour = n.hour left join v on t.author = v.author and t.hour = v.hour
union all
select 'source' side, s.id, s.author, s.hour,
       case when n.n_t is null then 'none' when n.n_t = 1 then 'updated' else 'multiple' end status, null transferred
from s left join n on s.author = n.author and s.hour = n.hour""")
def unique_match_transfer(spark, sf):
    e = V.ev(spark, sf).withColumn("hour", F.floor(F.col("created_utc") / 3600).cast("bigint"))
    src, rest = e.filter(F.col("community") == "purchase"), e.filter(F.col("community") != "purchase")
    out, report = R.unique_match_transfer(src, rest.select("id", "author", "hour"), ["author", "hour"], "score", "id")
    return out.select(F.lit("target").alias("side"), "id", "author", "hour",
                      F.lit(None).cast("string").alias("status"), "transferred").unionByName(
        report.select(F.lit("source").alias("side"), "id", "author", "hour", "status",
                      F.lit(None).cast("bigint").alias("transferred")))


@query("outer_merge_many", "J6", """
with a as (select author, month, count(*) n_posts from posts where author is not null group by 1, 2),
b as (select author, month, avg(sentiment) reply_sentiment from replies group by 1, 2),
c as (select author, month, count(*) n_events from ev group by 1, 2)
select author, month, n_posts, round(reply_sentiment, 6) reply_sentiment, n_events
from a full outer join b using (author, month) full outer join c using (author, month)""")
def outer_merge_many(spark, sf):
    a = V.posts(spark, sf).filter(F.col("author").isNotNull()).groupBy("author", "month") \
        .agg(F.count(F.lit(1)).alias("n_posts"))
    b = V.replies(spark, sf).groupBy("author", "month").agg(F.avg("sentiment").alias("reply_sentiment"))
    c = V.ev(spark, sf).groupBy("author", "month").agg(F.count(F.lit(1)).alias("n_events"))
    return R.outer_merge_many([a, b, c], ["author", "month"])


@query("outer_combine", "J7", """
with a as (select author, count(*) n_posts from posts group by author),
b as (select author, count(*) n_replies from replies group by author)
select coalesce(a.author, b.author) author, cast(coalesce(n_posts, 0) as bigint) n_posts,
       cast(coalesce(n_replies, 0) as bigint) n_replies
from a full outer join b on a.author is not distinct from b.author""")
def outer_combine(spark, sf):
    a = V.posts(spark, sf).groupBy("author").agg(F.count(F.lit(1)).alias("n_posts"))
    b = V.replies(spark, sf).groupBy("author").agg(F.count(F.lit(1)).alias("n_replies"))
    return R.outer_combine(a, b, "author", ["n_posts"], ["n_replies"])


@query("users_with_post", "J8", """
select author from (select author, 1 p from posts union all select author, 0 p from replies) u
group by author having sum(p) > 0""")
def users_with_post(spark, sf):
    act = R.union_activity(V.posts(spark, sf).select("author"), V.replies(spark, sf).select("author"))
    return R.users_with_post(act)


@query("anti_unscored", "J9", """
select id, author from docs where id not in (select doc_id from labels)""")
def anti_unscored(spark, sf):
    done = V.read_table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return R.anti_join(V.docs(spark, sf).select("id", "author"), done, ["id"])


# ------------------------------------------------------------------ U1-U3
@query("union_activity", "U1", """
select 'post' kind, id, author, created_utc, community, score, null::varchar parent_id from posts
union all
select 'reply' kind, null::varchar id, author, created_utc, community, score, parent_id from replies""")
def union_activity(spark, sf):
    p = V.posts(spark, sf).select("id", "author", "created_utc", "community", "score")
    r = V.replies(spark, sf).select("author", "created_utc", "community", "score", "parent_id")
    return R.union_activity(p, r)


@query("union_lists", "U2", """
select distinct lower(community) as value from posts where community is not null
union
select distinct lower(community) as value from ev where community is not null""")
def union_lists(spark, sf):
    return R.union_distinct_lower((V.posts(spark, sf), "community"), (V.ev(spark, sf), "community"))


@query("append_all", "U3 A8", """
select cohort, community_grp, round(avg(sentiment), 6) mean_score from creplies group by 1, 2
union all
select 'ALL' cohort, community_grp, round(avg(sentiment), 6) mean_score from creplies group by 2""")
def append_all(spark, sf):
    cells = V.reply_cells(spark, sf)          # (author, group) partial sums, cohort attached
    detail = A.cell_means(cells, ["cohort", "community_grp"])
    alls = A.cell_means(cells, ["community_grp"]).withColumn("cohort", F.lit("ALL"))
    return R.append_rows(detail, alls)


# ------------------------------------------------------------------ K1-K4
@query("sort_time", "K1", """
select id, created_utc, author, community, score, parent_id,
       cast(row_number() over (order by created_utc, id) as bigint) as row_number from ev""")
def sort_time(spark, sf):
    e = V.ev(spark, sf).select("id", "created_utc", "author", "community", "score", "parent_id")
    return R.with_global_position(e, [F.col("created_utc"), F.col("id")])


@query("topn_users", "K2 W1", """
with g as (select author, sum(score) total_score from replies group by author),
t as (select * from g order by total_score desc, author limit 50)
select cast(row_number() over (order by total_score desc, author) as bigint) as rank, author,
       cast(total_score as bigint) total_score from t""")
def topn_users(spark, sf):
    g = V.replies(spark, sf).groupBy("author").agg(F.sum("score").alias("total_score"))
    top = R.top_n(g, "total_score", 50, descending=True)
    return R.rank_rows(top, "total_score", descending=True).select("rank", "author", "total_score")


@query("topn_communities", "K3 A3 J4", """
with act as (select author, community, cohort from cposts union all select author, community, cohort from creplies),
tot as (select community, count(distinct author) unique_users from act group by 1),
cu as (select community, count(distinct author) cohort_users from act where cohort = 'SW' group by 1),
raw as (select community, cohort_users from cu order by cohort_users desc, community limit 5),
rr as (select 0::bigint threshold, community,
              cast(row_number() over (order by cohort_users desc, community) as bigint) as rank,
              cohort_users, null::bigint unique_users, null::double ratio, true in_raw_top from raw),
rat as (select t.community, t.unique_users, cast(coalesce(c.cohort_users, 0) as bigint) cohort_users,
               cast(coalesce(c.cohort_users, 0) as double) / t.unique_users ratio, th.threshold
        from tot t left join cu c on t.community = c.community
        cross join (select unnest([500, 1000, 2000])::bigint threshold) th
        where t.unique_users >= th.threshold),
rk as (select *, cast(row_number() over (partition by threshold order by round(ratio, 9) desc, community) as bigint) as rank
       from rat)
select threshold, community, rank, cohort_users, unique_users, round(ratio, 6) ratio, in_raw_top from rr
union all
select threshold, community, rank, cohort_users, unique_users, round(ratio, 6) ratio,
       community in (select community from raw) in_raw_top
from rk where rank <= 5""")
def topn_communities(spark, sf):
    tp, tr = V.tposts(spark, sf), V.treplies(spark, sf)
    # distinct (community, author) pairs first; the cohort is attached to pairs, not to rows
    pairs = V.known(tp.select("community", "author").unionByName(tr.select("community", "author"))).distinct()
    pairs = pairs.join(V.cohorts_of(tp, tr), on="author", how="inner")
    tot = pairs.groupBy("community").agg(F.count(F.lit(1)).alias("unique_users"))
    cu = pairs.filter(F.col("cohort") == "SW").groupBy("community").agg(F.count(F.lit(1)).alias("cohort_users"))
    return R.topn_by_threshold(cu, tot, "community", [500, 1000, 2000], 5)


@query("first_n", "K4", "select id, author, created_utc from ev order by created_utc, id limit 100")
def first_n(spark, sf):
    e = V.ev(spark, sf).select("id", "author", "created_utc")
    return R.first_n(e, [F.col("created_utc"), F.col("id")], 100)
