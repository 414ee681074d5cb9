"""Queries: ranking and order-dependent computations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import relational as R
from ..operators import windows as W
from . import views as V
from .catalog import query


@query("rank_users", "W1 K2", """
with g as (select author, avg(sentiment) score from replies where author is not null group by author
           having avg(sentiment) is not null),
t as (select * from g order by round(score, 9) desc, author limit 100)
select cast(row_number() over (order by round(score, 9) desc, author) as bigint) as rank, author,
       round(score, 6) score from t""")
def rank_users(spark, sf):
    g = (V.replies(spark, sf).filter(F.col("author").isNotNull()).groupBy("author")
         .agg(F.avg("sentiment").alias("score")).filter(F.col("score").isNotNull()))
    top = R.top_n(g, "score", 100, descending=True)
    return R.rank_rows(top, "score", descending=True).select("rank", "author", "score")


@query("seen_parent", "W2", """
select author, community_grp, month, parent_id, created_utc, score, partner,
       row_number() over (partition by author, community_grp, month, parent_id
                          order by created_utc, score, partner) > 1 as "repeat"
from treplies""")
def seen_parent(spark, sf):
    r = V.treplies(spark, sf).select("author", "community_grp", "month", "parent_id", "created_utc", "score",
                                     "partner")
    return W.seen_parent(r, ["author", "community_grp", "month"], "parent_id", ["created_utc", "score", "partner"])


@query("days_ago", "W3", """
select id, cast(created_day as varchar) created_day,
       cast(date_diff('day', created_day, (select max(created_day) from ev)) as bigint) days_ago
from ev""")
def days_ago(spark, sf):
    e = W.days_ago(V.ev(spark, sf).select("id", "created_day"))
    return e.withColumn("created_day", F.col("created_day").cast("string"))


_DAILY_SQL = """d as (select author, cast(created_day as varchar) created_day, count(*) activity_count
                      from ev group by all)"""


@query("minmax", "W4 A10", f"""
with {_DAILY_SQL},
s as (select min(activity_count) lo, max(activity_count) hi from d)
select author, created_day, activity_count,
       round(coalesce(cast(activity_count - lo as double) / nullif(cast(hi - lo as double), 0), 0.0), 6)
         activity_count_scaled
from d, s""")
def minmax(spark, sf):
    e = V.ev(spark, sf).withColumn("created_day", F.col("created_day").cast("string"))
    return W.minmax(A.daily_counts(e), "activity_count")


@query("clip_minmax", "W5 A19", f"""
with {_DAILY_SQL},
s as (select quantile_cont(cast(activity_count as double), 0.9) t, min(activity_count) lo0 from d)
select author, created_day, activity_count,
       round(coalesce((least(cast(activity_count as double), t) - least(lo0, t))
                      / nullif(t - least(lo0, t), 0), 0.0), 6) activity_count_normalized
from d, s""")
def clip_minmax(spark, sf):
    e = V.ev(spark, sf).withColumn("created_day", F.col("created_day").cast("string"))
    return W.clip_minmax(A.daily_counts(e), "activity_count", 0.9)
