"""Queries: repeatable sampling (M1, M2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sampling as M
from ..params import SAMPLE_PAIRS
from . import views as V
from .catalog import query

SEED = "seed42"


@query("sample_users", "M1 J1", f"""
with u as (select distinct author, cohort from cposts),
r as (select author, row_number() over (partition by cohort
             order by md5(concat_ws('|', coalesce(author, ''), '{SEED}')), coalesce(author, '')) rn from u)
select 'post' kind, id, author, cohort, created_utc from cposts where author in (select author from r where rn <= 100)
union all
select 'reply' kind, parent_id id, author, cohort, created_utc from creplies
where author in (select author from r where rn <= 100)""")
def sample_users(spark, sf):
    tp, tr = V.tposts(spark, sf), V.treplies(spark, sf)
    users = V.cohorts_of(tp, tr).join(V.known(tp).select("author").distinct(), on="author", how="left_semi")
    rows = tp.select(F.lit("post").alias("kind"), "id", "author", "created_utc").unionByName(
        tr.select(F.lit("reply").alias("kind"), F.col("parent_id").alias("id"), "author", "created_utc"))
    return M.sample_users(users, rows, 100, SEED).select("kind", "id", "author", "cohort", "created_utc")


_ORDER = ["kind", "id", "author", "partner", "created_utc", "score", "_s100"]


@query("sample_pairs", "M2", f"""
with x as (select 'reply' kind, cohort, community_grp, parent_id id, author, partner, created_utc, score, sentiment
           from creplies
           union all select 'post' kind, cohort, community_grp, id, author, null partner, created_utc, score,
                            sentiment_complex sentiment from cposts),
x1 as (select *, cast(round(sentiment * 100) as bigint) _s100 from x),
p as (select * from (values {', '.join(f"('{a}', '{b}')" for a, b in SAMPLE_PAIRS)}) t(cohort, community_grp)),
j as (select x1.* from x1 join p using (cohort, community_grp)),
k as (select *, concat_ws('|', {', '.join(f"coalesce(cast({c} as varchar), '')" for c in _ORDER)}) t from j),
r as (select *, row_number() over (partition by cohort, community_grp order by md5(concat_ws('|', t, '{SEED}')), t) rn
      from k)
select kind, cohort, community_grp, id, author, partner, created_utc, score, sentiment from r where rn <= 250""")
def sample_pairs(spark, sf):
    r = V.creplies(spark, sf).select(F.lit("reply").alias("kind"), "cohort", "community_grp",
                                     F.col("parent_id").alias("id"), "author", "partner", "created_utc", "score", "sentiment")
    p = V.cposts(spark, sf).select(F.lit("post").alias("kind"), "cohort", "community_grp", "id", "author",
                                   F.lit(None).cast("string").alias("partner"), "created_utc", "score",
                                   F.col("sentiment_complex").alias("sentiment"))
    x = r.unionByName(p).withColumn("_s100", F.round(F.col("sentiment") * 100).cast("bigint"))
    return M.sample_pairs(x, SAMPLE_PAIRS, ["cohort", "community_grp"], _ORDER, 250, SEED).drop("_s100")
