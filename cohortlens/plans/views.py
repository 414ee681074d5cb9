"""Fixture views with their tags, shared by the query modules (Spark side).

``tposts``/``treplies``/``tev`` add ``community_grp``; ``cohorts`` is A7 over
posts and replies; ``cposts``/``creplies`` attach it (J2).  These mirror the
helper relations of ``oracle.CTES`` one to one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.tags import community_group
from ..operators.aggregates import per_author_cells, user_cohorts
from ..operators.relational import attach
from ..params import FIXTURE_EV_GROUPS, FIXTURE_GROUPS
from ..sources import tables as tb

posts, replies, ev, docs, turns = tb.posts, tb.replies, tb.ev, tb.docs, tb.turns


def tposts(spark: SparkSession, sf: str) -> DataFrame:
    return tb.posts(spark, sf).withColumn("community_grp", community_group("community", FIXTURE_GROUPS))


def treplies(spark: SparkSession, sf: str) -> DataFrame:
    return tb.replies(spark, sf).withColumn("community_grp", community_group("community", FIXTURE_GROUPS))


def tev(spark: SparkSession, sf: str) -> DataFrame:
    return tb.ev(spark, sf).withColumn("community_grp", community_group("community", FIXTURE_EV_GROUPS))


def cohorts_of(tp: DataFrame, tr: DataFrame) -> DataFrame:
    rows = tp.select("author", "community_grp").unionByName(tr.select("author", "community_grp"))
    return user_cohorts(rows, FIXTURE_GROUPS)


def cohorts(spark: SparkSession, sf: str) -> DataFrame:
    return cohorts_of(tposts(spark, sf), treplies(spark, sf))


def known(df: DataFrame) -> DataFrame:
    """Rows of known authors: every non-null author has a cohort, so this is
    the row set the cohort lookup keeps, without the join."""
    from pyspark.sql import functions as F
    return df.filter(F.col("author").isNotNull())


def cposts(spark: SparkSession, sf: str) -> DataFrame:
    return attach(tposts(spark, sf), cohorts(spark, sf))


def creplies(spark: SparkSession, sf: str) -> DataFrame:
    return attach(treplies(spark, sf), cohorts(spark, sf))
read_table = tb.read_table


def xtexts(spark: SparkSession, sf: str) -> DataFrame:
    """Every text of both kinds (documents as posts, conversation turns as
    replies) with group, cohort and day of the post that its number names;
    texts without such a post are ``Otr`` on the first day."""
    from pyspark.sql import functions as F
    d = tb.docs(spark, sf).select(F.col("id").cast("string").alias("id"), F.col("id").cast("string").alias("link_id"),
                                  F.lit("post").alias("kind"), "title", "selftext")
    t = tb.turns(spark, sf).select("id", "link_id", F.lit("reply").alias("kind"),
                                   F.lit(None).cast("string").alias("title"), F.col("body").alias("selftext"))
    tp, tr = tposts(spark, sf), treplies(spark, sf)
    tags = tp.select(F.col("id").alias("link_id"), "author", "community_grp", "created_day") \
        .join(cohorts_of(tp, tr), on="author", how="left").drop("author")
    return d.unionByName(t).join(tags, on="link_id", how="left").select(
        "id", "kind", "title", "selftext", F.coalesce("community_grp", F.lit("Otr")).alias("community_grp"),
        F.coalesce("cohort", F.lit("Otr")).alias("cohort"),
        F.coalesce("created_day", F.lit("1995-01-01").cast("date")).alias("created_day"))


def reply_cells(spark: SparkSession, sf: str, score: str | None = "sentiment") -> DataFrame:
    """Replies reduced to (author, group) partial sums with the author's cohort
    attached afterwards (see ``aggregates.per_author_cells``)."""
    tp, tr = tposts(spark, sf), treplies(spark, sf)
    return per_author_cells(tr, cohorts_of(tp, tr), ["community_grp"], score)


def post_cells(spark: SparkSession, sf: str, score: str | None = "sentiment_complex") -> DataFrame:
    tp, tr = tposts(spark, sf), treplies(spark, sf)
    return per_author_cells(tp, cohorts_of(tp, tr), ["community_grp"], score)
