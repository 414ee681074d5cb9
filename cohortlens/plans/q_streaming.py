"""Queries: incremental loading and scoring (T1-T3), run with ``availableNow``.

Each query writes its source files (from the test tables) under the shared
checkpoint folder, runs the stream twice (the second run must add nothing),
and returns the sink read back as a batch DataFrame.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import models as MD
from ..session import scratch_dir
from ..streaming import incremental as ST
from . import views as V
from .catalog import query
from .q_models import _p_sql

EV_SCHEMA = "id string, author string, created_utc bigint, community string, score bigint, parent_id string"


@query("stream_load_once", "T1", "select id, author, created_utc, community, score, parent_id from ev")
def stream_load_once(spark, sf):
    d = scratch_dir(spark, "stream-load")
    ev = V.ev(spark, sf).select("id", "author", "created_utc", "community", "score", "parent_id")
    ev.write.json(f"{d}/src")
    for _ in range(2):  # a restart with no new files loads nothing twice
        ST.load_files_once(spark, f"{d}/src", EV_SCHEMA, f"{d}/sink", f"{d}/ckpt", max_files_per_trigger=2)
    return spark.read.parquet(f"{d}/sink")


@query("stream_score_new", "T2 J9 D1", f"""
select doc_id as id, cast(quality as double) score, 'existing' origin from labels
union all
select id, round({_p_sql("concat_ws(' ', title, case when selftext in ('[removed]', '[deleted]') then null else selftext end)")}, 6)
       score, 'new' origin
from docs where id not in (select doc_id from labels)""")
def stream_score_new(spark, sf):
    d = scratch_dir(spark, "stream-score")
    labels = V.read_table(spark, sf, "labels")
    labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("score"),
                  F.lit("existing").alias("origin")).write.parquet(f"{d}/scored")
    docs = V.docs(spark, sf).select("id", T.post_text("title", "selftext").alias("txt"))
    docs.write.parquet(f"{d}/src")
    stream = spark.readStream.schema("id bigint, txt string").parquet(f"{d}/src")

    def score(batch):
        return batch.select("id", MD.class_probability(F.col("txt"), MD.LengthScorer(), 1).alias("score"),
                            F.lit("new").alias("origin"))

    for _ in range(2):  # the second run finds every row scored
        ST.score_unscored(spark, stream, f"{d}/scored", "id", score, f"{d}/ckpt")
    return spark.read.parquet(f"{d}/scored")


@query("stream_score_state", "T2 J9 D1", f"""
select id, round({_p_sql("concat_ws(' ', title, case when selftext in ('[removed]', '[deleted]') then null else selftext end)")}, 6) score
from docs where id not in (select doc_id from labels)""")
def stream_score_state(spark, sf):
    """The rows that the keyed-state form scores: run twice, the second run adds none."""
    d = scratch_dir(spark, "stream-state")
    V.read_table(spark, sf, "labels").select(F.col("doc_id").alias("id")).write.parquet(f"{d}/seed")
    V.docs(spark, sf).select("id", T.post_text("title", "selftext").alias("txt")).write.parquet(f"{d}/src")
    stream = spark.readStream.schema("id bigint, txt string").parquet(f"{d}/src")
    seed = spark.readStream.schema("id bigint").parquet(f"{d}/seed")

    def score(rows):
        return rows.select("id", MD.class_probability(F.col("txt"), MD.LengthScorer(), 1).alias("score"))
    for _ in range(2):
        ST.score_first_seen(stream, seed, "id", score, f"{d}/sink", f"{d}/ckpt")
    return spark.read.parquet(f"{d}/sink")


@query("stream_daily", "T3 A10", """
with e as (select author, created_utc, created_utc - created_utc % 86400 d0 from ev),
m as (select max(created_utc) mx from e)
select author, cast(cast(epoch_ms(d0 * 1000) as date) as varchar) as day, count(*) n
from e, m where d0 + 86400 <= mx - 3600 group by all""")
def stream_daily(spark, sf):
    d = scratch_dir(spark, "stream-daily")
    ev = V.ev(spark, sf).select("author", F.timestamp_seconds("created_utc").alias("event_time"))
    ev.write.parquet(f"{d}/src")
    stream = spark.readStream.schema("author string, event_time timestamp").parquet(f"{d}/src")
    for _ in range(2):
        ST.run_available_now(ST.daily_activity(stream), f"{d}/sink", f"{d}/ckpt")
    return spark.read.parquet(f"{d}/sink")
