"""Base tables and the activity-shaped views derived from them.

The study reads two row kinds, posts and replies.  The test tables are TPC-H-ish,
so these views give them that shape (FIXTURES.md): ``posts`` from orders,
``replies`` from line items, ``ev`` from events, ``docs`` from documents,
``turns`` from conversations.  All are lazy DataFrames: column pruning and
filters of the queries reach the Parquet scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_engine_conf

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan of a base table (pruning and filters reach the scan)."""
    ensure_engine_conf(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _epoch(c: Column) -> Column:
    # test timestamps are TIMESTAMP_NTZ; read them as UTC wall time
    return F.unix_timestamp(c.cast("timestamp"))


def _s(c: Column) -> Column:
    return c.cast("string")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Post-like rows: one per order; ``num_comments`` = its line items."""
    o = read_table(spark, sf_dir, "orders")
    n = (read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey")
         .agg(F.count(F.lit(1)).alias("num_comments")))
    j = o.join(n, o.o_orderkey == n.l_orderkey, "left")
    k = F.col("o_orderkey")
    return j.select(
        _s(k).alias("id"),
        F.when(k % 50 == 0, F.lit("[deleted]")).when(k % 51 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("u"), _s(F.col("o_custkey")))).alias("author"),
        _epoch(F.col("o_orderdate")).alias("created_utc"),
        F.col("o_orderdate").cast("date").alias("created_day"),
        _month(F.col("o_orderdate")).alias("month"),
        F.concat("o_orderpriority", F.lit("/"), "o_orderstatus").alias("community"),
        F.floor(F.col("o_totalprice") / 50000).cast("bigint").alias("score"),
        F.coalesce(F.col("num_comments"), F.lit(0)).cast("bigint").alias("num_comments"),
        F.when(k % 13 == 0, F.lit(None).cast("double"))
         .otherwise(F.round((k % 101).cast("double") / 100, 2)).alias("sentiment_complex"),
    )


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reply-like rows: one per line item (no unique key)."""
    l = read_table(spark, sf_dir, "lineitem")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority",
                                                  "o_orderstatus")
    j = l.join(o, l.l_orderkey == o.o_orderkey, "inner")
    return j.select(
        _s(F.col("l_orderkey")).alias("link_id"),
        F.concat(_s(F.col("l_orderkey")), F.lit(":"), _s(F.col("l_suppkey") % 5)).alias("parent_id"),
        F.when(F.col("l_linenumber") == 7, F.concat(F.lit("s"), _s(F.col("l_suppkey"))))
         .otherwise(F.concat(F.lit("u"), _s(F.col("o_custkey")))).alias("author"),
        F.concat(F.lit("s"), _s(F.col("l_suppkey"))).alias("partner"),
        _epoch(F.col("l_shipdate")).alias("created_utc"),
        F.col("l_shipdate").cast("date").alias("created_day"),
        _month(F.col("l_shipdate")).alias("month"),
        F.concat("o_orderpriority", F.lit("/"), "o_orderstatus").alias("community"),
        F.floor(F.col("l_quantity") / 10).cast("bigint").alias("score"),
        (F.col("l_linestatus") == "O").alias("is_submitter"),
        F.when(F.col("l_partkey") % 17 == 0, F.lit(None).cast("double"))
         .otherwise(F.round((F.col("l_partkey") % 97).cast("double") / 96, 2)).alias("sentiment"),
    )


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time-stamped activity from ``events``."""
    e = read_table(spark, sf_dir, "events")
    return e.select(
        _s(F.col("event_id")).alias("id"),
        F.concat(F.lit("u"), _s(F.col("user_id"))).alias("author"),
        _epoch(F.col("ts")).alias("created_utc"),
        F.col("ts").cast("date").alias("created_day"),
        _month(F.col("ts")).alias("month"),
        F.col("event_type").alias("community"),
        F.floor(F.col("value") / 10).cast("bigint").alias("score"),
        F.get_json_object("props", "$.k").alias("parent_id"),
    )


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text rows: first line = title, rest = selftext.  For every 37th document
    there is one more row whose text was removed (sentinel, negative id)."""
    d = read_table(spark, sf_dir, "documents")
    title = F.split_part(F.col("text"), F.lit("\n"), F.lit(1))
    rows = d.select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("author"),
        F.col("lang").alias("community"),
        title.alias("title"),
        F.expr("substr(text, length(split_part(text, '\\n', 1)) + 2)").alias("selftext"),
    )
    removed = rows.filter(F.col("id") % 37 == 0).select(
        (-F.col("id") - 1).alias("id"), "author", "community", "title", F.lit("[removed]").alias("selftext"))
    return rows.unionByName(removed)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reply text rows from ``conversations``."""
    c = read_table(spark, sf_dir, "conversations")
    conv, turn = _s(F.col("conv_id")), F.col("turn")
    return c.select(
        F.concat(conv, F.lit(":"), _s(turn)).alias("id"),
        conv.alias("link_id"),
        F.when(turn > 0, F.concat(conv, F.lit(":"), _s(turn - 1))).alias("parent_id"),
        F.col("role").alias("author"),
        F.col("text").alias("body"),
        (F.col("role") == "user").alias("is_submitter"),
    )


def _month(ts: Column) -> Column:
    """``yyyy-MM`` of a timestamp: the first 7 characters of its date (cheaper
    than a pattern formatter per row; same result for years 1000-9999)."""
    return F.substring(ts.cast("date").cast("string"), 1, 7)
