"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def _large(e: DataFrame) -> DataFrame:
    both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b")
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    stars = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return stars.unionByName(low.select("a", F.col("m").alias("b"))).filter("a > b").distinct()


def _state(e: DataFrame):
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): every node of ``edges`` (long columns) that is not the
    smallest of its component, with that smallest node.  Each round is written
    to the shared folder; rounds end when the star edges no longer change."""
    cur = C.store(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
                  .filter("a > b").distinct(), "components")
    state = _state(cur)
    while True:
        nxt = C.store(_small(_large(cur)), "components")
        C.discard(cur)
        now = _state(nxt)
        cur = nxt
        if now == state:
            return cur.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now
