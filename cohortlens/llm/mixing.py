"""Operator 6: mixing sources to target weights by capped water-filling.

Sources have weights; together they share the size of all documents.  A source
may be repeated at most ``max_epochs`` times: sources whose share is above that
are clamped and the excess goes to the others by weight, until none is above.
With sources sorted by cap over weight this is one pass: level k is (what is left
after the caps before k) / (the weights from k on), and the first level that does
not exceed its own source's cap over weight is the water level.

The mix takes every document of a source ``floor(target / size)`` times and, for
the fraction, one time more in a seeded order of the documents until the rest of
the target is reached; the document at the border is taken if that comes nearer.
The seeded order is cumulated in two grids of 1024 cells for each source and only
then row by row inside one cell, so no source, however large, meets in one task.

Edge cases: null texts have size 0; a null source is a source of its own, the
last; sources of size 0 have target 0 and their documents are taken 0 times or
at most 3 without weight; ids may repeat or be null; columns may have any names;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C
from .registry import query

CELLS = 1024


def cycling_weight(rank: Column) -> Column:
    """1, 2, 3, 1, ... by a rank that starts at 0."""
    return rank % 3 + 1


def water_fill(totals: DataFrame, weight=cycling_weight, max_epochs: int = 3) -> DataFrame:
    """(source, source_size, target) of (source, source_size); one row a source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = totals.withColumn("weight", weight(F.row_number().over(by_name) - 1).cast("long")) \
        .withColumn("cap", F.col("source_size") * max_epochs)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    w = w.withColumn("level", (F.sum("source_size").over(everything)
                               - (F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap")))
                     / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "level"))
    w = w.withColumn("water", F.min(fits).over(everything)["level"])
    return w.select("source", "source_size",
                    F.least(F.col("cap").cast("double"), F.col("water") * F.col("weight")).alias("target"))


def _border(rest: DataFrame, cells: DataFrame, place: str) -> DataFrame:
    """The first cell of each source that reaches past ``rest``, and what is left for it."""
    run = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    c = cells.join(rest.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))) \
        .withColumn("upto", F.sum("words").over(run)).filter(F.col("upto") > F.col("rest"))
    first = c.groupBy("source").agg(F.min(F.struct("cell", (F.col("rest") - F.col("upto") + F.col("words")).alias("rest"))).alias("f"))
    return first.select("source", F.col("f.cell").alias(place), F.col("f.rest").alias("rest"))


def mixture(docs: DataFrame, source: Column, size: Column, key: list[Column], weight=cycling_weight,
            max_epochs: int = 3, seed: int = 42) -> DataFrame:
    """(row struct of all columns, size, source_size, target, times) for every row."""
    h = F.xxhash64(F.lit(seed), *key)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), source.alias("source"),
                       F.coalesce(size.cast("long"), F.lit(0).cast("long")).alias("size"), h.alias("h"))
    rows = rows.withColumn("c1", F.shiftrightunsigned("h", 54)) \
        .withColumn("c2", F.shiftrightunsigned("h", 44).bitwiseAND(F.lit(CELLS - 1)))
    grid = rows.groupBy("source", "c1", "c2").agg(F.sum("size").alias("words"))
    one = C.store(rows.groupBy("source", F.col("c1").alias("cell")).agg(F.sum("size").alias("words")), "op6-cells")
    plan = C.store(water_fill(one.groupBy("source").agg(F.sum("words").alias("source_size")), weight, max_epochs)
                   .withColumn("whole", F.when(F.col("source_size") > 0,
                               F.least(F.lit(max_epochs), F.floor(F.col("target") / F.col("source_size")))).otherwise(0))
                   .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "op6-plan")
    first = _border(plan.select("source", "rest"), one, "b1")
    inner = grid.join(first.select(F.col("source").alias("s1"), "b1"),
                      F.col("source").eqNullSafe(F.col("s1")) & (F.col("c1") == F.col("b1"))) \
        .select("source", F.col("c2").alias("cell"), "words")
    second = _border(first.select("source", "rest"), inner, "b2")
    full = plan.join(first.select(F.col("source").alias("s1"), "b1"), F.col("source").eqNullSafe(F.col("s1")), "left") \
        .join(second.select(F.col("source").alias("s2"), "b2", F.col("rest").alias("last")),
              F.col("source").eqNullSafe(F.col("s2")), "left") \
        .select(F.col("source").alias("src"), "source_size", "target", "whole", "b1", "b2", "last")
    full = C.store(full, "op6-border")
    got = rows.join(full, F.col("source").eqNullSafe(F.col("src")))
    at_border = F.coalesce((F.col("c1") == F.col("b1")) & (F.col("c2") == F.col("b2")), F.lit(False))
    before = F.coalesce((F.col("c1") < F.col("b1")) | ((F.col("c1") == F.col("b1")) & (F.col("c2") < F.col("b2"))), F.lit(False))
    columns = ["row", "size", "source_size", "target"]
    plain = got.filter(~at_border).select(*columns, F.least(F.lit(max_epochs), F.col("whole") + before.cast("long")).cast("int").alias("times"))
    run = Window.partitionBy("source").orderBy("h", "size", "c2").rowsBetween(Window.unboundedPreceding, 0)
    edge = got.filter(at_border).withColumn("middle", F.sum("size").over(run) - F.col("size") / 2) \
        .select(*columns, (F.col("whole") + ((F.col("size") > 0) & (F.col("middle") <= F.col("last"))).cast("long"))
                .cast("int").alias("times"))
    return plain.unionByName(edge)


def words_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(C.WORD)), F.lit(0)).cast("long")


@query("op6_mixing")
def op6(spark, sf_dir):
    docs = C.table(spark, sf_dir, "documents")
    slim = C.store(docs.select("doc_id", "source", words_of("text").alias("size")), "op6-sizes")
    out = mixture(slim, F.col("source"), F.col("size"), [F.col("doc_id"), F.col("size")])
    return out.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))
