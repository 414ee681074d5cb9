"""Repeatable sampling (M1, M2).

Order inside a group is a hash of (key, seed), so a sample is the same on every
run and on every engine that offers the hash (``md5`` here).  The sample of a
group is the rows of its smallest hashes: rows are counted in cells of the hash
space, the cells are cumulated (at most ``CELLS`` numbers a group), cells below
the border are taken whole, and only the rows of the border cell are ranked.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def hash_order(cols: Sequence[str | Column], seed: str) -> Column:
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cols]
    return F.md5(F.concat_ws("|", *parts, F.lit(seed)))


HEX = 4                 # hex digits of the hash that name a cell
CELLS = 16 ** HEX


def sample_per_group(df: DataFrame, group: Sequence[str], order_cols: Sequence[str], n: int, seed: str) -> DataFrame:
    """The n rows of each group with the smallest hash (ties by the hashed text)."""
    group = list(group)
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order_cols])
    # written once: the counts, the whole cells and the border cell read it
    rows = materialize(df.withColumn("_h", hash_order(order_cols, seed)).withColumn("_cell", F.substring("_h", 1, HEX)), "sample")
    cells = rows.groupBy(*group, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*group).orderBy("_cell"))
    cells = cells.withColumn("_before", upto - F.col("_n")).filter(F.col("_before") < n) \
        .select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_cell").alias("_c"), "_before",
                (F.col("_before") + F.col("_n") <= n).alias("_whole"))
    on = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group] + [F.col("_cell") == F.col("_c")]
    got = rows.join(F.broadcast(cells), on=on, how="inner")  # every cell holds a row: n cells a group at most
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("_h", text))
    border = got.filter(~F.col("_whole")).withColumn("_rank", rank).filter(F.col("_rank") + F.col("_before") <= n)
    return got.filter("_whole").select(*df.columns).unionByName(border.select(*df.columns))


def sample_users(users: DataFrame, activity: DataFrame, n: int, seed: str, cohort: str = "cohort",
                 key: str = "author") -> DataFrame:
    """M1: n distinct users per cohort, then all their rows with the cohort.  The
    result replaces an earlier sample (no re-insert of old copies)."""
    chosen = sample_per_group(users.select(key, cohort).distinct(), [cohort], [key], n, seed)
    return activity.join(chosen.select(key, cohort), on=key, how="inner")


def sample_pairs(rows: DataFrame, pairs: Sequence[tuple[str, str]], pair_cols: Sequence[str],
                 order_cols: Sequence[str], n: int, seed: str) -> DataFrame:
    """M2: up to n rows for each allowed (cohort, community group) pair, without
    replacement.  ``pairs`` is a literal list, so it is a filter, not a join."""
    a, b = pair_cols
    allowed = F.lit(False)
    for x, y in pairs:
        allowed = allowed | ((F.col(a) == x) & (F.col(b) == y))
    return sample_per_group(rows.filter(allowed), pair_cols, order_cols, n, seed)
