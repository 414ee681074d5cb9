"""Order-dependent computations (W2-W5); W1 lives with the top-k in ``relational``.

Global scalars (latest day, min/max, a quantile) are one-row aggregates joined
back with a broadcast hint: the broadcast side is one row by construction, and
the big side is never moved.  No window without ``partitionBy`` is used on
unbounded input (it would pull every row into one task).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seen_parent_windowed(df: DataFrame, keys: Sequence[str], parent: str, order: Sequence[Column | str],
                         out: str = "repeat") -> DataFrame:
    """W2 as a window (reference form for tests): one task per (keys, parent) group."""
    w = Window.partitionBy(*keys, parent).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w) > 1)


def seen_parent(df: DataFrame, keys: Sequence[str], parent: str, order: Sequence[str],
                out: str = "repeat") -> DataFrame:
    """``repeat`` = an earlier row of the same (keys) already had this parent.

    No window, so no group is ever handled by a single task: the rows are
    written once with a row number that sets equal rows apart, the first of each
    (keys, parent) is ``min(struct(order, row number))`` (a partial aggregate),
    and one join on the group key marks every other row (AQE splits a hot key on
    the row side).  Rows tied in ``order`` must be equal in all columns.
    """
    from ..session import materialize
    gk = [*keys, parent]
    rows = materialize(df.withColumn("_mid", F.monotonically_increasing_id()), "seen-parent")
    pos = F.struct(*[F.col(c) for c in order], F.col("_mid"))
    first = rows.groupBy(*[F.col(k).alias(f"_g_{k}") for k in gk]).agg(F.min(pos)["_mid"].alias("_first"))
    cond = [rows[k].eqNullSafe(first[f"_g_{k}"]) for k in gk]          # null keys form a group too
    return rows.join(first, on=cond, how="inner").select(*df.columns, (F.col("_mid") != F.col("_first")).alias(out))


def with_scalar(df: DataFrame, scalar_row: DataFrame) -> DataFrame:
    """Attach a one-row relation of global scalars to every row."""
    return df.join(F.broadcast(scalar_row), how="inner")


def days_ago(df: DataFrame, day: str = "created_day", out: str = "days_ago") -> DataFrame:
    """Days before the latest day in the data."""
    mx = df.agg(F.max(F.col(day)).alias("_max_day"))
    return (with_scalar(df, mx).withColumn(out, F.datediff(F.col("_max_day"), F.col(day)).cast("bigint"))
            .drop("_max_day"))


def minmax_expr(x: Column, lo: Column, hi: Column) -> Column:
    """(x - lo) / (hi - lo); 0 when hi = lo (not NaN, not an error)."""
    return F.coalesce(F.try_divide(x - lo, hi - lo), F.lit(0.0))


def minmax(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Min-max scaling over the whole input."""
    out = out or f"{col}_scaled"
    mm = df.agg(F.min(F.col(col)).cast("double").alias("_lo"), F.max(F.col(col)).cast("double").alias("_hi"))
    return (with_scalar(df, mm).withColumn(out, minmax_expr(F.col(col).cast("double"), F.col("_lo"), F.col("_hi")))
            .drop("_lo", "_hi"))


def exact_quantile(df: DataFrame, col: str, q: float, group: Sequence[str] = (), out: str = "_t") -> DataFrame:
    """Linear-interpolated quantile per group (one row a group), with no value map
    in one task: rows are counted per value, the counts are sorted by ranges and
    written once, cumulated inside each range and offset by the earlier ranges;
    the values at the two ranks around ``q`` are then picked by an aggregate."""
    from ..session import materialize
    group = list(group)
    counts = (df.select(*group, F.col(col).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
              .groupBy(*group, "_v").agg(F.count(F.lit(1)).alias("_n")))
    ranged = materialize(counts.repartitionByRange(*group, "_v").withColumn("_pid", F.spark_partition_id()), "quantile")
    offs = ranged.groupBy("_pid").agg(F.sum("_n").alias("_pn")).withColumn(
        "_off", F.sum("_pn").over(Window.orderBy("_pid")) - F.col("_pn")).select("_pid", "_off")
    run = Window.partitionBy("_pid").orderBy(*group, "_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn("_in", F.sum("_n").over(run)).join(offs, on="_pid", how="inner") \
        .withColumn("_end", F.col("_off") + F.col("_in")).withColumn("_begin", F.col("_end") - F.col("_n"))
    size = placed.groupBy(*group).agg(F.sum("_n").alias("_all"), F.min("_begin").alias("_base"))
    # one row a group (a one-row cross product without groups)
    g = size.select(*[F.col(c).alias(f"_g_{c}") for c in group], "_all", "_base")
    on = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in group]
    at = placed.join(g, on=on, how="inner") if group else placed.join(F.broadcast(g), how="inner")
    rank = F.lit(float(q)) * (F.col("_all") - 1)

    def value(r):
        r = r + F.col("_base")
        return F.max(F.when((F.col("_begin") <= r) & (r < F.col("_end")), F.col("_v")))
    got = at.groupBy(*group).agg(value(F.floor(rank)).alias("_a"), value(F.ceil(rank)).alias("_b"),
                                 F.max(rank - F.floor(rank)).alias("_f"))
    return got.select(*group, (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")).alias(out))


def clip_minmax(df: DataFrame, col: str, q: float = 0.9, out: str | None = None) -> DataFrame:
    """Clip at the ``q`` quantile (linear interpolation), then min-max with the
    quantile as the upper end: (min(x, t) - lo) / (t - lo)."""
    out = out or f"{col}_normalized"
    j = with_scalar(df, exact_quantile(df, col, q))
    j = with_scalar(j, df.agg(F.min(F.col(col)).cast("double").alias("_lo0")))
    clipped = F.least(F.col(col).cast("double"), F.col("_t"))
    lo = F.least(F.col("_lo0"), F.col("_t"))
    return j.withColumn(out, minmax_expr(clipped, lo, F.col("_t"))).drop("_t", "_lo0")
