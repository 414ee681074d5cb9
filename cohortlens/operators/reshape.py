"""Reshaping (R1-R6): pivots always take their value list (no discovery job,
stable schema across scale factors); unpivot uses Spark's ``unpivot``."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pivot_mean(df: DataFrame, row: str, col: str, values: Sequence[str], score: str,
               rows: Sequence[str] | None = None) -> DataFrame:
    """Mean of ``score`` per (row, col) laid out with one column per value;
    with ``rows`` given, every listed row appears (right join to the fixed list)."""
    p = df.groupBy(row).pivot(col, list(values)).agg(F.avg(F.col(score)))
    if rows is None:
        return p
    fixed = df.sparkSession.createDataFrame([(r,) for r in rows], f"{row} string")
    return fixed.join(p, on=row, how="left")


def unpivot_mean(df: DataFrame, ids: Sequence[str], value_cols: Sequence[str], by: Sequence[str],
                 var: str = "variable", val: str = "value") -> DataFrame:
    """Unpivot wide features to (variable, value), mean per (variable, by)."""
    long = df.select(*ids, *by, *value_cols).unpivot(list({*ids, *by}), list(value_cols), var, val)
    return long.groupBy(var, *by).agg(F.avg(F.col(val)).alias("mean_value"))


def unpivot_names(wide: DataFrame, ids: Sequence[str], cells: str = "cells") -> DataFrame:
    """Unpivot cells named ``grp-type-YYYY-MM`` and split the name;
    unparsable months are dropped; null cells skipped (as a mean skips NaN)."""
    from ..functions.time import split_name
    long = wide.select(*ids, F.explode(cells).alias("name", "value")).filter(F.col("value").isNotNull())
    g, t, m = split_name(F.col("name"))
    return long.select(*ids, g.alias("grp"), t.alias("type"), m.alias("month"), "value") \
               .filter(F.col("month").isNotNull())


def wide(df: DataFrame, row: str, key: str, value: str, cells: str = "cells") -> DataFrame:
    """One row per ``row`` with a map key -> sum; the keys come from the data,
    so no value list cuts any (the long form stays primary)."""
    sums = df.groupBy(row, key).agg(F.sum(F.col(value)).alias("_v"))
    return sums.groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct(key, "_v"))).alias(cells))


def cell_average(a: DataFrame, b: DataFrame, keys: Sequence[str], a_col: str, b_col: str,
                 out: str = "value") -> DataFrame:
    """Cell-by-cell mean of two matrices; null when either side is null."""
    j = a.join(b, on=list(keys), how="full_outer")
    return j.select(*keys, ((F.col(a_col) + F.col(b_col)) / 2).alias(out))
