"""Projections, filters, joins, unions, sorts.

Join strategy: joins against data-sized relations are left to the planner
(sort-merge, or broadcast when AQE measures a side under the threshold at run
time).  An explicit ``broadcast`` hint is only placed on relations whose size is
bounded by construction: literal lists and ``limit(n)`` results.
"""

from __future__ import annotations

from functools import reduce
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..params import SENTINEL_AUTHOR


# ---------------------------------------------------------------- P: projections and filters
def project_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keep a fixed column list (pruned down to the scan)."""
    return df.select(*cols)


def coalesce_columns(df: DataFrame, first: str, second: str) -> DataFrame:
    """``first`` := first non-null of (first, second); ``second`` dropped."""
    return df.withColumn(first, F.coalesce(F.col(first), F.col(second))).drop(second)


def tag_constant(df: DataFrame, name: str, value) -> DataFrame:
    """Add a constant column."""
    return df.withColumn(name, F.lit(value))


def filter_in_ci(df: DataFrame, col: str, values: Iterable[str]) -> DataFrame:
    """Case-insensitive membership; a missing value counts as ''."""
    vals = sorted({v.lower() for v in values})
    return df.filter(F.lower(F.coalesce(F.col(col), F.lit(""))).isin(vals))


def filter_in_cs(df: DataFrame, col: str, values: Iterable[str]) -> DataFrame:
    """P5: case-sensitive membership (pushed to Parquet as ``In``)."""
    return df.filter(F.col(col).isin(list(values)))


def drop_sentinel(df: DataFrame, col: str = "author", sentinel: str = SENTINEL_AUTHOR) -> DataFrame:
    """Drop the sentinel author, keep nulls (document-store ``$ne``)."""
    return df.filter(~F.col(col).eqNullSafe(F.lit(sentinel)))


def filter_missing(df: DataFrame, cols: Sequence[str], missing: bool = True) -> DataFrame:
    """Rows where any of ``cols`` is absent (or, with ``missing=False``, all present)."""
    any_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])
    return df.filter(any_null if missing else ~any_null)


def filter_month(df: DataFrame, month: str, col: str = "month") -> DataFrame:
    """The study's ``^YYYY-MM`` prefix match on the day, as equality on the month tag."""
    return df.filter(F.col(col) == month)


def filter_numeric(df: DataFrame, col: str) -> DataFrame:
    """Drop rows whose value is null or not numeric; value parsed to double."""
    v = F.col(col).cast("string").try_cast("double")
    return df.withColumn(col, v).filter(F.col(col).isNotNull())


def filter_nonzero(df: DataFrame, col: str) -> DataFrame:
    """P10: drop zero scores (nulls kept, as pandas keeps NaN)."""
    return df.filter(~F.col(col).eqNullSafe(F.lit(0)))


# ---------------------------------------------------------------- J: joins
def semi_join(df: DataFrame, keys_df: DataFrame, key: str = "author") -> DataFrame:
    """All rows whose key is in ``keys_df`` (left semi; no duplication)."""
    return df.join(keys_df.select(key), on=key, how="left_semi")


def attach(df: DataFrame, lookup: DataFrame, key: str = "author") -> DataFrame:
    """Inner lookup (rows without a match vanish, as lookup + unwind)."""
    return df.join(lookup, on=key, how="inner")


def ratio_left_join(totals: DataFrame, counts: DataFrame, key: str, total_col: str, count_col: str,
                    out: str = "ratio") -> DataFrame:
    """``coalesce(count, 0) / total`` for every row of ``totals``."""
    j = totals.join(counts, on=key, how="left")
    return j.withColumn(count_col, F.coalesce(F.col(count_col), F.lit(0)).cast("bigint")) \
            .withColumn(out, F.try_divide(F.col(count_col).cast("double"), F.col(total_col).cast("double")))


def unique_match_transfer(source: DataFrame, target: DataFrame, keys: Sequence[str], value: str,
                          order_col: str, out: str = "transferred") -> tuple[DataFrame, DataFrame]:
    """Copy ``value`` from source to target rows on ``keys`` where exactly one
    target row has the key.  Returns (target rows with ``out``, source rows with
    a ``status``): ``updated`` (one target), ``multiple`` (several targets, left
    unchanged), ``none`` (no target row for the key).

    Several source rows on one key: the one with the greatest ``order_col`` wins
    (``max_by``), so the result does not depend on scan order.
    """
    keys = list(keys)
    # per-key counts as an aggregate (partial, skew-proof), not a window over a hot key
    n_t = target.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n_targets"))
    src = source.groupBy(*keys).agg(F.max_by(F.col(value), F.col(order_col)).alias(out))
    one = src.join(n_t.filter("_n_targets = 1"), on=keys, how="left_semi")
    n = F.coalesce(F.col("_n_targets"), F.lit(0))
    status = F.when(n == 0, F.lit("none")).when(n == 1, F.lit("updated")).otherwise(F.lit("multiple"))
    report = source.join(n_t, on=keys, how="left").withColumn("status", status).drop("_n_targets")
    return target.join(one, on=keys, how="left"), report


def outer_merge_many(dfs: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Full outer merge of several tables on shared keys."""
    return reduce(lambda a, b: a.join(b, on=list(keys), how="full_outer"), dfs)


def outer_combine(left: DataFrame, right: DataFrame, key: str, left_cols: Sequence[str],
                  right_cols: Sequence[str]) -> DataFrame:
    """Combine two per-key aggregates, a missing side counting as 0.

    Done as one ``groupBy`` over the union of both (one exchange) instead of a
    full outer join of two separately shuffled inputs.  Column types are kept.
    """
    lt = {f.name: f.dataType.simpleString() for f in left.schema.fields}
    rt = {f.name: f.dataType.simpleString() for f in right.schema.fields}
    l = left.select(key, *left_cols, *[F.lit(None).cast(rt[c]).alias(c) for c in right_cols])
    r = right.select(key, *[F.lit(None).cast(lt[c]).alias(c) for c in left_cols], *right_cols)
    u = l.unionByName(r)
    return u.groupBy(key).agg(*[F.coalesce(F.sum(c), F.lit(0).cast(t)).alias(c)
                                for c, t in [*((c, lt[c]) for c in left_cols), *((c, rt[c]) for c in right_cols)]])


def users_with_post(activity: DataFrame, key: str = "author", kind: str = "kind") -> DataFrame:
    """Keys having at least one post."""
    return (activity.groupBy(key).agg(F.count_if(F.col(kind) == "post").alias("n_posts"))
            .filter(F.col("n_posts") > 0).select(key))


def anti_join(df: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows not yet processed."""
    return df.join(done.select(*keys), on=list(keys), how="left_anti")


# ---------------------------------------------------------------- U: unions
def union_activity(posts: DataFrame, replies: DataFrame) -> DataFrame:
    """One activity shape with ``kind`` in {post, reply}; absent columns null."""
    return (posts.withColumn("kind", F.lit("post"))
            .unionByName(replies.withColumn("kind", F.lit("reply")), allowMissingColumns=True))


def union_distinct_lower(*cols: tuple[DataFrame, str], out: str = "value") -> DataFrame:
    """Set union of lower-cased values of several columns."""
    parts = [df.select(F.lower(F.col(c)).alias(out)) for df, c in cols]
    return reduce(lambda a, b: a.union(b), parts).filter(F.col(out).isNotNull()).distinct()


def append_rows(detail: DataFrame, extra: DataFrame) -> DataFrame:
    """Append aggregate rows (e.g. ``ALL``) below detail rows."""
    return detail.unionByName(extra, allowMissingColumns=True)


# ---------------------------------------------------------------- K: sort, limit, top-k
def sort_global(df: DataFrame, cols: Sequence[str | Column]) -> DataFrame:
    """K1: total order (range-partitioned sort, no single-task sort)."""
    return df.orderBy(*cols)


def with_global_position(df: DataFrame, order: Sequence[Column], out: str = "row_number") -> DataFrame:
    """K1: 1-based position in a total order, computed without a single-partition window.

    Range-partition on the order, number rows inside each partition and write
    the result once under the shared folder; the number of rows of all earlier
    partitions is counted from that file (range bounds come from a sample, so
    two evaluations need not agree) and joined back: one row per partition.
    ``order`` must be a total order.
    """
    from ..session import materialize
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # monotonically_increasing_id = (partition << 33) + index inside the partition
    ranged = materialize(ranged.withColumn("_mid", F.monotonically_increasing_id()), "positions")
    ranged = ranged.withColumn("_pid", F.shiftright("_mid", 33))
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    offs = counts.withColumn(
        "_off", F.coalesce(F.sum("_cnt").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                           F.lit(0))).select("_pid", "_off")
    return (ranged.join(offs, on="_pid", how="inner")
            .withColumn(out, (F.col("_off") + F.col("_mid") - F.shiftleft("_pid", 33) + 1).cast("bigint"))
            .drop("_pid", "_mid", "_off"))


def top_n(df: DataFrame, score: str, n: int, descending: bool = False, tiebreak: Sequence[str] = ("author",),
          precision: int = 9) -> DataFrame:
    """K2: N lowest (or highest) by score, ties by ``tiebreak`` (TakeOrderedAndProject).

    Scores are compared at ``precision`` decimals so that the order does not
    depend on floating-point summation order.
    """
    key = F.round(F.col(score), precision)
    key = key.desc_nulls_last() if descending else key.asc_nulls_last()
    return df.orderBy(key, *[F.col(t).asc_nulls_last() for t in tiebreak]).limit(n)


def rank_rows(limited: DataFrame, score: str, descending: bool = False, tiebreak: Sequence[str] = ("author",),
              out: str = "rank", precision: int = 9) -> DataFrame:
    """1-based rank without ties.  Only applied to an already limited set:
    a window without partitioning moves its input to one task."""
    key = F.round(F.col(score), precision)
    key = key.desc_nulls_last() if descending else key.asc_nulls_last()
    w = Window.orderBy(key, *[F.col(t).asc_nulls_last() for t in tiebreak])
    return limited.withColumn(out, F.row_number().over(w).cast("bigint"))


def first_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """K4: the first N rows of a defined order."""
    return df.orderBy(*order).limit(n)


def topn_by_threshold(cohort_users: DataFrame, totals: DataFrame, key: str, thresholds: Sequence[int],
                      n: int) -> DataFrame:
    """K3: top-N keys by raw cohort-user count (threshold 0 rows), and for each
    threshold t the top-N by ``cohort users / all users`` among keys with at
    least t users (missing cohort count = 0), flagged when also in the raw top N.

    ``cohort_users``: (key, cohort_users); ``totals``: (key, unique_users).
    Thresholds are generated per row (``explode`` of a literal array), not
    joined; ``row_number() <= n`` per threshold is planned with a partial
    per-partition group limit before the exchange.
    """
    raw = cohort_users.orderBy(F.col("cohort_users").desc(), F.col(key)).limit(n)
    raw_keys = raw.select(key).withColumn("in_raw_top", F.lit(True))
    ratio = (totals.join(cohort_users, on=key, how="left")
             .withColumn("cohort_users", F.coalesce(F.col("cohort_users"), F.lit(0)).cast("bigint"))
             .withColumn("ratio", F.col("cohort_users").cast("double") / F.col("unique_users").cast("double")))
    ratio = ratio.withColumn("threshold", F.explode(F.array(*[F.lit(int(t)) for t in thresholds]).cast("array<bigint>")))
    ratio = ratio.filter(F.col("unique_users") >= F.col("threshold"))
    w = Window.partitionBy("threshold").orderBy(F.round(F.col("ratio"), 9).desc(), F.col(key))
    ranked = ratio.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= n)
    ranked = ranked.join(F.broadcast(raw_keys), on=key, how="left") \
                   .withColumn("in_raw_top", F.coalesce(F.col("in_raw_top"), F.lit(False)))
    raw_rows = (rank_rows(raw, "cohort_users", descending=True, tiebreak=(key,))
                .select(F.lit(0).cast("bigint").alias("threshold"), key, "rank",
                        F.col("cohort_users").cast("bigint").alias("cohort_users"),
                        F.lit(None).cast("bigint").alias("unique_users"), F.lit(None).cast("double").alias("ratio"),
                        F.lit(True).alias("in_raw_top")))
    cols = ["threshold", key, "rank", "cohort_users", F.col("unique_users").cast("bigint").alias("unique_users"),
            "ratio", "in_raw_top"]
    return raw_rows.unionByName(ranked.select(*cols))


def literal_frame(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small literal relation (group lists, pairs, thresholds)."""
    return spark.createDataFrame(list(rows), schema)
