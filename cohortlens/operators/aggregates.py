"""Grouped aggregates.

All of these are declarative ``groupBy`` aggregates: Spark plans a partial
(map-side) aggregate before the exchange, so a hot key (one author holding a
third of all rows) is reduced to one row per map task before it is shuffled.
Distinct counts are planned as a two-level aggregate on (key, value).
Nothing is collected: global scalars are one-row aggregates joined back.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tags import group_priority, priority_label
from ..params import Groups
from .relational import with_global_position


def distinct_values(*frames: tuple[DataFrame, str], out: str = "author") -> DataFrame:
    """A1: distinct non-null values over several tables."""
    parts = [df.select(F.col(c).alias(out)) for df, c in frames]
    u = parts[0]
    for p in parts[1:]:
        u = u.union(p)
    return u.filter(F.col(out).isNotNull()).distinct()


def count_having(df: DataFrame, key: str, threshold: int) -> DataFrame:
    """A2: row counts per key, kept when above ``threshold``."""
    return (df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") > threshold))


def distinct_per_key(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """A3: exact distinct values per key (nulls not counted)."""
    return df.groupBy(key).agg(F.count_distinct(F.col(value)).alias(out))


def weighted_sums(df: DataFrame, key: str, score: str, weight: float,
                  out_score: str = "total_score", out_weight: str = "total_weight") -> DataFrame:
    """A4: Σ score·w and Σ w per key; a missing score adds 0 but its weight still counts."""
    w = F.lit(float(weight))
    return df.groupBy(key).agg(F.sum(F.coalesce(F.col(score).cast("double") * w, F.lit(0.0))).alias(out_score),
                               F.sum(w).alias(out_weight))


def mean_of_means(df: DataFrame, keys: Sequence[str], inner: str, score: str, out: str) -> DataFrame:
    """A5: mean per (inner, keys) — nulls skipped — then the unweighted mean of
    the inner groups present (an inner group whose mean is null is skipped)."""
    first = df.groupBy(inner, *keys).agg(F.avg(F.col(score)).alias("_m"))
    return first.groupBy(*keys).agg(F.avg("_m").alias(out))


def user_cohorts(rows: DataFrame, groups: Groups, key: str = "author", grp: str = "community_grp",
                 out: str = "cohort") -> DataFrame:
    """A user's cohort by priority SW > MH > other over all their rows.
    (A max of a priority code: partial-aggregated, no set is built.)"""
    return (rows.groupBy(key).agg(F.max(group_priority(grp, groups)).alias("_p"))
            .select(key, priority_label("_p", groups).alias(out)))


def activity_ratio(rows: DataFrame, groups: Groups, cohort: str = "cohort", grp: str = "community_grp",
                   kind: str = "kind", key: str = "author", fixed_other: bool = True,
                   cohorts: DataFrame | None = None) -> DataFrame:
    """Per (kind, author) the shares of rows in each community group, averaged
    per cohort over those (kind, author) rows.  Every cohort gets a row; an empty
    cohort is 0, 0, 0; the other cohort is fixed at 0, 0, 1 as in the study.
    With ``cohorts`` the cohort is attached to the (kind, author) counts."""
    sw, mh, ot = groups.labels
    by = [kind, key] if cohorts is not None else [cohort, kind, key]
    per = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_t"),
        F.count_if(F.col(grp) == sw).alias("_sw"),
        F.count_if(F.col(grp) == mh).alias("_mh"),
        F.count_if(F.col(grp) == ot).alias("_ot"))
    if cohorts is not None:
        per = per.join(cohorts.select(key, cohort), on=key, how="inner")
    avg = per.groupBy(cohort).agg(*[F.avg(F.col(c) / F.col("_t")).alias(n)
                                    for c, n in (("_sw", sw), ("_mh", mh), ("_ot", ot))])
    spark = rows.sparkSession
    labels = spark.createDataFrame([(g,) for g in groups.labels], f"{cohort} string")
    j = labels.join(avg, on=cohort, how="left")
    z = F.lit(0.0)
    out = j.select(cohort, *[F.coalesce(F.col(g), z).alias(g) for g in groups.labels])
    if fixed_other:
        out = out.select(cohort, *[F.when(F.col(cohort) == ot, F.lit(1.0 if g == ot else 0.0))
                                   .otherwise(F.col(g)).alias(g) for g in groups.labels])
    return out


def group_mean(df: DataFrame, keys: Sequence[str], score: str, out: str = "mean_score") -> DataFrame:
    """Mean per group (nulls skipped)."""
    return df.groupBy(*keys).agg(F.avg(F.col(score)).alias(out))


def per_author_cells(rows: DataFrame, cohorts: DataFrame, cells: Sequence[str], score: str | None = None,
                     key: str = "author", cohort: str = "cohort") -> DataFrame:
    """Reduce rows to (author, cells) partial sums, then attach the author's
    cohort: the lookup joins one row per author and cell, not every input row.
    Returns (cohort, cells..., _s = Σ score, _c = count(score), _n = rows)."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    if score is not None:
        aggs += [F.sum(F.col(score)).alias("_s"), F.count(F.col(score)).alias("_c")]
    per = rows.groupBy(key, *cells).agg(*aggs)
    return per.join(cohorts.select(key, cohort), on=key, how="inner").drop(key)


def cell_means(cells_df: DataFrame, keys: Sequence[str], out: str = "mean_score") -> DataFrame:
    """Means per ``keys`` from :func:`per_author_cells` partial sums (null when
    the group has no score)."""
    return cells_df.groupBy(*keys).agg(F.try_divide(F.sum("_s"), F.sum("_c").cast("double")).alias(out))


def daily_group_avg(df: DataFrame, day: str, grp: str, score: str, out: str = "avg_score") -> DataFrame:
    """Average per (day, group), sorted by day."""
    return df.groupBy(day, grp).agg(F.avg(F.col(score)).alias(out)).orderBy(day, grp)


def daily_counts(df: DataFrame, key: str = "author", day: str = "created_day") -> DataFrame:
    """A10: activity count per (author, day)."""
    return df.groupBy(key, day).agg(F.count(F.lit(1)).alias("activity_count"))


def distinct_of_labels(col: str, labels) -> Column:
    """Exact distinct count over a small fixed label set as ``bit_count`` of an
    OR-ed bitmask: an ordinary partial aggregate (a second ``count_distinct``
    in the same ``groupBy`` would make Spark expand every row per distinct
    column).  Nulls and values outside ``labels`` are not counted."""
    expr = F.lit(0)
    for i, lab in enumerate(labels):
        expr = F.when(F.col(col) == lab, F.lit(1 << i)).otherwise(expr)
    return F.bit_count(F.bit_or(expr)).cast("bigint")


def monthly_contacts(df: DataFrame, key: str = "author", month: str = "month", partner: str | None = "partner",
                     grp: str = "community_grp", cohort: str = "cohort", grp_labels=None,
                     cohorts: DataFrame | None = None) -> DataFrame:
    """Per (author, month): interactions, distinct partners, distinct groups,
    and the cohort (``min`` — the study's ``$first`` is order-dependent).
    Absent partner column -> 0 partners.  With ``grp_labels`` (the fixed group
    labels) the distinct group count is a bitmask aggregate.  With ``cohorts``
    the rows need no cohort column: the cohort is joined onto the aggregated
    (author, month) rows instead of onto every input row."""
    p = F.count_distinct(F.col(partner)) if partner else F.lit(0).cast("bigint")
    g = distinct_of_labels(grp, grp_labels) if grp_labels else F.count_distinct(F.col(grp))
    aggs = [F.count(F.lit(1)).alias("interactions"), p.alias("partners"), g.alias("groups")]
    if cohorts is None:
        aggs.append(F.min(F.col(cohort)).alias(cohort))
    out = df.groupBy(key, month).agg(*aggs)
    if cohorts is not None:
        out = out.join(cohorts.select(key, cohort), on=key, how="inner")
    return out


def user_rollup(df: DataFrame, key: str, text: str, score: Column) -> DataFrame:
    """Per user: joined text size (Σ len(text)+1, the study joins with a
    leading space), sentiment sum, count, mean.

    The joined text itself is not materialised in one row: a prolific author's
    texts are unbounded, so they stay as rows (:func:`user_texts`, whole texts),
    and only the sizes and scores are aggregated.
    """
    return df.groupBy(key).agg(
        F.sum(F.length(F.coalesce(F.col(text), F.lit(""))) + 1).cast("bigint").alias("text_chars"),
        F.sum(score).alias("sentiment_sum"),
        F.count(F.lit(1)).alias("n_texts"),
        F.avg(score).alias("avg_sentiment"))


def user_texts(df: DataFrame, key: str, order: Sequence[str], text: str) -> DataFrame:
    """The texts that the study joins per user, as ordered rows (key,
    position from 1, text).  The position comes from the global one (K1), so no
    user's texts meet in one task.  ``order`` and ``text`` make a total order
    but for equal rows."""
    ranked = with_global_position(df.select(key, *order, text), [F.col(c) for c in (key, *order, text)], "_at")
    ranked = ranked.select(key, text, "_at")
    base = ranked.groupBy(F.col(key).alias("_k")).agg(F.min("_at").alias("_base"))
    return ranked.join(base, F.col(key).eqNullSafe(F.col("_k"))) \
        .select(key, (F.col("_at") - F.col("_base") + 1).alias("position"), text)


def joined_text(df: DataFrame, key: str, order: Sequence[str], text: str, piece: int = 1 << 16) -> DataFrame:
    """The text that the study joins per user (a space before every text), cut
    into rows (key, piece from 0, txt) of ``piece`` characters, the last one shorter.

    The place of a text in its user's string is a prefix sum in two steps: inside the
    range partition that holds it, and over the partitions' sums of that user.  So a
    user's texts never meet in one task; only the fragments of a piece do.  ``order``
    and ``text`` make a total order but for equal rows."""
    from ..session import materialize
    s = F.concat(F.lit(" "), F.coalesce(F.col(text), F.lit("")))
    cols = [key, *order, text]
    rows = df.select(key, *order, text).repartitionByRange(*cols).sortWithinPartitions(*cols) \
        .select(F.col(key).alias("_k"), s.alias("_s"), F.monotonically_increasing_id().alias("_mid"))
    rows = materialize(rows, "joined-text").withColumn("_pid", F.shiftright("_mid", 33)) \
        .withColumn("_n", F.length("_s").cast("bigint"))
    inside = Window.partitionBy("_pid", "_k").orderBy("_mid").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("_pid", "_k").agg(F.sum("_n").alias("_sum"))
    over = Window.partitionBy("_k").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = sums.select(F.col("_pid").alias("_p"), F.col("_k").alias("_key"), F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_base"))
    at = rows.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0))) \
        .join(offs, (F.col("_pid") == F.col("_p")) & F.col("_k").eqNullSafe(F.col("_key"))) \
        .select("_k", "_s", "_n", (F.col("_base") + F.col("_in")).alias("_at"))
    parts = at.withColumn("piece", F.explode(F.expr(f"sequence(_at div {piece}, (_at + _n - 1) div {piece})")))
    begin, end = F.greatest(F.col("_at"), F.col("piece") * piece), F.least(F.col("_at") + F.col("_n"), (F.col("piece") + 1) * piece)
    parts = parts.select("_k", "piece", "_at", F.substring("_s", (begin - F.col("_at") + 1).cast("int"), (end - begin).cast("int")).alias("f"))
    return parts.groupBy("_k", "piece").agg(F.sort_array(F.collect_list(F.struct("_at", "f"))).alias("_f")) \
        .select(F.col("_k").alias(key), "piece", F.array_join(F.transform("_f", lambda x: x["f"]), "").alias("txt"))


def exploded_counts(df: DataFrame, keys: Sequence[str], array_col: Column, item: str) -> DataFrame:
    """Explode an array of items and count per (keys, item).  Partial
    aggregation happens per map task right after the explode."""
    return (df.select(*keys, F.explode(array_col).alias(item))
            .groupBy(*keys, item).agg(F.count(F.lit(1)).alias("n")))


def top_item(counts: DataFrame, keys: Sequence[str], item: str, n: str = "n") -> DataFrame:
    """Most frequent item per group (ties: smallest item).  One aggregate:
    ``min_by(item, (-n, item))`` merges partially, no window over a hot group."""
    order = F.struct((-F.col(n)).alias("neg_n"), F.col(item).alias("it"))
    return counts.groupBy(*keys).agg(F.min_by(F.col(item), order).alias(item), F.max(F.col(n)).alias(n))


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Equal-width histogram over [min, max] with ``bins`` bins, last bin
    closed; empty bins are listed with 0.  min = max puts all rows in bin 0."""
    x = F.col(col).cast("double")
    vals = df.select(x.alias("_x")).filter(F.col("_x").isNotNull())
    mm = vals.agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))  # one row
    # one-row scalar relation: broadcast is size-bounded (1 row)
    j = vals.join(F.broadcast(mm), how="inner")
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    b = F.when(F.col("_hi") == F.col("_lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col("_x") - F.col("_lo")) / width), F.lit(bins - 1)).cast("int"))
    counts = j.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    edges = mm.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "_lo", "_hi")
    w = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    edges = edges.select("bin", (F.col("_lo") + F.col("bin") * w).alias("bin_lo"),
                         (F.col("_lo") + (F.col("bin") + 1) * w).alias("bin_hi"))
    return (edges.join(counts, on="bin", how="left")
            .select(F.col("bin").cast("bigint").alias("bin"), "bin_lo", "bin_hi",
                    F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n")))


def value_freq(df: DataFrame, col: str) -> DataFrame:
    """Frequency of each value, most frequent first."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col(col))


def scalars(df: DataFrame, col: str, q: float = 0.9) -> DataFrame:
    """Global max and linear-interpolated quantile, as a one-row relation."""
    from .windows import exact_quantile
    top = df.agg(F.max(F.col(col)).cast("double").alias("max_value"))
    return top.join(F.broadcast(exact_quantile(df, col, q, out="quantile_value")), how="left")


def matrix_totals(df: DataFrame, row: str, col: str, all_label: str = "ALL", out: str = "n",
                  weight: str | None = None) -> DataFrame:
    """Counts per (row, col) plus row totals, column totals and the grand
    total (``cube``); margins are labelled ``ALL``.  ``weight``: rows are
    already partial counts (summed instead of counted)."""
    n = F.sum(F.col(weight)) if weight else F.count(F.lit(1))
    c = df.cube(row, col).agg(n.alias(out), F.grouping_id().alias("_g"))
    return c.select(F.when(F.col("_g").bitwiseAND(2) != 0, F.lit(all_label))
                    .otherwise(F.col(row)).alias(row),
                    F.when(F.col("_g").bitwiseAND(1) != 0, F.lit(all_label)).otherwise(F.col(col)).alias(col),
                    F.col(out).cast("bigint").alias(out))


def matrix_mean_all(df: DataFrame, row: str, col: str, score: str, all_label: str = "ALL",
                    out: str = "mean_score", cells_given: bool = False) -> DataFrame:
    """Cell means, plus per row an ``ALL`` cell = unweighted mean of the
    row's cell means (not the grand mean); null cells skipped.  With
    ``cells_given`` the input already holds one mean per cell in ``score``."""
    cells = (df.select(row, col, F.col(score).alias(out)) if cells_given
             else df.groupBy(row, col).agg(F.avg(F.col(score)).alias(out)))
    alls = cells.groupBy(row).agg(F.avg(F.col(out)).alias(out)).withColumn(col, F.lit(all_label))
    return cells.unionByName(alls)
