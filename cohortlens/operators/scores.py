"""Composite scores and rankings.

Each score is a grouped aggregate or a column expression; the study's
"write the score back to every matching row" becomes a left join on the score's
key (S14).  Per-author aggregates shuffle once on their key after map-side
partial aggregation; rankings cut to N with ``limit`` before anything is
broadcast.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.tags import zero_rule
from ..functions.time import decay
from ..params import (CommWeights, InteractionWeights, LengthScoreWeights, Lexicon, PosScoreWeights, RankWeights,
                      TimeScore, Groups)
from ..session import materialize
from .relational import drop_sentinel, rank_rows, top_n
from .windows import clip_minmax, exact_quantile, minmax_expr


# ------------------------------------------------------------------ D8-D10: language scores
def pos_score(text: Column | str, toks: Column, tg: Column, lex: Lexicon,
              w: PosScoreWeights = PosScoreWeights()) -> Column:
    """-1.5 noun ratio + 1 first-person share of words + 2 keyword + 0.005 words.
    Blank text gets no score (null).  Zero weights are dropped from the expression."""
    f = T.pos_ratios(toks, tg)
    terms = [F.lit(0.0)]
    if w.noun_ratio:
        terms.append(F.lit(w.noun_ratio) * f["noun_ratio"])
    if w.first_person_singular_ratio:
        terms.append(F.lit(w.first_person_singular_ratio) * T.first_person_share_of_words(toks, tg, lex))
    if w.keyword_score:
        terms.append(F.lit(w.keyword_score) * T.keyword_flag(text, lex.keywords).cast("double"))
    if w.text_length:
        terms.append(F.lit(w.text_length) * F.size(toks).cast("double"))
    s = terms[0]
    for t in terms[1:]:
        s = s + t
    return F.when(~T.is_blank(text), s)


def length_score(features: Mapping[str, Column], w: LengthScoreWeights = LengthScoreWeights()) -> Column:
    """Σ weight · feature / text_length over feature names containing
    'ratio'; null when the length is null or 0."""
    n = features["text_length"].cast("double")
    s = F.lit(0.0)
    for name, weight in w.weights:
        if "ratio" in name and weight:
            s = s + F.lit(weight) * (features[name] / n)
    return F.when(n.isNotNull() & (n != 0), s)


# ------------------------------------------------------------------ D11: activity score
def activity_score(rows: DataFrame, key: str = "author", day: str = "created_day",
                   ts: TimeScore = TimeScore()) -> DataFrame:
    """Per (author, day) count · exp(-rate · days before the latest day),
    min-max scaled over all (author, day) rows of this input (one global pass).
    Returns (author, day, activity_count, days_ago, time_based)."""
    # stored: the latest day, the limits and the result read it
    counts = materialize(rows.groupBy(key, day).agg(F.count(F.lit(1)).alias("activity_count")), "activity-counts")
    scal = counts.agg(F.max(day).alias("_max_day"))
    j = counts.join(F.broadcast(scal), how="inner")  # one-row scalar
    j = j.withColumn("days_ago", F.datediff(F.col("_max_day"), F.col(day)).cast("bigint")) \
         .withColumn("_raw", F.col("activity_count") * decay(F.col("days_ago"), ts.decay_rate))
    mm = j.agg(F.min("_raw").alias("_lo"), F.max("_raw").alias("_hi"))
    return (j.join(F.broadcast(mm), how="inner")
            .select(key, day, F.col("activity_count").cast("bigint").alias("activity_count"), "days_ago",
                    minmax_expr(F.col("_raw"), F.col("_lo"), F.col("_hi")).alias("time_based")))


# ------------------------------------------------------------------ D12: communication score
def comm_scores(posts: DataFrame, replies: DataFrame, groups: Groups, w: CommWeights = CommWeights(),
                partner: str | None = "partner", grp: str = "community_grp", cohort: str = "cohort",
                cohorts: DataFrame | None = None) -> DataFrame:
    """For each community group g, over posts and replies of g (Q5: both
    sides filtered), per (author, month): interactions + 2 distinct partners
    + 3 distinct groups; then W5 (clip at the 0.9 quantile, min-max) within g.

    One pass for all groups: ``g`` is simply part of the grouping key, and the
    per-group quantile is a 3-row aggregate joined back.
    Returns (community_grp, author, month, cohort, comm_score, normalized_score).

    With ``cohorts`` (author -> cohort) the inputs need no cohort column: rows
    are aggregated first and the cohort is joined onto the much smaller
    (group, author, month) result (authors without a cohort drop out, as with
    a row-level lookup).
    """
    cols = ["author", "month", grp] + ([] if cohorts is not None else [cohort])
    p = posts.select(*cols, F.lit(None).cast("string").alias("_partner"))
    r = replies.select(*cols, (F.col(partner) if partner else F.lit(None).cast("string")).alias("_partner"))
    u = p.unionByName(r).filter(F.col(grp).isin(list(groups.labels)))
    aggs = [F.count(F.lit(1)).alias("interactions"),
            F.count_distinct("_partner").alias("partners"),
            F.lit(1).cast("bigint").alias("groups")]   # one group per key: the key includes it
    if cohorts is None:
        aggs.append(F.min(cohort).alias(cohort))
    g = u.groupBy(grp, "author", "month").agg(*aggs)
    if cohorts is not None:
        g = g.join(cohorts.select("author", cohort), on="author", how="inner")
    g = g.withColumn("comm_score", (F.lit(w.interactions) * F.col("interactions")
                                    + F.lit(w.partners) * F.col("partners")
                                    + F.lit(w.groups) * F.col("groups")).cast("double"))
    g = materialize(g, "comm-scores")   # the quantile, the minimum and the result read it
    q = exact_quantile(g, "comm_score", w.clip_quantile, [grp]).join(
        g.groupBy(grp).agg(F.min("comm_score").alias("_lo0")), on=grp, how="inner")
    j = g.join(F.broadcast(q), on=grp, how="inner")   # at most one row per group label
    clipped = F.least(F.col("comm_score"), F.col("_t"))
    lo = F.least(F.col("_lo0"), F.col("_t"))
    return j.select(grp, "author", "month", cohort, "interactions", "partners", "groups", "comm_score",
                    minmax_expr(clipped, lo, F.col("_t")).alias("normalized_score"))


# ------------------------------------------------------------------ D13: combined time score
def time_score(rows: DataFrame, ts: TimeScore = TimeScore(), comm: str = "comm_score",
               time_based: str = "time_based", out: str = "time_based_score") -> DataFrame:
    """min(comm / (ratio · max comm), 1) (0 when the max is 0 or absent), plus
    ``time_based`` when it is at least the minimum; missing inputs count 0."""
    mx = rows.agg(F.max(F.col(comm)).cast("double").alias("_mx"))
    j = rows.join(F.broadcast(mx), how="inner")  # one-row scalar
    thr = F.coalesce(F.col("_mx"), F.lit(0.0)) * F.lit(ts.threshold_ratio)
    c = F.coalesce(F.col(comm).cast("double"), F.lit(0.0))
    tb = F.coalesce(F.col(time_based).cast("double"), F.lit(0.0))
    norm = F.when(thr != 0, F.least(c / thr, F.lit(1.0))).otherwise(F.lit(0.0))
    return j.withColumn(out, norm + F.when(tb >= ts.min_time_based, tb).otherwise(F.lit(0.0))).drop("_mx")


# ------------------------------------------------------------------ D14-D16: interaction scores
def reply_interaction(replies: DataFrame, post_authors: DataFrame, w: InteractionWeights = InteractionWeights(),
                      keys: Sequence[str] = ("author", "community_grp", "month"), parent: str = "parent_id",
                      order: Sequence[str] = ("created_utc", "score", "is_submitter"), score: str = "score",
                      rule: str = "write") -> DataFrame:
    """Per (author, group, month): Σ 3·s over replies + Σ 9·s over replies to
    a parent the author already met in that group-month (s after the zero rule).
    Only authors with at least one post are scored.

    Skew-proof form: per (keys, parent) the repeat part is Σs − s(first), with the
    first row picked by ``min_by`` over the (time, score) order — a partial
    aggregate, so a hot author or thread is merged per map task, not windowed.
    """
    keys = list(keys)
    s = zero_rule(F.col(score), F.lit("reply"), rule, is_submitter=F.col("is_submitter")
                  if "is_submitter" in replies.columns else None,
                  zero_reply=w.zero_reply, zero_post=w.zero_post)
    r = replies.withColumn("_s", s)
    # the ordering must determine s: time, score, then the submitter flag (report rule)
    first = F.min_by(F.col("_s"), F.struct(*[F.col(c) for c in order if c in r.columns]))
    per_parent = r.groupBy(*keys, parent).agg(F.sum("_s").alias("_sum"), first.alias("_first"))
    per_parent = per_parent.withColumn(
        "_v", F.lit(w.reply_weight) * F.col("_sum") + F.lit(w.repeat_multiplier) * (F.col("_sum") - F.col("_first")))
    out = per_parent.groupBy(*keys).agg(F.sum("_v").alias("graph"))
    if post_authors is None:
        return out
    return out.join(post_authors.select("author").distinct(), on="author", how="left_semi").select(*keys, "graph")


def post_interaction(posts: DataFrame, w: InteractionWeights = InteractionWeights(),
                     keys: Sequence[str] = ("author", "community_grp", "month"), score: str = "score",
                     rule: str = "write") -> DataFrame:
    """Per (author, group, month): Σ 0.5·s + 0.5·num_comments (s after the zero rule)."""
    s = zero_rule(F.col(score), F.lit("post"), rule, num_comments=F.col("num_comments"),
                  zero_reply=w.zero_reply, zero_post=w.zero_post)
    v = F.lit(w.post_score_weight) * s + F.lit(w.post_comment_weight) * \
        F.coalesce(F.col("num_comments"), F.lit(0)).cast("double")
    return posts.groupBy(*keys).agg(F.sum(v).alias("graph"))


def user_month_scores(posts: DataFrame, replies: DataFrame, users: DataFrame, groups: Groups,
                      w: InteractionWeights = InteractionWeights()) -> DataFrame:
    """Per user of ``users`` and each month the user was active (either
    kind): for each group and kind, the interaction score with the reporting
    zero rule; 0 where the user has no rows (long form; see ``reshape.wide``)."""
    keys = ("author", "community_grp", "month")
    # stored, so that the shuffles behind them are gone before those of the scores
    p = materialize(posts.select(*keys, "score", "num_comments").join(users, on="author", how="left_semi"), "month-posts")
    r = materialize(replies.select(*keys, "parent_id", *[c for c in ("created_utc", "score", "is_submitter") if c in replies.columns])
                    .join(users, on="author", how="left_semi"), "month-replies")
    rep = reply_interaction(r, None, w, keys=keys, rule="report").withColumn("kind", F.lit("reply"))
    pos = post_interaction(p, w, keys=keys, rule="report").withColumn("kind", F.lit("post"))
    # every month of a user has a score of some group, so one aggregate has the months and the
    # cells' sums; scores outside the groups or without a month fill no cell
    cells = [(g, k) for g in groups.labels for k in ("reply", "post")]
    sums = rep.unionByName(pos).groupBy("author", "month").agg(*[
        F.sum(F.when(F.col("month").isNotNull() & (F.col("community_grp") == g) & (F.col("kind") == k), F.col("graph"))).alias(f"_{i}")
        for i, (g, k) in enumerate(cells)])
    # a row a month is dealt by author: what is grouped by author behind it needs no shuffle of the cells
    filled = F.array(*[F.struct(F.lit(g).alias("community_grp"), F.lit(k).alias("kind"), F.coalesce(f"_{i}", F.lit(0.0)).alias("graph"))
                       for i, (g, k) in enumerate(cells)])
    return sums.repartition("author").select("author", "month", F.explode(filled).alias("_c")) \
        .select("author", "_c.community_grp", "month", "_c.kind", "_c.graph")


# ------------------------------------------------------------------ D17-D20: rankings
def sentiment_rank(posts: DataFrame, replies: DataFrame, post_score: str = "sentiment_complex",
                   reply_score: str = "sentiment", rw: RankWeights = RankWeights()) -> DataFrame:
    """Σ(w·s)/Σw with post weight 2 and reply weight 1 over the user's rows
    (a missing score adds 0 but its weight counts), users with at least one post,
    the N lowest (or highest).  ``[deleted]`` and null authors are left out.

    One exchange: both kinds are unioned and aggregated per author together
    (partial aggregation first); the ranking is a TakeOrderedAndProject.
    """
    def side(df: DataFrame, col: str, weight: float, is_post: int) -> DataFrame:
        d = drop_sentinel(df).filter(F.col("author").isNotNull())
        return d.select("author",
                        F.coalesce(F.col(col).cast("double") * F.lit(weight), F.lit(0.0)).alias("_ws"),
                        F.lit(weight).alias("_w"), F.lit(is_post).alias("_p"))
    u = side(posts, post_score, rw.post_weight, 1).unionByName(side(replies, reply_score, rw.reply_weight, 0))
    g = (u.groupBy("author").agg(F.sum("_ws").alias("_tot"), F.sum("_w").alias("_wt"), F.sum("_p").alias("_np"))
         .filter(F.col("_np") > 0)
         .select("author", (F.col("_tot") / F.col("_wt")).alias("score")))
    top = top_n(g, "score", rw.top_n, rw.descending)
    return rank_rows(top, "score", rw.descending).select("rank", "author", "score")


def _component_means(df: DataFrame, kind_weight: float, components: Mapping[str, str | None],
                     weight_col: str | None = None) -> DataFrame:
    """Per-row component values (score · kind weight, missing = 0) and the row
    multiplicity ``_w`` (1 per row, or a pre-aggregated row count)."""
    cols = []
    for name, col in components.items():
        v = F.coalesce(F.col(col).cast("double"), F.lit(0.0)) if col and col in df.columns else F.lit(0.0)
        cols.append((v * F.lit(kind_weight)).alias(name))
    w = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)
    return df.filter(F.col("author").isNotNull()).select("author", *cols, w.alias("_w"))


def _integrate(means: DataFrame, rw: RankWeights, names: Sequence[str]) -> Column:
    ranges = dict(rw.norm_ranges)
    s = F.lit(0.0)
    for name, weight in rw.components:
        if name in names and weight:
            lo, hi = ranges[name]
            s = s + F.lit(weight) * (F.col(name) - F.lit(lo)) / F.lit(hi - lo)
    return s


def integrated_rank(posts: DataFrame, replies: DataFrame, post_cols: Mapping[str, str | None],
                    reply_cols: Mapping[str, str | None], rw: RankWeights = RankWeights(),
                    row_weight: str | None = None) -> DataFrame:
    """Per user and component the mean of (score · kind weight) over all the
    user's rows — divided by the row count, not by Σ weight — with a missing
    score counting 0; then Σ component weight · (x - lo)/(hi - lo); N best/worst.
    ``[deleted]`` is not filtered out; null authors are.

    ``row_weight``: the inputs are cells of several rows with mean scores and
    their row count in that column."""
    names = list(post_cols)
    u = _component_means(posts, rw.post_weight, post_cols, row_weight).unionByName(
        _component_means(replies, rw.reply_weight, reply_cols, row_weight))
    means = u.groupBy("author").agg(*[F.try_divide(F.sum(F.col(n) * F.col("_w")), F.sum("_w")).alias(n)
                                      for n in names])
    scored = means.select("author", _integrate(means, rw, names).alias("score"))
    top = top_n(scored, "score", rw.top_n, rw.descending)
    return rank_rows(top, "score", rw.descending).select("rank", "author", "score")


def integrated_rank_multi(sent_posts: DataFrame, sent_replies: DataFrame, std_posts: DataFrame,
                          std_replies: DataFrame, sent_cols: tuple[str, str], std_cols: Mapping[str, str | None],
                          rw: RankWeights, std_weight: str | None = None) -> DataFrame:
    """The sentiment component from one table pair and the other components
    from a second pair, each a mean over its own rows (a user without rows in a
    pair scores 0 there, Q3); combined per author in one aggregate.

    ``std_weight``: the second pair arrives pre-aggregated — one row per
    (author, group, month) cell with its row count in that column — so the
    score lookups join cells, not every activity row; means are Σ n·v / Σ n.
    """
    names = ["sentiment", *std_cols]
    a = _component_means(sent_posts, rw.post_weight, {"sentiment": sent_cols[0]}) \
        .unionByName(_component_means(sent_replies, rw.reply_weight, {"sentiment": sent_cols[1]}))
    b = _component_means(std_posts, rw.post_weight, std_cols, std_weight).unionByName(
        _component_means(std_replies, rw.reply_weight, std_cols, std_weight))
    a = a.select("author", "sentiment", *[F.lit(None).cast("double").alias(n) for n in std_cols], "_w")
    b = b.select("author", F.lit(None).cast("double").alias("sentiment"), *std_cols, "_w")

    def mean(n: str) -> Column:
        num = F.sum(F.col(n) * F.col("_w"))
        den = F.sum(F.when(F.col(n).isNotNull(), F.col("_w")))
        return F.coalesce(F.try_divide(num, den), F.lit(0.0)).alias(n)

    means = a.unionByName(b).groupBy("author").agg(*[mean(n) for n in names])
    scored = means.select("author", _integrate(means, rw, names).alias("score"))
    top = top_n(scored, "score", rw.top_n, rw.descending)
    return rank_rows(top, "score", rw.descending).select("rank", "author", "score")


def ranked_activity(ranking: DataFrame, posts: DataFrame, replies: DataFrame,
                    post_text: str | None = None, post_selftext: str | None = None,
                    reply_text: str | None = None) -> DataFrame:
    """Every post and reply of the ranked users, 12 columns, by rank, posts before
    replies, then time; post-only score columns are null on replies.

    ``ranking`` is a ``limit(N)`` result, so broadcasting it is size-bounded;
    the activity tables stream past it without a shuffle.
    """
    rk = F.broadcast(ranking.select("rank", "author", F.col("score").alias("integrated_score")))
    def txt(df, c):
        return F.col(c).cast("string") if c and c in df.columns else F.lit(None).cast("string")
    p = posts.join(rk, on="author", how="inner").select(
        "rank", "author", "integrated_score", F.lit("post").alias("activity_type"), "community",
        txt(posts, post_text).alias("text"), txt(posts, post_selftext).alias("selftext"), "created_utc",
        F.col("score").cast("bigint").alias("original_score"),
        F.col("sentiment_title").cast("double").alias("title_score") if "sentiment_title" in posts.columns
        else F.lit(None).cast("double").alias("title_score"),
        F.col("sentiment_text").cast("double").alias("text_score") if "sentiment_text" in posts.columns
        else F.lit(None).cast("double").alias("text_score"),
        F.col("sentiment_complex").cast("double").alias("sentiment_score"))
    r = replies.join(rk, on="author", how="inner").select(
        "rank", "author", "integrated_score", F.lit("reply").alias("activity_type"), "community",
        txt(replies, reply_text).alias("text"), F.lit(None).cast("string").alias("selftext"), "created_utc",
        F.col("score").cast("bigint").alias("original_score"), F.lit(None).cast("double").alias("title_score"),
        F.lit(None).cast("double").alias("text_score"), F.col("sentiment").cast("double").alias("sentiment_score"))
    return p.unionByName(r).orderBy("rank", "activity_type", "created_utc")
