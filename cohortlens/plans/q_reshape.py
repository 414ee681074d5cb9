"""Queries: pivots, unpivots, matrices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import reshape as RS
from ..operators import scores as S
from ..params import FIXTURE_GROUPS, FIXTURE_LEXICON as LEX
from . import sqltext as Q
from . import views as V
from .catalog import query
from .q_scores import D16_SQL

GROUPS = list(FIXTURE_GROUPS.labels)
@query("pivot_matrix", "R1 A8", """
with c as (select cohort, community_grp, avg(sentiment) m from creplies group by all),
l as (select unnest(['SW', 'MH', 'Otr']) cohort)
select l.cohort,
  round(max(m) filter (where community_grp = 'SW'), 6) "SW",
  round(max(m) filter (where community_grp = 'MH'), 6) "MH",
  round(max(m) filter (where community_grp = 'Otr'), 6) "Otr"
from l left join c on l.cohort = c.cohort group by l.cohort""")
def pivot_matrix(spark, sf):
    from ..operators.aggregates import cell_means
    cells = cell_means(V.reply_cells(spark, sf), ["cohort", "community_grp"])   # one mean per cell
    return RS.pivot_mean(cells, "cohort", "community_grp", GROUPS, "mean_score", rows=GROUPS)


@query("pivot_time", "R2 A9", """
select cast(created_day as varchar) created_day,
  round(avg(score) filter (where community_grp = 'SW'), 6) "SW",
  round(avg(score) filter (where community_grp = 'MH'), 6) "MH",
  round(avg(score) filter (where community_grp = 'Otr'), 6) "Otr"
from tev group by created_day""")
def pivot_time(spark, sf):
    e = V.tev(spark, sf).withColumn("created_day", F.col("created_day").cast("string"))
    return RS.pivot_mean(e, "created_day", "community_grp", GROUPS, "score")


_FEAT_SQL = Q.feature_cols("txt", "toks", "tags", LEX)


@query("unpivot_mean", "R3 F8", f"""
with x as (select *, {Q.tags('toks', LEX)} tags from (
             select *, {Q.tokens('txt')} toks from (select *, {Q.post_text('title', 'selftext')} txt from xtexts))),
f as (select id, community_grp, {', '.join(f'cast({v} as double) {k}' for k, v in _FEAT_SQL.items())} from x),
l as (unpivot f on {', '.join(_FEAT_SQL)} into name variable value value)
select variable, community_grp, round(avg(value), 6) mean_value from l group by all""")
def unpivot_mean(spark, sf):
    x = T.with_text_arrays(V.xtexts(spark, sf).withColumn("txt", T.post_text("title", "selftext")), "txt", LEX)
    feats = T.language_features("txt", F.col("_toks"), F.col("_tags"), LEX)
    f = x.select("id", "community_grp", *[c.cast("double").alias(k) for k, c in feats.items()])
    return RS.unpivot_mean(f, ["id"], list(feats), ["community_grp"])


def _user_months(spark, sf):
    users = V.known(V.tposts(spark, sf)).select("author").distinct()   # = authors of cposts
    return S.user_month_scores(V.tposts(spark, sf), V.treplies(spark, sf), users, FIXTURE_GROUPS)


def _named(df):
    code = F.when(F.col("kind") == "reply", F.lit("com")).otherwise(F.lit("sub"))
    return df.withColumn("name", F.concat_ws("-", "community_grp", code, "month"))


def _wide(spark, sf):
    return RS.wide(_named(_user_months(spark, sf)), "author", "name", "graph")


_WIDE_SQL = (f"{D16_SQL},\nnm as (select *, concat_ws('-', community_grp, case kind when 'reply' then 'com' "
             f"else 'sub' end, month) name from d16)")


@query("unpivot_names", "R4 F14", f"""
{_WIDE_SQL}
select grp, type, cast(month as varchar) as month, round(avg(value), 6) mean_value from (
  select split_part(name, '-', 1) grp, split_part(name, '-', 2) type,
         cast(try_strptime(regexp_extract(name, '(\\d{{4}}-\\d{{2}})', 1) || '-01', '%Y-%m-%d') as date) as month,
         graph value from nm)
where month is not null group by all""")
def unpivot_names(spark, sf):
    long = RS.unpivot_names(_wide(spark, sf), ["author"])
    return (long.groupBy("grp", "type", F.col("month").cast("string").alias("month"))
            .agg(F.avg("value").alias("mean_value")))


@query("wide_user_months", "R5 D16", f"""
{_WIDE_SQL},
ws as (select author, name, cast(round(sum(graph) * 1000) as bigint) v from nm group by author, name)
select author, count(*) n_cells, string_agg(concat(name, '=', cast(v as varchar)), ',' order by name) cells
from ws group by author""")
def wide_user_months(spark, sf):
    w = _wide(spark, sf)
    cells = F.array_sort(F.map_entries("cells"))   # names are unique
    shown = F.transform(cells, lambda x: F.concat(x["key"], F.lit("="), F.round(x["value"] * 1000).cast("bigint").cast("string")))
    return w.select("author", F.size("cells").cast("bigint").alias("n_cells"), F.array_join(shown, ",").alias("cells"))


@query("matrix_avg", "R6 A8", """
with a as (select cohort, community_grp, avg(sentiment_complex) post_mean from cposts group by all),
b as (select cohort, community_grp, avg(sentiment) reply_mean from creplies group by all)
select cohort, community_grp, round((post_mean + reply_mean) / 2, 6) "value"
from a full outer join b using (cohort, community_grp)""")
def matrix_avg(spark, sf):
    from ..operators.aggregates import cell_means
    a = cell_means(V.post_cells(spark, sf), ["cohort", "community_grp"], "post_mean")
    b = cell_means(V.reply_cells(spark, sf), ["cohort", "community_grp"], "reply_mean")
    return RS.cell_average(a, b, ["cohort", "community_grp"], "post_mean", "reply_mean")
