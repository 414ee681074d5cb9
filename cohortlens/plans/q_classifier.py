"""Queries: trained classifiers in the score columns (D1-D4).  The oracle repeats the
training in SQL, one table a pass."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import classifier as CL
from ..operators import models as MD
from . import sqltext as Q
from . import views as V
from .catalog import query

PASSES, STEP, RIDGE = 20, 2.0, 1e-4
LABELS = {  # label expression (the same in both engines) and number of classes
    "quality": ("quality", 2),
    "toxic": ("toxic", 2),
    "three": ("case when toxic = 1 then 2 when quality = 1 then 0 when quality = 0 then 1 end", 3),
}


def _slots_sql(src: str) -> str:
    """(doc, slot, n) of a relation with (doc, txt)."""
    code = "cast('0x' || left(md5(w), 7) as bigint)"
    return f"""select doc, slot, count(*) n from (
  select doc, unnest(list_concat(list_transform(c, lambda x: x % {CL.SLOTS}),
    list_transform(range(1, len(c)), lambda i: (c[i] * {CL.PAIR} + c[i + 1]) % {CL.SLOTS}))) slot
  from (select doc, list_transform({Q.tokens('txt')}, lambda w: {code}) c from {src})) group by all"""


def _training_sql(name: str) -> str:
    label, k = LABELS[name]

    def each(text, sep=", "):
        return sep.join(text.replace("#", str(c)) for c in range(k))
    steps = [f"""lb as materialized (select docs.id doc, {Q.post_text('title', 'selftext', False)} txt, cast({label} as int) y
  from docs join labels on labels.doc_id = docs.id where ({label}) between 0 and {k - 1}),
cw as materialized (select y, sum(count(*)) over () / (count(*) over () * count(*)) cw from lb group by y),
sl as materialized ({_slots_sql('lb')}),
df as materialized (select slot, ln((1 + (select count(*) from lb)) / (1.0 + count(*))) + 1 idf from sl group by slot),
fx as materialized (select doc, slot, x / sqrt(sum(x * x) over (partition by doc)) x
  from (select doc, slot, ln(1 + n) * idf x from sl join df using (slot))),
w0 as materialized (select slot, {each('0.0::double w#, 0.0::double v#')} from (select slot from df union all select -1))"""]
    for t in range(PASSES):
        mu = t / (t + 3)
        steps.append(f"""
z{t} as materialized (select doc, y, cw, {each('exp(z# - m) e#')} from (select *, greatest({each('z#')}) m from (
  select lb.doc, y, cw, {each('coalesce(s#, 0.0) + b.v# z#')} from lb join cw using (y)
  join (select * from w{t} where slot = -1) b on true
  left join (select doc, {each('sum(x * v#) s#')} from fx join w{t} using (slot) group by doc) d using (doc)))),
r{t} as materialized (select doc, {each(f'cw * (e# / ({each("e@", " + ").replace("@", "%")}) - (y = #)::int) r#').replace('%', '@')} from z{t}),
g{t} as materialized (select slot, {each('sum(x * r#) g#')} from fx join r{t} using (doc) group by slot
  union all select -1, {each('sum(r#)')} from r{t}),
w{t + 1} as materialized (select slot, {each('a# w#')}, {each(f'a# + {mu!r} * (a# - w#) v#')} from (
  select slot, {each('w#')}, {each(f'v# - {STEP} * (g# / (select count(*) from lb) + case when slot >= 0 then {RIDGE} * v# else 0 end) a#')}
  from w{t} join g{t} using (slot)))""")
    text = ",".join(steps)
    total = " + ".join(f"e{c}" for c in range(k))
    return "with " + text.replace(" + ".join(["e@"] * k), total)


def _score_sql(name: str, src: str, index: int) -> str:
    """Relation (doc, p): the probability of class ``index`` of the texts of ``src``."""
    k = LABELS[name][1]
    z = ", ".join(f"coalesce(s{c}, 0.0) + b.w{c} z{c}" for c in range(k))
    s = ", ".join(f"sum(x * w{c}) s{c}" for c in range(k))
    return f"""sc as (select doc, exp(z{index} - m) / ({' + '.join(f'exp(z{c} - m)' for c in range(k))}) p
  from (select *, greatest({', '.join(f'z{c}' for c in range(k))}) m from (
    select doc, {z} from {src} join (select * from w{PASSES} where slot = -1) b on true
    left join (select doc, {s} from (
      select doc, slot, x / sqrt(sum(x * x) over (partition by doc)) x from (
        select doc, slot, ln(1 + n) * idf x from ({_slots_sql(src)}) join df using (slot))) join w{PASSES} using (slot)
      group by doc) d using (doc))))"""


def model_of(spark, sf, name):
    label, k = LABELS[name]
    d = V.docs(spark, sf).join(V.read_table(spark, sf, "labels"), F.col("id") == F.col("doc_id"))
    d = d.withColumn("txt", T.post_text("title", "selftext", drop_sentinels=False))
    return CL.fit_classifier(d, "txt", F.expr(label), k, PASSES, STEP, RIDGE)[0]


def _reply(name: str, index: int):
    def run(spark, sf):
        model = model_of(spark, sf, name)
        return V.turns(spark, sf).select("id", MD.class_probability(F.col("body"), model, index).alias("sentiment"))
    return run


def _reply_sql(name: str, index: int) -> str:
    return f"""{_training_sql(name)},
tx as (select id doc, body txt from turns),
{_score_sql(name, 'tx', index)}
select doc id, round(p, 6) sentiment from sc"""


query("score_reply_quality", "D1 D2", _reply_sql("quality", 1))(_reply("quality", 1))
query("score_reply_toxic", "D1 D2", _reply_sql("toxic", 1))(_reply("toxic", 1))
query("score_reply_three", "D1 D2", _reply_sql("three", 0))(_reply("three", 0))


@query("score_post_trained", "D1 D3", f"""{_training_sql('toxic')},
tx as (select id || ':t' doc, title txt from docs union all select id || ':s', selftext from docs
       union all select id || ':c', coalesce(title, '') || ' ' || coalesce(selftext, '') from docs),
{_score_sql('toxic', 'tx', 1)}
select d.id, round(a.p, 6) sentiment_title, case when {Q.is_blank('selftext')} then 0.0 else round(b.p, 6) end sentiment_text,
       round(c.p, 6) sentiment_complex
from docs d join sc a on a.doc = d.id || ':t' join sc b on b.doc = d.id || ':s' join sc c on c.doc = d.id || ':c'""")
def score_post_trained(spark, sf):
    """Title, text and joined scores of the posts by the two-class model."""
    model = model_of(spark, sf, "toxic")
    s = V.docs(spark, sf).select("id", MD.post_scores(F.col("title"), F.col("selftext"), model, 1).alias("s"))
    return s.select("id", "s.sentiment_title", "s.sentiment_text", "s.sentiment_complex")
