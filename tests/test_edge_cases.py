"""Hand-made micro tables with expected answers (FIXTURES.md part 3)."""

import math

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import tags as G
from cohortlens.functions import text as T
from cohortlens.functions import time as TM
from cohortlens.operators import aggregates as A
from cohortlens.operators import relational as R
from cohortlens.operators import scores as S
from cohortlens.operators import windows as W
from cohortlens.params import FIXTURE_GROUPS, FIXTURE_LEXICON as LEX, RankWeights
from conftest import rows


def test_parent_repeats_write_and_report(spark):
    # one author, group, month: parents a, a, b, a with scores 1, 0, 2, 3
    df = spark.createDataFrame(
        [("u", "SW", "2020-01", "a", 1, 1, False), ("u", "SW", "2020-01", "a", 2, 0, False),
         ("u", "SW", "2020-01", "b", 3, 2, False), ("u", "SW", "2020-01", "a", 4, 3, False)],
        "author string, community_grp string, month string, parent_id string, created_utc long, score long, "
        "is_submitter boolean")
    posts = spark.createDataFrame([("u",)], "author string")
    w = S.reply_interaction(df, posts).collect()[0]["graph"]
    # write rule: s = 1, 2, 2, 3 -> 3*8 + 9*(2+3)
    assert w == 3 * 8 + 9 * 5
    r = S.reply_interaction(df, None, rule="report").collect()[0]["graph"]
    # report rule: zero -> +1 (not the submitter): s = 1, 1, 2, 3 -> 3*7 + 9*(1+3)
    assert r == 3 * 7 + 9 * 4
    # the windowed flag marks the 2nd and 4th rows
    flags = W.seen_parent(df, ["author", "community_grp", "month"], "parent_id",
                          ["created_utc", "score", "is_submitter"])
    assert rows(flags, "created_utc", "repeat") == [(1, False), (2, True), (3, False), (4, True)]


def test_seen_parent_duplicates_match_window(spark):
    # identical rows: one is first, the others are repeats (as a row_number would say)
    data = [("u", "SW", "m", "a", 5, 1), ("u", "SW", "m", "a", 5, 1), ("u", "SW", "m", "a", 5, 1),
            ("u", "SW", "m", "a", 7, 0), (None, "SW", "m", "b", 1, 1), (None, "SW", "m", "b", 2, 1),
            ("v", "MH", "m", "a", 3, None), ("v", "MH", "m", "a", 3, None)]
    df = spark.createDataFrame(data, "author string, community_grp string, month string, parent_id string, "
                                     "created_utc long, score long")
    keys, order = ["author", "community_grp", "month"], ["created_utc", "score"]
    got = rows(W.seen_parent(df, keys, "parent_id", order))
    want = rows(W.seen_parent_windowed(df, keys, "parent_id", [F.col(c) for c in order]))
    assert got == want


def test_reply_interaction_needs_a_post(spark):
    df = spark.createDataFrame([("x", "SW", "2020-01", "a", 1, 5, False)],
                               "author string, community_grp string, month string, parent_id string, "
                               "created_utc long, score long, is_submitter boolean")
    posts = spark.createDataFrame([("other",)], "author string")
    assert S.reply_interaction(df, posts).count() == 0


def test_minmax_all_equal_is_zero(spark):
    df = spark.createDataFrame([("a", 3), ("b", 3), ("c", 3)], "author string, n long")
    out = W.minmax(df, "n")
    assert [r["n_scaled"] for r in out.collect()] == [0.0, 0.0, 0.0]


def test_quantile_clip(spark):
    df = spark.createDataFrame([(float(x),) for x in list(range(1, 10)) + [1000]], "x double")
    out = {r["x"]: r["x_normalized"] for r in W.clip_minmax(df, "x", 0.9).collect()}
    t = 9 + 0.1 * (1000 - 9)        # linear interpolation at 0.9 of 10 values
    assert out[1000.0] == pytest.approx(1.0)
    assert out[1.0] == 0.0
    assert out[5.0] == pytest.approx((5 - 1) / (t - 1))


def test_empty_cohort_ratios(spark):
    rows_ = spark.createDataFrame([("SW", "post", "a", "SW"), ("SW", "reply", "a", "Otr")],
                                  "cohort string, kind string, author string, community_grp string")
    out = {r["cohort"]: (r["SW"], r["MH"], r["Otr"]) for r in A.activity_ratio(rows_, FIXTURE_GROUPS).collect()}
    assert out["MH"] == (0.0, 0.0, 0.0)
    assert out["Otr"] == (0.0, 0.0, 1.0)
    assert out["SW"] == (0.5, 0.0, 0.5)


def test_no_words_no_pronouns(spark):
    df = spark.createDataFrame([(1, ""), (2, "..."), (3, None), (4, "it and that")], "id long, txt string")
    df = T.with_text_arrays(df, "txt", LEX)
    f = T.language_features("txt", F.col("_toks"), F.col("_tags"), LEX)
    out = {r["id"]: r for r in df.select("id", *[c.alias(k) for k, c in f.items()],
                                         S.pos_score("txt", F.col("_toks"), F.col("_tags"), LEX).alias("pos"))
           .collect()}
    for i in (1, 2, 3):
        assert out[i]["noun_ratio"] == 0.0 and out[i]["first_person_singular_ratio"] == 0.0
        assert out[i]["text_length"] == 0
    assert out[1]["pos"] is None and out[3]["pos"] is None      # blank text: unscored
    assert out[2]["pos"] == 0.0                                  # not blank, no words
    assert out[4]["first_person_singular_ratio"] == 0.5          # 'it' of {'it', 'that'}
    assert out[4]["second_person_ratio"] == 0.5


def test_tie_at_rank_n(spark):
    df = spark.createDataFrame([("c", 1.0), ("a", 1.0), ("b", 1.0)], "author string, score double")
    top = R.rank_rows(R.top_n(df, "score", 2), "score")
    assert rows(top, "rank", "author") == [(1, "a"), (2, "b")]


def test_weight_vs_count(spark):
    posts = spark.createDataFrame([("u", 0.4)], "author string, sentiment_complex double")
    replies = spark.createDataFrame([("u", 0.1), ("u", 0.7)], "author string, sentiment double")
    d17 = S.sentiment_rank(posts, replies).collect()[0]["score"]
    assert d17 == pytest.approx((0.8 + 0.1 + 0.7) / 4)
    d18 = S.integrated_rank(posts, replies, {"sentiment": "sentiment_complex"}, {"sentiment": "sentiment"},
                            RankWeights(components=(("sentiment", 1.0),), norm_ranges=(("sentiment", (0.0, 1.0)),)))
    assert d18.collect()[0]["score"] == pytest.approx((0.8 + 0.1 + 0.7) / 3)


def test_sentinels(spark):
    df = spark.createDataFrame([("[deleted]",), (None,), ("u",)], "author string")
    assert sorted(rows(R.drop_sentinel(df)), key=repr) == sorted([(None,), ("u",)], key=repr)
    st = spark.createDataFrame([("t", "[removed]"), ("t", "[deleted]"), ("t", None), ("t", "body")],
                               "title string, selftext string")
    got = [r[0] for r in st.select(T.post_text("title", "selftext")).collect()]
    assert got == ["t", "t", "t", "t body"]
    kept = [r[0] for r in st.select(T.post_text("title", "selftext", drop_sentinels=False)).collect()]
    assert kept[0] == "t [removed]"


def test_bad_time_and_score(spark):
    df = spark.createDataFrame([("x",), ("",), (None,), ("1388534400",), ("0",)], "c string")
    got = [r[0] for r in df.select(TM.day_tag(F.col("c"))).collect()]
    assert got == [None, None, None, "2014-01-01", None]
    s = spark.createDataFrame([("x",), ("5",), (None,)], "s string")
    assert [r[0] for r in s.select(G.safe_bigint(F.col("s"), default=0)).collect()] == [None, 5, 0]


def test_match_status(spark):
    tgt = spark.createDataFrame([("t1", "k1"), ("t2", "k2"), ("t3", "k2"), ("t4", "k0")], "id string, k string")
    src = spark.createDataFrame([("s1", "k1", 7.0), ("s2", "k2", 8.0), ("s3", "k9", 9.0)], "sid string, k string, v double")
    out, report = R.unique_match_transfer(src, tgt, ["k"], "v", "sid")
    assert rows(out, "id", "transferred") == [("t1", 7.0), ("t2", None), ("t3", None), ("t4", None)]
    assert rows(report, "sid", "status") == [("s1", "updated"), ("s2", "multiple"), ("s3", "none")]


def test_set_fields_and_upsert_keep_keys_unique(spark):
    from cohortlens.sources import sinks as SK
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, w string")
    new = spark.createDataFrame([(1, "x", 5), (1, "y", 4), (3, "z", 1)], "k int, w string, extra int")
    assert rows(SK.set_fields(old, new, "k", ["w"], order=["extra"])) == [(1, "x"), (2, "b")]
    assert rows(SK.upsert(old, new, "k", order=["extra"]), "k", "w", "extra") == [(1, "x", 5), (2, "b", None), (3, "z", 1)]


def test_global_position_with_payload(spark):
    from cohortlens.plans import views as V
    r = V.replies(spark, "/root/testdata/sf0.1")
    cols = r.columns
    out = R.with_global_position(r, [F.col(c) for c in cols])
    n, distinct, top = out.agg(F.count("*"), F.count_distinct("row_number"), F.max("row_number")).first()
    assert n == distinct == top == r.count()


def test_exact_quantile_per_group(spark):
    from cohortlens.operators import windows as W
    data = [(g, float(v % 17)) for g, n in (("a", 100), ("b", 7), (None, 3)) for v in range(n)] + [("a", None)]
    df = spark.createDataFrame(data, "g string, v double")
    want = {r["g"]: r["t"] for r in df.groupBy("g").agg(F.percentile("v", F.lit(0.9)).alias("t")).collect()}
    assert {r["g"]: r["_t"] for r in W.exact_quantile(df, "v", 0.9, ["g"]).collect()} == want


def test_sample_takes_the_smallest_hashes(spark):
    from cohortlens.operators import sampling as M
    df = spark.createDataFrame([(k % 3, f"u{k}") for k in range(3000)], "g int, u string")
    got = rows(M.sample_per_group(df, ["g"], ["u"], 70, "s"), "g", "u")
    h = {r["u"]: r["h"] for r in df.withColumn("h", M.hash_order(["u"], "s")).collect()}
    want = [(g, u) for g in range(3) for u in sorted((f"u{k}" for k in range(g, 3000, 3)), key=h.get)[:70]]
    assert got == sorted(want, key=repr)


def test_matrix_all_is_mean_of_cells(spark):
    data = [("SW", "SW", 1.0)] * 99 + [("SW", "MH", 3.0)]
    df = spark.createDataFrame(data, "cohort string, community_grp string, s double")
    out = {r["community_grp"]: r["mean_score"] for r in A.matrix_mean_all(df, "cohort", "community_grp", "s")
           .collect()}
    assert out["ALL"] == 2.0


def test_histogram_single_value_and_edges(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    h = A.histogram(df, "x", 5).collect()
    assert sum(r["n"] for r in h) == 2 and len(h) == 5
    df2 = spark.createDataFrame([(0.0,), (1.0,), (0.5,)], "x double")
    h2 = {r["bin"]: r["n"] for r in A.histogram(df2, "x", 2).collect()}
    assert h2 == {0: 1, 1: 2}          # the last bin is closed


def test_community_group_priority(spark):
    df = spark.createDataFrame([("1-URGENT/O",), ("1-URGENT/F",), ("x",), (None,)], "c string")
    got = [r[0] for r in df.select(G.community_group("c", FIXTURE_GROUPS)).collect()]
    assert got == ["MH", "SW", "Otr", "Otr"]


def test_cohort_priority(spark):
    df = spark.createDataFrame([("a", "Otr"), ("a", "MH"), ("b", "SW"), ("b", "MH"), ("c", "Otr")],
                               "author string, community_grp string")
    assert rows(A.user_cohorts(df, FIXTURE_GROUPS)) == [("a", "MH"), ("b", "SW"), ("c", "Otr")]


def test_compound_sentiment(spark):
    df = spark.createDataFrame([("the the of",), ("nothing here",)], "t string")
    got = [r[0] for r in df.select(T.compound_sentiment(T.tokens("t"), LEX)).collect()]
    assert got[0] == pytest.approx(1.5 / math.sqrt(1.5 ** 2 + 15))
    assert got[1] == 0.0


def test_tagger_argument(spark):
    df = spark.createDataFrame([("the cat",), ("",), (None,)], "txt string")
    out = T.with_text_arrays(df, "txt", LEX, tagger=lambda toks: F.transform(toks, lambda t: F.lit("NN")))
    assert [r["_tags"] for r in out.collect()] == [["NN", "NN"], [], []]


def test_epoch_reject_reasons(spark):
    df = spark.createDataFrame([(None,), ("",), (" ",), ("x",), ("0",), ("86400",)], "e string")
    got = [(r["r"], r["m"]) for r in df.select(TM.epoch_reject(F.col("e")).alias("r"),
                                               TM.month_tag(F.col("e")).alias("m")).collect()]
    assert got == [("missing", None)] * 3 + [("not a number", None), ("zero", None), (None, "1970-01")]


def test_user_texts_order_nulls_and_copies(spark):
    df = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("a", 2, "y"), (None, 1, "n"), ("b", 5, None)],
                               "author string, at long, txt string")
    got = sorted(((r["author"] or "", r["position"], r["txt"]) for r in A.user_texts(df, "author", ["at"], "txt")
                  .collect()), key=str)
    assert got == sorted([("", 1, "n"), ("a", 1, "x"), ("a", 2, "y"), ("a", 3, "y"), ("b", 1, None)], key=str)


def test_integrated_rank_cells_equal_rows(spark):
    posts = spark.createDataFrame([("u", 0.5), ("u", 0.5), ("v", None)], "author string, s double")
    replies = spark.createDataFrame([("u", 0.2), ("v", 0.4), ("v", 0.4)], "author string, s double")
    cells = [d.groupBy("author", "s").agg(F.count(F.lit(1)).alias("n")) for d in (posts, replies)]
    cols, rw = {"sentiment": "s"}, RankWeights()
    a = rows(S.integrated_rank(posts, replies, cols, cols, rw))
    assert a == rows(S.integrated_rank(*cells, cols, cols, rw, row_weight="n")) and len(a) == 2


def test_user_months_read_the_rows_once(spark):
    from cohortlens.operators import scores as S
    from cohortlens.params import FIXTURE_GROUPS as G
    a, b = G.labels[:2]
    posts = spark.createDataFrame([("u1", a, "2020-01", 4, 2), ("u1", None, "2020-02", 1, 0), ("u1", a, None, 9, 9), ("u2", a, "2020-01", 5, 5)],
                                  "author string, community_grp string, month string, score bigint, num_comments bigint")
    replies = spark.createDataFrame([("u1", b, "2020-01", "p", 1, 3, True), ("u1", b, "2020-01", "p", 2, 2, True)],
                                    "author string, community_grp string, month string, parent_id string, created_utc bigint, score bigint, is_submitter boolean")
    users = spark.createDataFrame([("u1",), (None,)], "author string")
    out = S.user_month_scores(posts, replies, users, G)
    got = {(r.month, r.community_grp, r.kind): r.graph for r in out.collect()}
    assert len(got) == out.count() == 3 * 2 * len(G.labels)
    assert {k: v for k, v in got.items() if v} == {("2020-01", a, "post"): 3.0, ("2020-01", b, "reply"): 33.0}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "LogicalRDD" not in plan
