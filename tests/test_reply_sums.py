"""Authors are looked up for the scores, not for the replies."""

from cohortlens.operators import scores as S


def test_authors_are_looked_up_behind_the_sums(spark):
    rows = [("a", "g", "m", "p", 1, 2), ("a", "g", "m", "p", 2, 4), ("b", "g", "m", "p", 1, 5), (None, "g", "m", "p", 1, 5)]
    r = spark.createDataFrame(rows, "author string, community_grp string, month string, parent_id string, created_utc long, score long")
    out = S.reply_interaction(r, spark.createDataFrame([("a",), ("a",), (None,)], "author string"))
    p = out._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= p.index("LeftSemi") < p.index("min_by")
    assert [tuple(x) for x in out.collect()] == [("a", "g", "m", 3 * 6 + 9 * 4)]
