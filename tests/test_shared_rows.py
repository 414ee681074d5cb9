"""Operators that read an intermediate in several branches store it: no branch goes back to the sources."""

from pyspark.sql import functions as F

from cohortlens.operators import sampling as M
from cohortlens.operators import scores as S
from cohortlens.params import FIXTURE_GROUPS
from cohortlens.sources import skipping as SX


def _stored(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).write.parquet(path)
    return spark.read.parquet(path)


def test_comm_scores_go_back_to_no_source(spark, tmp_path):
    g = FIXTURE_GROUPS.labels[0]
    schema = "author string, month string, community_grp string, partner string"
    p = _stored(spark, [(f"a{k % 5}", "2020-01", g, None) for k in range(20)], schema, str(tmp_path / "src-p"))
    r = _stored(spark, [(f"a{k % 3}", "2020-01", g, f"s{k % 4}") for k in range(12)], schema, str(tmp_path / "src-r"))
    c = _stored(spark, [(f"a{k}", "X") for k in range(4)], "author string, cohort string", str(tmp_path / "src-c"))
    got = S.comm_scores(p, r, FIXTURE_GROUPS, cohorts=c)
    assert not [f for f in got.inputFiles() if "/src-" in f]
    assert {x["author"]: (x["interactions"], x["partners"]) for x in got.collect()} == {
        "a0": (8, 4), "a1": (8, 4), "a2": (8, 4), "a3": (4, 0)}


def test_sample_goes_back_to_no_source_and_moves_few_rows(spark, tmp_path):
    df = _stored(spark, [(k % 3 or None, f"u{k}") for k in range(3000)], "g int, u string", str(tmp_path / "src-s"))
    got = M.sample_per_group(df, ["g"], ["u"], 40, "s")
    assert not [f for f in got.inputFiles() if "/src-" in f]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    want = {}
    for r in df.withColumn("h", M.hash_order(["u"], "s")).orderBy("h").collect():
        want.setdefault(r["g"], []).append(r["u"])
    assert sorted((r["g"] or 0, r["u"]) for r in got.collect()) == sorted((g or 0, u) for g, us in want.items() for u in us[:40])


def test_index_holds_the_bits_of_every_value(spark, tmp_path):
    """Values that repeat in a file, nulls and several files: the index has each part's least
    and most value and the bits of its values, no others."""
    rows = [(f"a{k % 7}", None if k % 4 == 0 else f"p{k}") for k in range(300)]
    table, index = str(tmp_path / "t"), str(tmp_path / "i")
    spark.createDataFrame(rows, "author string, parent string").repartition(3, "author").write.parquet(table)
    SX.build_index(spark, table, ["author", "parent"], index)
    got = {(r["column"], r["file"], r["part"]): (r["least"], r["most"], {8 * k + j for k, x in enumerate(r["bits"]) for j in range(8) if x >> j & 1})
           for r in spark.read.parquet(index).collect()}
    t = spark.read.parquet(table)
    want = {}
    for key in ("author", "parent"):
        v = F.col("v")
        seen = t.select(F.col("_metadata.file_path").alias("f"), F.col(key).alias("v")).filter("v is not null").select(
            "f", "v", SX._part(v, F.lit(1)).alias("part"), *[SX._place(v, k).alias(f"p{k}") for k in range(SX.HASHES)])
        for r in seen.collect():
            least, most, bits = want.get((key, r["f"], r["part"]), (r["v"], r["v"], set()))
            want[key, r["f"], r["part"]] = (min(least, r["v"]), max(most, r["v"]), bits | {r[f"p{k}"] for k in range(SX.HASHES)})
    assert got == want


def test_cells_of_a_user_are_not_shuffled(spark):
    from cohortlens.plans import q_reshape as QR
    sf = "/root/testdata/sf0.001"
    plan = QR._wide(spark, sf)._jdf.queryExecution().executedPlan().toString()
    above = plan[:plan.index("Generate explode")]  # the tree's upper part: what is done with the cells
    assert above.count("Aggregate") >= 2 and "Exchange" not in above


def test_months_without_a_cell(spark):
    from cohortlens.operators import scores as S
    from cohortlens.params import FIXTURE_GROUPS as G
    posts = spark.createDataFrame([("u", G.labels[0], "2020-01", 2, 4), ("u", "other", "2020-02", 1, 1), ("u", G.labels[0], None, 1, 1),
                                   ("v", None, "2020-03", 1, 1), ("w", G.labels[0], "2020-04", 1, 1)],
                                  "author string, community_grp string, month string, score long, num_comments long")
    replies = spark.createDataFrame([("v", G.labels[1], "2020-05", "a", 1, 5, False), ("x", G.labels[1], "2020-05", "a", 1, 5, False),
                                     ("v", G.labels[1], "2020-05", "a", 1, 5, False)],
                                    "author string, community_grp string, month string, parent_id string, created_utc long, score long, is_submitter boolean")
    users = spark.createDataFrame([("u",), ("v",)], "author string")
    out = S.user_month_scores(posts, replies, users, G)
    assert out.columns == ["author", "community_grp", "month", "kind", "graph"]
    got = {(r.author, r.month, r.community_grp, r.kind): r.graph for r in out.collect()}
    months = {("u", "2020-01"), ("u", "2020-02"), ("u", None), ("v", "2020-03"), ("v", "2020-05")}
    assert got.keys() == {(a, m, g, k) for a, m in months for g in G.labels for k in ("reply", "post")}
    assert {k: v for k, v in got.items() if v} == {("u", "2020-01", G.labels[0], "post"): 3.0, ("v", "2020-05", G.labels[1], "reply"): 75.0}


def test_weighted_rank_reads_stored_joins_only(spark):
    from cohortlens.plans import q_scores as QS
    files = QS.integrated_rank_weighted(spark, "/root/testdata/sf0.001").inputFiles()
    assert any("/reply-scores-" in f for f in files) and any("/post-scores-" in f for f in files)
    assert not [f for f in files if "/treplies-" in f or "sf0.001" in f]  # no join of an earlier step is open
