"""Keyed state by buckets of keys."""

from cohortlens.streaming import incremental as ST

BIG = (1 << 62) + 1


def _run(spark, tmp_path, buckets, key="long"):
    out = []

    def batch(df, epoch):
        out.extend(tuple(r) for r in df.collect())
    src = spark.readStream.schema(f"id {key}, n long, txt string").parquet(str(tmp_path / "src"))
    seen = ST.first_seen(src, spark.readStream.schema(f"id {key}").parquet(str(tmp_path / "seed")), "id", buckets=buckets)
    q = seen.writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    states = [s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]]
    return out, states


def test_a_state_holds_many_keys(spark, tmp_path):
    spark.createDataFrame([(k,) for k in range(0, 300, 3)], "id long").write.parquet(str(tmp_path / "seed"))
    rows = [(k, BIG + k, f"t{k}") for k in range(300)]
    spark.createDataFrame(rows, "id long, n long, txt string").write.parquet(str(tmp_path / "src"))
    got, states = _run(spark, tmp_path, 4)
    assert sorted(got) == [r for r in rows if r[0] % 3]
    assert states and max(states) <= 5
    assert _run(spark, tmp_path, 4)[0] == []


def test_smallest_row_of_a_key_nulls_and_large_numbers(spark, tmp_path):
    spark.createDataFrame([("s",)], "id string").write.parquet(str(tmp_path / "seed"))
    rows = [("a", BIG + 1, "x"), ("a", BIG, "y"), ("a", None, "z"), (None, 7, "n"), (None, 6, "m"), ("", 1, None), ("s", 1, "q"),
            ("b", None, None)]
    spark.createDataFrame(rows, "id string, n long, txt string").coalesce(1).write.parquet(str(tmp_path / "src"))
    got, _ = _run(spark, tmp_path, 1, "string")
    assert sorted(got, key=repr) == sorted([("a", BIG, "y"), (None, 6, "m"), ("", 1, None), ("b", None, None)], key=repr)
