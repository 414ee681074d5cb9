"""Sources and sinks on hand-made files: bad CSV rows, NUL bytes, embedded
newlines and quotes, long-window zstd, versioned replace, upsert, plug-in scorer."""

import os

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from cohortlens.operators import models as MD
from cohortlens.session import scratch_dir
from cohortlens.sources import files as FS
from cohortlens.sources import sinks as SK
from conftest import rows


def test_csv_quarantine_short_and_long(spark):
    d = scratch_dir(spark, "t-quar")
    os.makedirs(d)
    with open(f"{d}/a.csv", "w") as fh:
        fh.write("1,a,10\n2,b\n3,c,30,extra\n4,d,40\n")
    good, bad = FS.read_csv_quarantine(spark, d, "id long, name string, v long")
    assert rows(good, "id") == [(1,), (4,)]
    assert sorted(r["raw"] for r in bad.collect()) == ["2,b", "3,c,30,extra"]


def test_nul_lines_skipped_and_reported(spark):
    d = scratch_dir(spark, "t-nul")
    os.makedirs(d)
    with open(f"{d}/x.csv", "w") as fh:
        fh.write('id,name\n1,a\n2,b\x00\n3,"c\nd ""e"""\n')
    got, report = FS.read_csv_without_nul(spark, d, "id long, name string", multiline=True)
    assert rows(got) == [(1, "a"), (3, 'c\nd "e"')]
    r = report.collect()[0]
    assert (r["file_name"], r["skipped"], r["loaded"]) == ("x.csv", 1, 2)
    assert spark.conf.get("spark.sql.csv.parser.columnPruning.enabled") == "true"


def test_quoted_csv_round_trip(spark):
    d = scratch_dir(spark, "t-quoted")
    src = spark.createDataFrame([(1, 'say "hi"\nnext line', None), (2, "", "x,y")], "id long, a string, b string")
    SK.write_csv_quoted(src, d)
    back = FS.read_csv(spark, d, "id long, a string, b string", multiline=True, null_value=SK.NULL_MARK)
    assert rows(back) == rows(src)


def test_long_window_zstd(spark):
    d = scratch_dir(spark, "t-long")
    src = spark.range(0, 5000).select(F.col("id").cast("string").alias("id"), (F.col("id") * 2).alias("v"))
    SK.write_zstd_ndjson(src.repartition(3), d, window_log=31)
    back = FS.read_zstd_long_window(spark, d, "id string, v long")
    assert back.count() == 5000
    assert rows(back.filter(F.col("v") == 10)) == [("5", 10)]
    # the JVM codec cannot decode a 2 GB window: the long-window reader is needed
    with pytest.raises(Exception):
        spark.read.schema("id string, v long").json(f"{d}/*.zst").count()


@pytest.mark.parametrize("frame_bytes", [7, 64, None])
def test_zstd_frames_cut_anywhere(spark, frame_bytes):
    """Every line once, whatever the frames and groups cut: also lines longer than a
    group, an end without a line break, and a skippable frame."""
    d = scratch_dir(spark, "t-frames")
    lines = [b"", b"a", b"x" * 300, b"\xff\xfe", "é".encode(), *(b'{"id": %d}' % i for i in range(40))]
    SK.write_zstd_lines(spark.createDataFrame([(bytearray(v),) for v in lines], "value binary").coalesce(1), d,
                        frame_bytes=frame_bytes)
    name = next(f for f in os.listdir(d) if f.startswith("part"))
    with open(f"{d}/{name}", "ab") as fh:
        fh.write(b"\x50\x2a\x4d\x18\x03\x00\x00\x00abc")
        fh.write(zstandard.ZstdCompressor().compress(b"the end"))
    for group in (200, 1 << 20):
        got = [bytes(r["value"]) for r in FS.read_zstd_lines(spark, d, group_bytes=group).collect()]
        assert sorted(got) == sorted([*(v for v in lines if v), b"the end"])
    good, bad = FS.read_zstd_checked(spark, d, "id long", group_bytes=500)
    assert rows(good) == [(i,) for i in sorted(range(40), key=lambda i: repr((i,)))]
    assert sorted((bytes(r["value"]), r["reason"]) for r in bad.collect()) == sorted(
        [(b"\xff\xfe", "bytes"), *((v, "json") for v in (b"a", b"x" * 300, "é".encode(), b"the end"))])


def test_zstd_frames_read_by_many_tasks(spark):
    d = scratch_dir(spark, "t-many")
    src = spark.range(0, 3000).select(F.col("id").cast("string").alias("id")).coalesce(1)
    SK.write_zstd_ndjson(src, d, frame_bytes=src.count() * 14 // 64)
    lines = FS.read_zstd_lines(spark, d, group_bytes=300)
    assert lines.select(F.spark_partition_id()).distinct().count() > 1
    with open(f"{d}/cut.json.zst", "wb") as fh:
        fh.write(zstandard.ZstdCompressor().compress(b"abc" * 1000)[:-3])
    with pytest.raises(Exception, match="cut off"):
        FS.read_zstd_lines(spark, d).count()


def test_routed_missing_kind_is_empty(spark):
    d = scratch_dir(spark, "t-route")
    os.makedirs(d)
    with open(f"{d}/RS_1.csv", "w") as fh:
        fh.write("author,score\nu,1\n")
    out = FS.read_routed(spark, d, {"post": ("RS_*.csv", "author string, score long"),
                                    "reply": ("RC_*.csv", "author string, score long")})
    assert rows(out, "kind", "author") == [("post", "u")]


def test_versioned_replace_reads_latest(spark):
    t = scratch_dir(spark, "t-ver")
    SK.replace_versioned(spark.createDataFrame([(1,)], "x int"), t)
    cur = SK.read_versioned(spark, t)
    SK.replace_versioned(cur.withColumn("y", F.col("x") + 1), t)   # a query over itself
    assert rows(SK.read_versioned(spark, t)) == [(1, 2)]


def test_upsert_and_set_fields(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, None)], "k string, v int, w string")
    new = spark.createDataFrame([("b", 20, None), ("c", 30, "z"), ("c", 31, "z")], "k string, v int, w string")
    up = SK.upsert(old, new, "k")
    got = {r["k"]: (r["v"], r["w"]) for r in up.collect()}
    assert got["a"] == (1, "x") and got["b"] == (20, None) and got["c"][1] == "z"
    vals = spark.createDataFrame([("a", "new"), ("b", "new")], "k string, w string")
    keep = {r["k"]: r["w"] for r in SK.set_fields(old, vals, "k", ["w"], overwrite=False).collect()}
    assert keep == {"a": "x", "b": "new"}
    over = {r["k"]: r["w"] for r in SK.set_fields(old, vals, "k", ["w"], overwrite=True).collect()}
    assert over == {"a": "new", "b": "new"}


def _by_month(spark, name, data):
    d = scratch_dir(spark, name)
    spark.createDataFrame(data, "k string, v int, month string").write.partitionBy("month").parquet(d)
    return d


def _files(spark, d):
    return {(r[0], r[1]) for r in spark.read.parquet(d).select(
        F.col("month").cast("string"), F.col("_metadata.file_name")).distinct().collect()}


def test_upsert_touches_only_its_partitions(spark):
    d = _by_month(spark, "t-part", [("a", 1, "2020-01"), ("b", 2, "2020-02"), ("c", 3, "2020-03"), ("d", 4, None),
                                    ("e", 5, "2020-04"), (None, 6, "2020-01")])
    before = _files(spark, d)
    new = spark.createDataFrame([("b", 20, None), ("b", 19, None), ("e", None, "2020-05"), ("f", 7, None),
                                 ("g", 8, "2020-03")], "k string, v int, month string")
    touched = SK.upsert_partitions(spark, d, new, "k")
    assert set(touched) == {"2020-02", "2020-03", "2020-04", "2020-05", None}
    got = spark.read.parquet(d).select("k", "v", F.col("month").cast("string"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([
        ("a", 1, "2020-01"), (None, 6, "2020-01"), ("b", 20, "2020-02"), ("c", 3, "2020-03"), ("g", 8, "2020-03"),
        ("d", 4, None), ("f", 7, None), ("e", 5, "2020-05")], key=repr)
    kept = _files(spark, d) & before
    assert {m for m, _ in kept} == {"2020-01"}
    assert not any(f.startswith("_staged") for f in os.listdir(d)) and not os.path.exists(f"{d}/month=2020-04")
    assert SK.upsert_partitions(spark, d, new.limit(0), "k") == []
    with pytest.raises(ValueError, match="other"):
        SK.upsert_partitions(spark, d, new.withColumn("other", F.lit(1)), "k")


def test_upsert_from_the_table_itself(spark):
    d = _by_month(spark, "t-self", [("a", 1, "2020-01"), ("b", 2, "2020-02")])
    SK.upsert_partitions(spark, d, spark.read.parquet(d).select("k", (F.col("v") * 10).alias("v")).filter("k = 'b'"), "k")
    assert rows(spark.read.parquet(d), "k", "v") == [("a", 1), ("b", 20)]


def test_emptied_partition_of_any_name_goes(spark):
    d = _by_month(spark, "t-name", [("a", 1, "x y:z%"), ("b", 2, "2020-02")])
    SK.upsert_partitions(spark, d, spark.createDataFrame([("a", 5, "2020-02")], "k string, v int, month string"), "k")
    assert rows(spark.read.parquet(d), "k", "v", "month") == [("a", 5, "2020-02"), ("b", 2, "2020-02")]


def test_loss_between_stage_and_swap_keeps_the_old_rows(spark):
    data = [("a", 1, "2020-01"), ("b", 2, "2020-02")]
    d = _by_month(spark, "t-crash", data)
    before = _files(spark, d)
    staged = SK.stage_partitions(spark.createDataFrame([("b", 9, "2020-02")], "k string, v int, month string"), d, "month")
    assert rows(spark.read.parquet(d), "k", "v") == [("a", 1), ("b", 2)] and _files(spark, d) == before
    SK.swap_partitions(spark, d, staged, "month", ["2020-02"])   # taken up again
    assert rows(spark.read.parquet(d), "k", "v") == [("a", 1), ("b", 9)]
    assert {m for m, _ in _files(spark, d) & before} == {"2020-01"}


def test_set_fields_touches_only_its_partitions(spark):
    d = _by_month(spark, "t-set", [("a", 1, "2020-01"), ("b", None, "2020-02"), ("c", 3, "2020-02")])
    before = _files(spark, d)
    v = spark.createDataFrame([("b", 20), ("c", 30), ("z", 1)], "k string, v int")
    assert SK.set_fields_partitions(spark, d, v, "k", ["v"], overwrite=False) == ["2020-02"]
    assert rows(spark.read.parquet(d), "k", "v") == [("a", 1), ("b", 20), ("c", 3)]
    assert {m for m, _ in _files(spark, d) & before} == {"2020-01"}
    with pytest.raises(ValueError, match="month"):
        SK.set_fields_partitions(spark, d, v.withColumn("month", F.lit("x")), "k", ["month"])


def test_plugin_scorer(spark):
    class UpperShare:
        """A user-supplied scorer: share of upper-case letters (2 classes); defined
        locally, as in a notebook, so it is shipped to the workers by value."""

        def __call__(self):
            def predict(texts):
                p = np.array([sum(c.isupper() for c in t) / max(len(t), 1) for t in texts])
                return np.stack([1 - p, p], axis=1)
            return predict

    df = spark.createDataFrame([("AB",), ("ab",), (None,)], "t string")
    got = [r[0] for r in df.select(MD.class_probability(F.col("t"), UpperShare(), 1)).collect()]
    assert got == [1.0, 0.0, 0.0]
    v = df.select(MD.emotion_vector(F.col("t"), MD.LengthEmotionScorer()).alias("v")).collect()
    assert v[2]["v"] is None and sum(v[0]["v"]) == pytest.approx(1.0)
