"""S15 index, S9 byte bound, T2 keyed state, A12 joined text."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import aggregates as A
from cohortlens.sources import sinks as SK
from cohortlens.sources import skipping as SX
from cohortlens.streaming import incremental as ST


@pytest.fixture()
def indexed(spark, tmp_path):
    rows = [(f"a{k % 40}", f"d{k // 25:02d}", None if k % 9 == 0 else f"p{k}", f"2020-{k % 3 + 1:02d}", k) for k in range(600)]
    df = spark.createDataFrame(rows, "author string, day string, parent string, month string, n int")
    table, index = str(tmp_path / "t"), str(tmp_path / "i")
    df.repartitionByRange(12, "month", "author").write.partitionBy("month").parquet(table)
    SX.build_index(spark, table, ["author", "day", "parent"], index)
    return rows, table, index


def test_index_never_misses_and_skips_files(spark, indexed):
    rows, table, index = indexed
    every = {r[0] for r in spark.read.parquet(table).select("_metadata.file_path").distinct().collect()}
    skipped = 0
    for column, at in (("author", 0), ("day", 1), ("parent", 2)):
        for value in sorted({r[at] for r in rows if r[at]})[::9] + ["absent"]:
            files = SX.files_for(spark, index, column, [value])
            holding = {r[0] for r in spark.read.parquet(table).filter(F.col(column) == value).select("_metadata.file_path").distinct().collect()}
            assert holding <= set(files) <= every
            skipped += len(every) - len(files)
            got = sorted(r.n for r in SX.look_up(spark, table, index, column, [value]).collect())
            assert got == sorted(r[4] for r in rows if r[at] == value)
    assert skipped > 0


def test_index_of_several_values_nulls_and_parts(spark, indexed, monkeypatch, tmp_path):
    rows, table, index = indexed
    got = SX.look_up(spark, table, index, "author", ["a1", "a2", None])
    assert sorted(r.n for r in got.collect()) == sorted(r[4] for r in rows if r[0] in ("a1", "a2"))
    assert set(got.columns) == {"author", "day", "parent", "n", "month"}
    assert SX.look_up(spark, table, index, "parent", [None]).count() == 0
    monkeypatch.setattr(SX, "BITS_A_ROW", 20_000)   # many bitmap parts a file
    SX.build_index(spark, table, ["parent"], str(tmp_path / "j"))
    assert spark.read.parquet(str(tmp_path / "j")).agg(F.max("parts")).first()[0] > 1
    for value in ("p1", "p250", "p599"):
        assert SX.look_up(spark, table, str(tmp_path / "j"), "parent", [value]).count() == 1


def test_parts_are_bounded_in_bytes(spark, tmp_path):
    rows = [(k, "x" * (k % 50) + '"q", \n' * (k % 3), None if k % 7 == 0 else float(k)) for k in range(400)]
    df = spark.createDataFrame(rows, "id long, txt string, v double").repartition(3)
    out = str(tmp_path / "csv")
    SK.write_rolling_bytes(df, out, 1000)
    sizes = [os.path.getsize(f) for f in glob.glob(f"{out}/roll=*/*.csv")]
    assert len(sizes) > 12 and max(sizes) <= 1000 + 120
    back = spark.read.schema("id long, txt string, v double, roll string").option("header", True) \
        .option("multiLine", True).option("escape", '"').csv(out)
    assert sorted((r.id, r.txt or "", r.v) for r in back.collect()) == sorted(rows, key=lambda r: r[0])


def _score(df):
    return df.select("id", F.length("txt").alias("score"))


def _write(spark, rows, path, schema="id long, txt string"):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_keyed_state_scores_every_key_once(spark, tmp_path):
    src, seed, sink, ck = (str(tmp_path / x) for x in ("src", "seed", "sink", "ck"))
    _write(spark, [(1,), (2,)], seed, "id long")
    _write(spark, [(1, "old"), (3, "abc"), (3, "ab"), (4, "x")], src)

    def run():
        ST.score_first_seen(spark.readStream.schema("id long, txt string").parquet(src),
                            spark.readStream.schema("id long").parquet(seed), "id", _score, sink, ck)
        return sorted(tuple(r) for r in spark.read.schema("id long, score int").parquet(sink).collect())
    first = run()
    assert first == [(3, 2), (4, 1)]
    assert run() == first                              # nothing new
    _write(spark, [(3, "again"), (2, "old"), (5, "hello"), (4, "y")], src)
    assert run() == [(3, 2), (4, 1), (5, 5)]


def test_keyed_state_restarts_in_mid_run(spark, tmp_path):
    src, seed, sink, ck = (str(tmp_path / x) for x in ("src", "seed", "sink", "ck"))
    fail = tmp_path / "fail"
    _write(spark, [(9,)], seed, "id long")
    _write(spark, [(1, "a"), (9, "z")], src)
    _write(spark, [(1, "b"), (2, "bb")], src)

    def stream():
        r = spark.readStream.schema("id long, txt string").option("maxFilesPerTrigger", 1).parquet(src)
        return _score(ST.first_seen(r, spark.readStream.schema("id long").parquet(seed), "id"))

    def batch(df, epoch):
        if epoch == 1 and fail.exists():
            raise RuntimeError("lost in mid-run")
        df.write.mode("overwrite").parquet(f"{sink}/b{epoch}")
    fail.touch()
    with pytest.raises(Exception):
        stream().writeStream.foreachBatch(batch).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()
    fail.unlink()
    stream().writeStream.foreachBatch(batch).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()
    got = [tuple(r) for f in sorted(glob.glob(f"{sink}/b*")) for r in spark.read.parquet(f).collect()]
    assert sorted(k for k, _ in got) == [1, 2]


@pytest.mark.parametrize("piece", [1, 7, 1000])
def test_joined_text_is_the_users_string(spark, piece):
    rows = [("u", "b", "second"), ("u", "a", "first text"), ("u", "c", None), ("v", "a", ""), (None, "x", "q"), ("u", "d", "ü" * 30)] \
        + [("w", f"{k:03d}", "word" * (k % 4)) for k in range(60)]
    df = spark.createDataFrame(rows, "author string, id string, txt string").repartition(5)
    got = {}
    for r in A.joined_text(df, "author", ["id"], "txt", piece).orderBy("author", "piece").collect():
        assert len(r.txt) == piece or len(r.txt) < piece
        assert r.piece == len(got.get(r.author, []))
        got.setdefault(r.author, []).append(r.txt)
    for who in ("u", "v", "w", None):
        assert "".join(got[who]) == "".join(" " + (t or "") for a, _, t in sorted((x for x in rows if x[0] == who), key=lambda x: x[1]))
        assert all(len(t) == piece for t in got[who][:-1])
