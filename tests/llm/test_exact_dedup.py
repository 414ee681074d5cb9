"""Operator 13 against brute force: edge cases, hot groups, chance hits."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cohortlens.llm import exact_dedup as X

UP = str.maketrans(X.UPPER, X.LOWER)


def brute(rows):
    """Of (id, text) rows: sorted (id, keep_id, group_size, sha) and the number kept per group."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(UP)].append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(t.encode()).hexdigest()
        out += [(i, keep, len(ids), sha) for i in ids]
    return sorted(out, key=repr)


def run(df):
    t = F.coalesce("text", F.lit(""))
    out = X.exact_groups(df, carry={"sha": F.sha2(F.encode(X.lower_ascii(t), "UTF-8"), 256)}).collect()
    per = defaultdict(int)
    for r in out:
        per[r.sha] += r.kept
    assert all(n == 1 for n in per.values())
    for r in out:
        assert not r.kept or r.doc_id == r.keep_id
    return sorted([(r.doc_id, r.keep_id, r.group_size, r.sha) for r in out], key=repr)


def table(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("len", "row", "carry", "digest", "word", "n"):
        df = df.withColumn(c, F.lit("x"))
    return df


EDGE = [(1, "a"), (1, "A"), (1, "a"), (2, None), (3, ""), (None, ""), (None, "zz"), (None, "ZZ"), (4, "Éa"), (5, "éa"),
        (6, "ÉA"), (7, "İx"), (8, "i̇x"), (9, "p" * 300 + "q"), (10, "p" * 300 + "r"), (11, "P" * 300 + "q"),
        (12, "long " * 50000), (13, "LONG " * 50000), (14, "long " * 49999 + "lonG!"), (-5, "neg"), (-6, "NEG")]


def test_edge_cases(spark):
    assert run(table(spark, EDGE)) == brute(EDGE)


def test_empty_table(spark):
    assert run(table(spark, [])) == []


def test_a_third_equal_a_third_without_id(spark):
    rows = [(k, "Hot text") for k in range(400)] + [(None, f"t{k % 150}") for k in range(400)] + \
        [(k + 400, f"u{k % 300}") for k in range(400)]
    assert run(table(spark, rows)) == brute(rows)


@pytest.mark.parametrize("bits", [6, 8])
def test_a_full_bitmap_loses_nothing(spark, monkeypatch, bits):
    monkeypatch.setattr(X, "FILTER_BITS", bits)
    rows = [(k, f"text {k % 70} " + "x" * (k % 9)) for k in range(500)] + EDGE
    assert run(table(spark, rows)) == brute(rows)


def test_kept_rows_have_the_columns_of_the_input(spark):
    df = table(spark, EDGE)
    kept = X.exact_dedup(df)
    assert kept.columns == df.columns
    assert kept.count() == len({(t or "").translate(UP) for _, t in EDGE})


def test_main_path_is_native(spark):
    out = X.exact_groups(table(spark, EDGE))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "MapIn" not in plan
