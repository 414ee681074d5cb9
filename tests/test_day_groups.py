"""Day and groups as one long; F11: syllables in one pattern."""

import datetime
import re

from pyspark.sql import functions as F

from cohortlens.functions import tags as G
from cohortlens.functions import text as T
from cohortlens.params import FIXTURE_GROUPS
from cohortlens.plans import catalog


def test_cell_codes_turn_back(spark):
    days = [datetime.date(1, 1, 1), datetime.date(1969, 12, 31), datetime.date(1970, 1, 1), datetime.date(9999, 12, 31)]
    rows = [(d, a, b) for d in days for a in FIXTURE_GROUPS.labels for b in FIXTURE_GROUPS.labels]
    df = spark.createDataFrame(rows, "d date, a string, b string").withColumn("c", G.cell_code("d", "a", "b", FIXTURE_GROUPS))
    got = df.select("d", "a", "b", "c", F.struct(*G.cell_parts("c", FIXTURE_GROUPS)).alias("p")).collect()
    assert all(tuple(r.p) == (r.d, r.a, r.b) for r in got) and len({r.c for r in got}) == len(rows)


def test_day_groups_are_counted_by_one_long(spark):
    p = catalog.queries()["day_group_text"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    keys = [set(re.findall(r"([a-z_]+)#", k)) for k in re.findall(r"Aggregate \[([^\]]*)\]", p)]
    assert keys and all(k <= {"_cell", "tag", "word"} for k in keys)


def test_syllables_equal_plain_python(spark):
    texts = ["", "hmm my strap", "a b c y", "rhythm tsk tsk queue", "strengths brr x" + " pst" * 40, "aeiou" * 9 + " bcd"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.s for r in df.select(T.syllables(T.tokens("t")).alias("s")).collect()]
    assert got == [sum(max(1, len(re.findall("[aeiouy]+", w))) for w in t.split()) for t in texts]
