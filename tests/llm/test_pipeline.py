"""The stages of ``corpus_pipeline`` against plain Python."""

from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline as P

from . import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, k) for k, (i, t, s) in enumerate(rows)], DOCS)


def sayings(seed=5):
    r = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(400)]
    return lambda n: " ".join(r.choice(words, n))


# ---------------------------------------------------------------- near-dedup
def check_groups(spark, rows):
    """``n_chars`` numbers the rows: one row stays of each component, of its smallest id."""
    kept = {r["n_chars"]: r for r in P.one_of_each_group(spark, table(spark, rows), "").collect()}
    prints = [brute.fingerprint(t) for _, t, _ in rows]
    root = brute.components(range(len(rows)), prints)
    low = brute.components([i for i, _, _ in rows], prints)
    assert sorted(root[k] for k in kept) == sorted(set(root))
    for k, r in kept.items():
        assert (r["doc_id"], r["text"], r["source"]) == rows[k] and r["doc_id"] == low[k]
    return kept


def test_near_dedup_keeps_unrelated_texts_without_id(spark):
    say = sayings()
    a = say(80)
    rows = [(None, say(60), "s1") for _ in range(12)] + [(7, a, "s1"), (None, a, "s1"), (None, a, "s2"), (None, None, "s1")]
    kept = check_groups(spark, rows)
    assert len(kept) == 14 and sum(r["doc_id"] is None for r in kept.values()) == 13


def test_near_dedup_keeps_each_group_of_a_shared_id(spark):
    say = sayings()
    a, b, c = say(80), say(80), say(80)
    assert len(check_groups(spark, [(3, a, "s1"), (3, b, "s1"), (4, b, "s2"), (3, c, "s1"), (5, a, "s1"), (3, c, "s1")])) == 3


def test_near_dedup_keeps_one_of_rows_that_differ_in_nulls(spark):
    """The row hash tells a null from a value in the next column, and whole copies stay once."""
    rows = [(1, "one two", None), (1, "one two", "one two"), (1, None, "one two"), (None, None, "one two")]
    assert len(check_groups(spark, rows)) == 2
    same = spark.createDataFrame([(1, "one two", "en", "s", 5)] * 3 + [(None, "else", "en", "s", 5)] * 2, DOCS)
    assert P.one_of_each_group(spark, same, "").count() == 2


# ---------------------------------------------------------------- the other stages
CLASH = ("__t", "__h", "__d", "row", "good", "score", "times", "nth", "position", "bucket", "text_hash", "hit_id", "shard", "slot")


def clashing(spark, rows):
    """Documents with columns that are named like the stages' own, numbered by ``n_chars``."""
    from pyspark.sql import functions as F
    df = table(spark, rows)
    for c in CLASH:
        df = df.withColumn(c, F.concat(F.lit(c), F.col("n_chars").cast("string")))
    return df


def folder(spark, tmp_path, benchmark=(), labels=(), documents=None):
    spark.createDataFrame(list(benchmark), "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    if documents is not None:
        documents.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def mixed_rows(n=60):
    say = sayings(11)
    a = say(90)
    rows = [(k, say(40 + k), f"s{k % 3}") for k in range(n)] + [(n, a, "s0"), (n + 1, a, "s1"), (n + 1, a, "s1"), (None, a, None)]
    return rows + [(None, say(30), None), (None, None, "s2"), (n + 2, "", "s0"), (n + 2, "  ", "s1"), (n + 3, None, None)]


def unchanged(kept, rows):
    """Every row that stays has all its columns as they came."""
    for r in kept:
        i, t, s = rows[r["n_chars"]]
        assert (r["doc_id"], r["text"], r["source"]) == (i, t, s)
        assert all(r[c] == f"{c}{r['n_chars']}" for c in CLASH)


def test_quality_keeps_whole_rows_and_drops_what_it_calls_bad(spark, tmp_path):
    from cohortlens.llm.quality import quality
    from pyspark.sql import functions as F
    rows = [(k, ("plain words of a good text number " * 9 + str(k)) if k % 3 else "$$ !! 00 ## " * 20 + str(k), f"s{k % 2}")
            for k in range(90)] + [(None, None, None), (1000, "", "s0")]
    labels = [(k, int(k % 3 > 0), 0) for k in range(60)]
    d = folder(spark, tmp_path, labels=labels)
    docs = clashing(spark, rows)
    kept = P.keep_quality(spark, docs, d).collect()
    assert len(kept[0]) == len(docs.columns)
    unchanged(kept, rows)
    good = {r["n"] for r in quality(docs, spark.read.parquet(f"{d}/labels.parquet"), F.col("source"), F.col("lang"))
            .filter("good").select(F.col("row.n_chars").alias("n")).collect()}
    assert {r["n_chars"] for r in kept} == good
    held = {k for k in range(60, 90)}
    assert {k for k in held if k % 3} <= good and not {k for k in held if not k % 3} & good


def test_near_dedup_carries_clashing_columns(spark):
    rows = mixed_rows()
    docs = clashing(spark, rows)
    out = P.one_of_each_group(spark, docs, "")
    assert out.columns == docs.columns
    kept = out.collect()
    unchanged(kept, rows)
    root = brute.components(range(len(rows)), [brute.fingerprint(t) for _, t, _ in rows])
    assert sorted(root[r["n_chars"]] for r in kept) == sorted(set(root))


def test_decontamination_against_plain_python(spark, tmp_path):
    rows = mixed_rows()
    words = rows[5][1].split()
    items = [("b1", " ".join(words[3:15])), ("b2", "Not In Any Document At All Of Them Here Now Or Ever"), ("b3", None), ("b4", rows[8][1].upper())]
    docs = clashing(spark, rows)
    kept = P.without_benchmark(spark, docs, folder(spark, tmp_path, items)).collect()
    unchanged(kept, rows)
    want = [k for k, r in enumerate(brute.op9([(i, t) for i, t, _ in rows], [x for x in items if x[1]])) if not r[5]]
    assert sorted(r["n_chars"] for r in kept) == want and 5 not in want and 8 not in want


def test_mixing_takes_near_the_targets(spark):
    rows = mixed_rows()
    kept = P.mix_sources(spark, clashing(spark, rows), "").collect()
    unchanged(kept, rows)
    times = Counter(r["n_chars"] for r in kept)
    assert max(times.values()) <= 3
    size = [len(brute.WORD.findall(brute.raw_of(t))) for _, t, _ in rows]
    sizes = defaultdict(int)
    for (_, _, s), n in zip(rows, size):
        sizes[s] += n
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    total, left = sum(sizes.values()), dict(sizes)
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, free = {}, set(order)
    while free:
        rest = total - sum(target.values())
        over = [s for s in free if rest * weight[s] / sum(weight[x] for x in free) > 3 * left[s]]
        for s in over or list(free):
            target[s] = 3 * left[s] if over else rest * weight[s] / sum(weight[x] for x in free)
        free -= set(over or free)
    for s in order:
        taken = sum(times[k] * size[k] for k, r in enumerate(rows) if r[2] == s)
        assert abs(taken - target[s]) <= max(size)


def test_sharding_is_a_permutation_with_names_kept_apart(spark):
    rows = mixed_rows()
    docs = clashing(spark, rows)
    out = P.into_shards(spark, docs, "")
    shard, slot = out.columns[-2:]
    assert out.columns[:-2] == docs.columns and shard not in docs.columns and slot not in docs.columns
    got = out.collect()
    unchanged(got, rows)
    assert sorted(r["n_chars"] for r in got) == list(range(len(rows)))
    per = Counter(r[shard] for r in got)
    assert max(per.values()) - min(per.values()) <= 1
    for s, n in per.items():
        assert sorted(r[slot] for r in got if r[shard] == s) == list(range(n))


def test_run_equals_its_stages_and_leaves_nothing_to_do(spark, tmp_path):
    rows = mixed_rows(40)
    labels = [(k, 1, 0) for k in range(30)]
    items = [("b1", " ".join(rows[5][1].split()[3:15]))]
    d = folder(spark, tmp_path, items, labels, clashing(spark, rows))
    got = P.run(spark, d).collect()
    unchanged(got, rows)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    left = {}
    for name, stage in P.STAGES[:-1]:
        docs = P.C.store(stage(spark, docs, d), f"test-{name}")
        left[name] = Counter(r["n_chars"] for r in docs.collect())
    assert Counter(r["n_chars"] for r in got) == left["mixing"]
    assert 5 not in left["mixing"] and set(left["decontamination"]) <= set(left["near_dedup"]) <= set(left["quality"])


def test_every_stage_takes_an_empty_table(spark, tmp_path):
    d = folder(spark, tmp_path, documents=table(spark, []))
    for _, stage in P.STAGES:
        assert stage(spark, table(spark, []), d).count() == 0
    assert P.run(spark, d).count() == 0
