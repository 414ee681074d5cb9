"""Every dealt operator against brute force: edge cases and the smallest tables."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from cohortlens.llm import attention, registry
from cohortlens.llm import common as C
from cohortlens.llm.decontaminate import decontaminate, winnow
from cohortlens.llm.lm import MIX, lm_scores
from cohortlens.llm.mixing import mixture, words_of
from cohortlens.llm.quality import quality
from cohortlens.llm.recompress import recompression_dedup, window_names
from cohortlens.llm.sharding import shard
from cohortlens.llm.simhash import budgets, link_runs, simhash_components
from cohortlens.llm.suffix_dedup import COVERS, cover_for, suffix_dedup
from cohortlens.llm.topk import top_k
from cohortlens.llm.toxicity import remainder, toxicity

from . import brute

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, lang string, chunk string, n long, bucket int, row string"


def documents(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, s, "en", "x", 1, 2, "y") for i, t, s in rows], DOCS)


def edge_rows():
    r = np.random.default_rng(3)
    words = [f"w{k}" for k in range(300)]
    say = lambda n: " ".join(r.choice(words, n))
    a, b, c = say(120), say(60), say(40)
    return [(1, a, "s1"), (2, a, "s1"), (3, a + " " + b, "s2"), (4, b + "\n\t" + c, None), (5, None, "s1"), (6, "", "s2"),
            (7, "   ", None), (8, "one", "s1"), (9, "Ünï códe Ünï códe", "s3"), (10, "x " * 500, "s1"),
            (11, "y " + "x " * 300, "s2"), (12, c.upper(), "s1"), (13, say(5000), "s1"), (14, c + " " + c + " " + c, "s3"),
            (14, c + " tail", "s3"), (15, a, "s1"), (15, a, "s1"), (None, b, "s1"), (None, None, None),
            (16, "z" * 900, "s1"), (17, "z" * 450 + "q", "s1"), (18, " ".join(reversed(b.split())), "s2")]


@pytest.fixture(scope="module")
def edge(spark):
    return documents(spark, edge_rows())


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, [])


def pairs():
    return [(i, t) for i, t, _ in edge_rows()]


def got(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def small(spark):
    rows = C.table(spark, SF, "documents").select("doc_id", "text").collect()
    return [(r[0], r[1]) for r in rows]


# ---------------------------------------------------------------- op 1
def digest1(df):
    size = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"])
    return df.select("doc_id", "n_bytes", size.alias("r"), F.size("spans").alias("s"), F.sha2("kept", 256).alias("k"))


@pytest.mark.parametrize("length", [20, 200])
def test_suffix_dedup_edges(edge, length):
    assert got(digest1(suffix_dedup(edge, length=length)), "doc_id", "n_bytes", "r", "s", "k") == \
        sorted(brute.op1(pairs(), length), key=repr)


def test_suffix_dedup_table(spark):
    q = registry.queries()["op1_suffix_array_dedup"](spark, SF)
    assert got(q, *q.columns) == sorted(brute.op1(small(spark)), key=repr)


def test_covers():
    for v, d in COVERS.items():
        assert {(a - b) % v for a in d for b in d} == set(range(v))
    assert cover_for(200)[0] == 133


# ---------------------------------------------------------------- op 4
@pytest.mark.parametrize("width", [3, 13])
def test_recompression_edges(edge, width):
    out = recompression_dedup(edge, width=width).withColumn("k", F.sha2(F.encode("kept", "UTF-8"), 256))
    assert got(out, "doc_id", "n_words", "n_removed", "k") == sorted(brute.op4(pairs(), width), key=repr)


def test_recompression_table(spark):
    q = registry.queries()["op4_recompression_dedup"](spark, SF)
    assert got(q, *q.columns) == sorted(brute.op4(small(spark)), key=repr)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=30), min_size=1, max_size=4), st.integers(1, 9))
def test_window_names_are_the_windows(docs, width):
    first = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    codes = C.splitmix(3, 5)[np.array([x for d in docs for x in d], int)] if first[-1] else np.zeros(0, np.uint64)
    at, names, _ = window_names(codes, first, width)
    flat, known = codes.tolist(), {}
    want = [p for a, z in zip(first, first[1:]) for p in range(a, z - width + 1)]
    assert at.tolist() == want
    for p, name in zip(at.tolist(), names.tolist()):
        assert known.setdefault(tuple(flat[p:p + width]), name) == name
    assert len(set(known.values())) == len(known)


# ---------------------------------------------------------------- op 9
def test_decontamination_edges(spark, edge):
    t = dict((i, t) for i, t in pairs())
    items = [(1, " ".join(t[1].split()[20:45])), (2, t[4][:90]), (3, "códe"), (4, None), (5, ""), (6, "X x X"),
             (7, " ".join(t[1].split()[20:45])), (None, t[12]), (10, "Ünï. CÓDE"), (9, t[18])]
    df = spark.createDataFrame(items, "item_id long, text string").withColumn("h", F.lit(1))
    out = decontaminate(edge, df).select("doc_id", "n_words", "n_hit", F.size("items").alias("m"),
                                         F.sha2(F.encode(F.concat_ws(",", "items"), "UTF-8"), 256).alias("s"),
                                         (F.col("n_hit") > 0).alias("c"))
    want = brute.op9(pairs(), [(i, t) for i, t in items if i is not None])
    named = [r[:3] for r in want]
    full = decontaminate(edge, df.filter("item_id is not null"))
    full = full.select("doc_id", "n_words", "n_hit", F.size("items").alias("m"),
                       F.sha2(F.encode(F.concat_ws(",", "items"), "UTF-8"), 256).alias("s"), (F.col("n_hit") > 0).alias("c"))
    assert got(full, *full.columns) == sorted(want, key=repr)
    assert out.count() == len(named)


def test_decontamination_table(spark):
    items = [(r[0], r[1]) for r in C.table(spark, SF, "benchmark").select("item_id", "text").collect()]
    q = registry.queries()["op9_winnowing_decontamination"](spark, SF)
    assert got(q, *q.columns) == sorted(brute.op9(small(spark), items), key=repr)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 20), min_size=1, max_size=40), st.integers(1, 6))
def test_winnowing_guarantee(hashes, span):
    h = np.array(hashes, np.uint64)
    kept = set(winnow(h, np.arange(len(h)), np.zeros(len(h), int), span).tolist())
    for p in range(len(h) - span + 1):
        assert any(k in kept and h[k] == h[p:p + span].min() for k in range(p, p + span))


# ---------------------------------------------------------------- op 10
def digest10(df):
    return df.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("f"), "component_id")


def test_simhash_edges(edge):
    assert got(digest10(simhash_components(edge)), "doc_id", "f", "component_id") == sorted(brute.op10(pairs()), key=repr)


def test_simhash_table(spark):
    q = registry.queries()["op10_simhash_near_dedup"](spark, SF)
    assert got(q, *q.columns) == sorted(brute.op10(small(spark)), key=repr)


@pytest.mark.parametrize("bits", [1, 2, 3, 5, 7])
def test_pigeonring_finds_every_link(spark, bits):
    from cohortlens.llm import simhash
    r = np.random.default_rng(bits)
    base = r.integers(0, 1 << 63, 12, dtype=np.uint64)
    prints = set(base.tolist())
    for b in base.tolist():
        for _ in range(25):
            x = b
            for k in r.integers(0, 64, r.integers(0, bits + 3)).tolist():
                x ^= 1 << k
            prints.add(x)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    old, simhash.BLOCK = simhash.BLOCK, 16  # hot buckets are cut into blocks
    try:
        edges = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.links(df, bits).collect()]
    finally:
        simhash.BLOCK = old
    assert all((a ^ b).bit_count() <= 64 for a, b in edges)
    place = {p: k for k, p in enumerate(prints)}
    root = list(range(len(prints)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    for a, b in edges:
        root[find(place[a])] = find(place[b])
    mine = {}
    for k in range(len(prints)):
        mine.setdefault(find(k), set()).add(k)
    want = {}
    for k, c in enumerate(brute.components(list(range(len(prints))), prints, bits)):
        want.setdefault(c, set()).add(k)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


def test_budgets():
    assert budgets(3) == (5, 10)


# ---------------------------------------------------------------- op 3
def check_shards(rows, n, shards=8):
    assert len(rows) == n
    per = defaultdict(list)
    for r in rows:
        per[r["shard"]].append(r["slot"])
    for s in per.values():
        assert sorted(s) == list(range(len(s)))
    assert n < shards or max(map(len, per.values())) - min(map(len, per.values())) <= 1
    assert set(per) <= set(range(shards))


def test_sharding_edges(edge):
    rows = shard(edge).collect()
    check_shards(rows, edge.count())
    assert Counter(r["row"]["text"] for r in rows) == Counter(t for _, t, _ in edge_rows())
    again = shard(edge.repartition(5)).collect()
    key = lambda r: (repr(r["row"]), r["shard"], r["slot"])
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_sharding_table(spark):
    q = registry.queries()["op3_sharding"](spark, SF)
    rows = q.collect()
    check_shards(rows, 200)
    text = dict(small(spark))
    for r in rows:
        raw = brute.raw_of(text[r["doc_id"]])
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
    # a shuffle: neighbours in id are not neighbours in place
    place = {r["doc_id"]: r["slot"] * 8 + r["shard"] for r in rows}
    order = [place[i] for i in sorted(place)]
    assert abs(np.corrcoef(order, range(len(order)))[0, 1]) < 0.25


def test_shards_written(spark, edge, tmp_path):
    from cohortlens.llm.sharding import write_shards
    write_shards(edge, f"{tmp_path}/out", shards=4)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == edge.count() and set(edge.columns) < set(back.columns)


# ---------------------------------------------------------------- op 6
def check_mix(rows, sizes):
    want = brute.water(sizes)
    taken, top = Counter(), Counter()
    for s, size, total, target, t in rows:
        assert total == sizes[s] and math.isclose(target, want[s], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= t <= 3 * size
        taken[s] += t
        top[s] = max(top[s], size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= top[s] / 2 + 1e-6


def test_mixing_edges(edge):
    rows = mixture(edge, F.col("source"), words_of("text"), [F.col("doc_id"), F.xxhash64("text")]) \
        .select("row.source", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("t")).collect()
    sizes = Counter()
    for _, t, s in edge_rows():
        sizes[s] += len(brute.WORD.findall(brute.raw_of(t)))
    check_mix([tuple(r) for r in rows], sizes)


def test_mixing_table(spark):
    source = {r[0]: r[1] for r in C.table(spark, SF, "documents").select("doc_id", "source").collect()}
    rows = registry.queries()["op6_mixing"](spark, SF).collect()
    sizes = Counter()
    for i, t in small(spark):
        sizes[source[i]] += len(brute.WORD.findall(brute.raw_of(t)))
    check_mix([(source[r["doc_id"]], r["size"], r["source_size"], r["target"], r["taken"]) for r in rows], sizes)
    again = registry.queries()["op6_mixing"](spark, SF)
    assert got(again, *again.columns) == sorted(map(tuple, rows), key=repr)


def test_mixing_one_size_sources(spark):
    """Water-filling clamps small sources and shares the excess."""
    rows = [(k, "w " * n, s) for k, (s, n) in enumerate([("a", 1000), ("b", 10), ("c", 5), ("d", 0)] * 3)]
    out = mixture(documents(spark, rows), F.col("source"), words_of("text"), [F.col("doc_id")]).collect()
    check_mix([(r["row"]["source"], r["size"], r["source_size"], r["target"], r["size"] * r["times"]) for r in out],
              {"a": 3000, "b": 30, "c": 15, "d": 0})


# ---------------------------------------------------------------- op 5
def test_topk_edges(spark):
    r = np.random.default_rng(0)
    vecs = [(i, r.integers(-3, 4, 6).astype(float).tolist()) for i in range(0, 230)]
    vecs += [(250, None), (300, [1.0, float("nan")]), (350, [1.0, None, 2.0]), (400, []), (450, [0.25, -0.126]), (451, [0.1] * 9),
             (None, [1.0]), (500, [float("inf")]), (7, vecs[7][1]), (550, [0.0] * 6)]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<double>").withColumn("block", F.lit(1))
    out = top_k(df, F.col("vec_id") % 50 == 0)
    assert got(out, "query_id", "rank", "vec_id", "score") == sorted(brute.op5(vecs), key=repr)
    few = df.filter("vec_id in (0, 3, 4)")
    assert got(top_k(few, F.col("vec_id") % 50 == 0), "query_id", "rank", "vec_id", "score") == \
        sorted(brute.op5([v for v in vecs if v[0] in (0, 3, 4)]), key=repr)


# ---------------------------------------------------------------- op 8
def test_lm_edges_and_table(spark, edge):
    for df, rows in ((edge, pairs()), (C.table(spark, SF, "documents"), small(spark))):
        out = lm_scores(df).collect()
        want = sorted(brute.op8_base(rows), key=lambda r: (repr(r[0]), r[5]))
        mine = sorted((tuple(r) for r in out), key=lambda r: (repr(r[0]), r[5]))
        assert [r[:5] for r in mine] == [r[:5] for r in want]
        assert np.allclose([r[5] for r in mine], [r[5] for r in want])
        assert all(r["score"] < 0 for r in out)
        # the mixture loses at most its weight a token
        assert all(r["score"] >= r["base_score"] + r["n_tokens"] * math.log10(MIX) - 1e-6 for r in out)


def test_lm_is_a_distribution():
    """Class and inside shares sum to one, and the context is causal."""
    r = np.random.default_rng(0)
    n = 300
    codes = attention.Codes(r.integers(0, 50, n).astype(float), r.random(n) < .5)
    m = {k: v * 2 for k, v in attention.start_model(codes, 1).items()}
    head = r.integers(0, n, 40)
    total = sum(math.exp(attention.token_logs(m, codes, np.append(head, i), np.array([0, 41]), 0)[-1]) for i in range(n))
    assert math.isclose(total, 1, rel_tol=1e-3)
    a = attention.token_logs(m, codes, head, np.array([0, 40]), 0)
    b = attention.token_logs(m, codes, np.append(head[:30], head[:10]), np.array([0, 40]), 0)
    assert np.allclose(a[:30], b[:30], atol=1e-4)


def test_lm_model_learns():
    """A pattern that only context can predict is learned."""
    r = np.random.default_rng(0)
    seqs = [np.tile(r.permutation(20)[:4], 30).astype(np.int32) for _ in range(200)]
    counts = np.bincount(np.concatenate(seqs), minlength=64).astype(float)
    codes = attention.Codes(counts, np.ones(64, bool))
    ids = np.concatenate(seqs)
    first = np.arange(0, len(ids) + 1, 120)
    x, place = attention.spans(attention.inputs(codes, ids, first, 63), first, codes.symbol[63])
    y = np.where(place >= 0, codes.cls[ids][np.maximum(place, 0)], -1)
    m = attention.start_model(codes)
    for seed in range(3):
        m = attention.go_on(m, x, y, 0.03, seed)
    logs = attention.token_logs(m, codes, ids, first, 63)
    assert logs.mean() > np.log(1 / 20) + 0.5


# ---------------------------------------------------------------- op 2, op 7
def test_toxicity(spark, edge):
    q = registry.queries()["op2_toxicity"](spark, "/root/testdata/sf0.01")
    rows = {r["doc_id"]: r for r in q.collect()}
    labels = {r["doc_id"]: r["toxic"] for r in C.table(spark, "/root/testdata/sf0.01", "labels").collect()}
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    test = [(rows[i]["score"], y) for i, y in labels.items() if rows[i]["held_out"]]
    good, bad = [s for s, y in test if y], [s for s, y in test if not y]
    assert np.mean([a > b for a in good for b in bad]) > 0.7  # few labels at this size
    labels = spark.createDataFrame([(1, 1), (3, 0), (13, 0), (None, 1), (5, None), (6, 7)], "doc_id long, toxic int")
    for lab in (labels, labels.filter("false"), labels.filter("toxic = 1")):
        out = toxicity(edge, lab, remainder("doc_id", 4) != 2).collect()
        assert len(out) == len(pairs()) and all(0 <= r["score"] <= 1 for r in out)


def test_quality(spark, edge):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in registry.queries()["op7_quality_classifier"](spark, sf).collect()}
    labels = [(r["doc_id"], r["quality"]) for r in C.table(spark, sf, "labels").collect()]
    assert len(rows) == 1000
    right = np.mean([rows[i]["good"] == bool(y) for i, y in labels])
    assert right > 0.95
    lab = spark.createDataFrame([(1, 1), (8, 0), (16, 0), (13, 1), (None, 1), (5, None)], "doc_id long, quality int")
    for x in (lab, lab.filter("false"), lab.filter("quality = 1")):
        out = quality(edge, x, F.col("source"), F.col("lang")).collect()
        assert len(out) == len(pairs()) and all(0 <= r["score"] <= 1 for r in out)


def test_quality_shrinks_sparse_sites(spark):
    """A document of a large bad host loses more than one of a small bad host."""
    good = "Some words of a plain sentence go here and there. " * 6
    junk = "### %%% $$$ *** ### " * 30
    rows = [(k, good + str(k), "fine") for k in range(60)] + [(100 + k, junk, "large") for k in range(60)] \
        + [(200, good, "large"), (300, good, "small"), (301, junk, "small")]
    lab = spark.createDataFrame([(k, 1) for k in range(30)] + [(100 + k, 0) for k in range(30)], "doc_id long, quality int")
    out = {r["row"]["doc_id"]: r for r in quality(documents(spark, rows), lab, F.col("source"), F.col("lang")).collect()}
    assert out[1]["p_path"] > out[300]["p_path"] > out[200]["p_path"]


# ---------------------------------------------------------------- all
def test_empty_tables(spark, none):
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    for df in (suffix_dedup(none), recompression_dedup(none), simhash_components(none), decontaminate(none, items),
               shard(none), mixture(none, F.col("source"), words_of("text"), [F.col("doc_id")]), lm_scores(none),
               toxicity(none, lab, F.lit(True)), quality(none, lab, F.col("source"), F.col("lang")),
               top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True))):
        assert df.count() == 0
