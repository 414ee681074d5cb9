"""The corpus pipeline: quality classifier, SimHash near-dedup, benchmark
decontamination, mixing sources to target weights, sharding.

Each stage takes ``(spark, docs, sf_dir)`` and returns what it keeps of ``docs``
(all but the last: the same columns); its result is written as Parquet and read
as the next stage's ``docs``.  The stages call the operators of ``cohortlens.llm``.

SQL cannot express the stages (fitted classifier, XXH64 fingerprints, seeded
orders), so ``ORACLE_SQL`` is None; ``tests/llm/test_pipeline.py`` holds the stages
against plain Python and the run against its stages.

Columns of documents beside the five are carried through, whatever their names.  A
null text is an empty one, a null id or source a value like any other; rows that
repeat are one SimHash group; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import common as C
from cohortlens.llm.decontaminate import decontaminate
from cohortlens.llm.mixing import mixture, words_of
from cohortlens.llm.quality import quality
from cohortlens.llm.sharding import shard
from cohortlens.llm.simhash import simhash_representatives

ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier calls good."""
    out = quality(docs, C.table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))
    return out.filter("good").select("row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the one of the smallest id.  A row
    without an id is kept only if its whole component has none; of rows that share
    the smallest id, the one of the smallest text and row hashes stays."""
    t, h = C.fresh(docs, "text_hash"), C.fresh(docs, "row_hash")
    own = [F.col(f"`{c}`") for c in docs.columns]
    # xxhash64 passes over nulls, so the row hash is told where they are
    hashed = docs.withColumn(t, F.xxhash64("text")).withColumn(h, F.xxhash64(*own, *(c.isNull() for c in own)))
    best = simhash_representatives(hashed, (t, h))
    best = best.toDF(*(C.fresh(hashed, f"best_{k}") for k in ("id", "text", "row")))
    d, bt, bh = (F.col(c) for c in best.columns)
    one = hashed.join(best, F.col("doc_id").eqNullSafe(d) & (F.col(t) == bt) & (F.col(h) == bh), "left_semi")
    return one.dropDuplicates(["doc_id", t, h]).select(*own)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no benchmark window."""
    d, t = C.fresh(docs, "hit_id"), C.fresh(docs, "hit_text")
    hit = decontaminate(docs, C.table(spark, sf_dir, "benchmark")).filter("n_hit > 0") \
        .select(F.col("doc_id").alias(d), F.col("th").alias(t)).distinct()
    return docs.join(hit, F.col("doc_id").eqNullSafe(F.col(d)) & (F.xxhash64("text") == F.col(t)), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    out = mixture(docs, F.col("source"), words_of("text"), [F.col("doc_id"), F.xxhash64("text")])
    return out.filter("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("nth")) \
        .select("row.*")


def into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with ``shard`` and ``slot`` (columns of documents first); a column
    of documents that has such a name keeps it, and the new one gets another."""
    return shard(docs).select("row.*", F.col("shard").alias(C.fresh(docs, "shard")), F.col("slot").alias(C.fresh(docs, "slot")))


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", one_of_each_group),
    ("decontamination", without_benchmark),
    ("mixing", mix_sources),
    ("sharding", into_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = C.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = C.store(docs, f"pipeline-{name}")
    return docs
