"""Operator 3: sharding by a two-pass external shuffle, in DataFrame functions only.

Pass 1 scatters the rows uniformly into memory-sized buckets by a seeded hash of
the id and the text; the bucket count follows the table's bytes, so a bucket fits
a task at any size.  Pass 2 puts each bucket into one fixed order and shuffles it
(Spark's seeded ``shuffle`` is a Fisher-Yates shuffle of an array).  The buckets
one after another are the permutation of the whole table; row k of it goes to
shard k mod ``shards`` at slot k div ``shards``.

Law: ``rows``.  Shard counts are at most one apart, and slots have no gaps.  Equal
texts with different ids are scattered like any other rows, so a group of copies
spreads over all buckets and shards.

Edge cases: null texts count as empty but hash apart; a null id is a value like
any other; rows that are equal in id and text fall into one bucket in any order
(their results are interchangeable); extra columns travel with their row, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C
from .registry import query

BUCKET_BYTES = 8 << 20
BUCKET_ROWS = 1 << 14


def external_shuffle(docs: DataFrame, key: list[Column], size: Column, seed: int,
                     bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(row struct of all columns, position long): a seeded random permutation of
    ``docs``; ``key`` identifies a row, ``size`` is its bytes in a task."""
    total = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()
    n = max(1, -(-int(total["b"]) // bucket_bytes), -(-int(total["n"]) // bucket_rows))
    place = F.xxhash64(F.lit(seed), *key)
    # pass 1: scatter
    scattered = docs.select(F.pmod(place, F.lit(n)).cast("long").alias("bucket"),
                            F.struct(F.xxhash64(F.lit(seed + 1), *key).alias("tie"),
                                     F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).alias("r"))
    # pass 2: one fixed order, then Fisher-Yates with a seed of the operator's
    mixed = scattered.groupBy("bucket").agg(F.collect_list("r").alias("rows")) \
        .select("bucket", F.shuffle(F.array_sort("rows"), F.lit(seed)).alias("rows"))
    counts = docs.groupBy(F.pmod(place, F.lit(n)).cast("long").alias("bucket")).agg(F.count("*").alias("n"))
    before = counts.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("before"))
    return mixed.join(before, "bucket").select("before", F.posexplode("rows").alias("k", "r")) \
        .select(F.col("r.row").alias("row"), (F.col("before") + F.col("k")).alias("position"))


def shard(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = 8, seed: int = 42) -> DataFrame:
    """(row struct, shard int, slot long) for every input row.  See the module head."""
    key = [F.col(f"`{doc_id}`"), F.col(f"`{text}`")]
    size = F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)) + F.lit(64)
    out = external_shuffle(docs, key, size.cast("long"), seed)
    return out.select("row", F.pmod("position", F.lit(shards)).cast("int").alias("shard"),
                      F.floor(F.col("position") / shards).alias("slot"))


def write_shards(docs: DataFrame, path: str, **how) -> None:
    """Write the shards as folders ``shard=k``, each ordered by slot and cut by
    slot ranges, so that one shard never goes through one task."""
    out = shard(docs, **how)
    out.select("row.*", "shard", "slot").repartitionByRange("shard", "slot") \
        .sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


@query("op3_sharding")
def op3(spark, sf_dir):
    docs = C.table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    # the digests travel instead of the texts; the shuffle itself hashes id and digest
    slim = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"))
    out = external_shuffle(slim, [F.col("doc_id"), F.col("text_crc32")], F.col("size"), 42)
    return out.select("row.doc_id", "row.size", "row.text_crc32", F.lit("rows").alias("law"),
                      F.pmod("position", F.lit(8)).cast("int").alias("shard"),
                      F.floor(F.col("position") / 8).cast("long").alias("slot"),
                      F.lit(None).cast("int").alias("grown_shard"))
