"""A data-skipping index for look-ups by any key.

One aggregate over a Parquet table and its ``_metadata.file_path`` writes, for every
file and key column, the smallest and largest value and a Bloom bitmap, cut into parts
of ``PART_BITS`` bits by a hash of the value, so the bitmap grows with the file's rows
while a row of the index keeps its size.  A look-up reads the index rows of its column
and part, then only the files that may hold a value, with the values' filter pushed
down.  Files are never missed: a value sets all its bits in the file that holds it.

Values are compared as strings.  Null values are in no file's bitmap; look-ups of null
find nothing, as an equality does.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

PART_BITS = 4096 * 8
HASHES = 3
BITS_A_ROW = 12


def _part(value: Column, parts: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(-1), value), parts).cast("int")


def _place(value: Column, k: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(k), value), F.lit(PART_BITS)).cast("long")


def build_index(spark: SparkSession, table: str, keys: Sequence[str], index: str) -> None:
    """Write the index of the Parquet ``table`` for the columns ``keys``: rows (column,
    part, parts, file, least, most, bits), partitioned by column."""
    files = materialize(spark.read.parquet(table).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"))
                        .withColumn("_f", F.monotonically_increasing_id()), "index-files")  # a row a file
    most = files.agg(F.max("n")).first()[0]
    parts = max(1, -(-int(most or 0) * BITS_A_ROW // PART_BITS))
    # rows carry short numbers for their file and column, and a value counts once in a file
    named = F.broadcast(files.select(F.col("file").alias("_path"), "_f"))
    pairs = spark.read.parquet(table).select(F.col("_metadata.file_path").alias("_path"), *keys).join(named, "_path") \
        .select("_f", F.posexplode(F.array(*[F.col(k).cast("string") for k in keys])).alias("_k", "value")) \
        .filter("value is not null").distinct()
    v = F.col("value")
    each = pairs.groupBy(_part(v, F.lit(parts)).alias("part"), "_f", "_k").agg(
        F.min("value").alias("least"), F.max("value").alias("most"),
        F.array(*[F.bitmap_construct_agg(_place(v, k)) for k in range(HASHES)]).alias("b"))
    out = each.select("_f", "_k", "part", "least", "most", F.explode("b").alias("b")) \
        .groupBy("_f", "_k", "part").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.bitmap_or_agg("b").alias("bits")) \
        .join(F.broadcast(files.select("_f", "file")), "_f") \
        .select(F.element_at(F.array(*[F.lit(k) for k in keys]), F.col("_k") + 1).alias("column"), "file", "part", "least", "most", "bits")
    out.withColumn("parts", F.lit(parts)).write.mode("overwrite").partitionBy("column").parquet(index)


def _bit(bits: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.pmod(F.floor(byte / F.pow(F.lit(2.0), (place % 8).cast("double"))), F.lit(2)) == 1


def files_for(spark: SparkSession, index: str, column: str, values: Sequence) -> list[str]:
    """The files that may hold one of ``values`` in ``column`` (a literal list)."""
    wanted = spark.createDataFrame([(str(v),) for v in values if v is not None], "value string")
    ix = spark.read.parquet(index).filter(F.col("column") == column)
    v = F.col("value")
    hit = ix.join(F.broadcast(wanted), (F.col("part") == _part(v, F.col("parts"))) & (F.col("least") <= v) & (v <= F.col("most")))
    for k in range(HASHES):
        hit = hit.filter(_bit(F.col("bits"), _place(v, k)))
    return sorted(r[0] for r in hit.select("file").distinct().collect())


def look_up(spark: SparkSession, table: str, index: str, column: str, values: Sequence) -> DataFrame:
    """The rows of ``table`` whose ``column`` is one of ``values``, read from the chosen files only."""
    whole = spark.read.parquet(table)
    files = files_for(spark, index, column, values)
    if not files:
        return whole.limit(0)
    # the partition columns come from the folders below the table
    got = spark.read.schema(whole.schema).option("basePath", table).parquet(*files)
    return got.filter(F.col(column).cast("string").isin([str(v) for v in values if v is not None]))
