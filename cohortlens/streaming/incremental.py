"""Incremental loading and scoring on Structured Streaming.

* T1: each arriving file is loaded once; the file-source log in the checkpoint
  remembers completed files, so a restart resumes and a re-run adds nothing.
* T2: rows are scored only if their key is not in the scored table yet
  (``foreachBatch`` + ``left_anti``), so a replayed batch is a no-op.
* T3: daily activity per author as an event-time window with a watermark;
  append mode emits a day once the watermark has passed its end.

All state lives under a checkpoint folder on the shared filesystem
(``spark.checkpoint.dir``), so a lost executor or driver restarts from it.
"""

from __future__ import annotations

from typing import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DecimalType, IntegralType, StructType

BUCKETS = 1 << 12  # of keyed state, in which done keys stand


def run_available_now(stream: DataFrame, sink_path: str, checkpoint: str, fmt: str = "parquet",
                      mode: str = "append", partition_by: Sequence[str] = ()) -> None:
    """Process everything available now, then stop (a restartable batch)."""
    w = (stream.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True))
    if partition_by:
        w = w.partitionBy(*partition_by)
    q = w.start(sink_path)
    q.awaitTermination()


def load_files_once(spark: SparkSession, source_dir: str, schema: StructType | str, sink_path: str,
                    checkpoint: str, fmt: str = "json", max_files_per_trigger: int | None = None) -> None:
    """Load every file of ``source_dir`` exactly once into ``sink_path``."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    run_available_now(r.load(source_dir), sink_path, checkpoint)


def score_unscored(spark: SparkSession, stream: DataFrame, scored_path: str, key: str,
                   score: Callable[[DataFrame], DataFrame], checkpoint: str) -> None:
    """Append scores for rows whose ``key`` is not yet in ``scored_path``.

    ``score`` maps a batch DataFrame to the rows to append (key + score columns).
    """
    def batch(df: DataFrame, epoch_id: int) -> None:
        done = spark.read.parquet(scored_path).select(key)
        # a key twice in one batch is one row (the smallest), as on a replay
        rest = [c for c in df.columns if c != key]
        if rest:
            df = df.groupBy(key).agg(F.min(F.struct(*rest)).alias("_r")).select(key, "_r.*").select(*df.columns)
        todo = df.join(done, on=key, how="left_anti")
        score(todo).write.mode("append").parquet(scored_path)

    q = (stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def first_seen(stream: DataFrame, seed: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    """The rows of ``stream`` whose ``key`` neither the stream ``seed`` nor an earlier
    row had, as a stream: keyed state holds the keys that are done, so no batch reads
    what was scored before.  A state is a bucket of keys by their hash, not one key: a
    Python call then handles many keys at once.  Of a key's rows in one batch the
    smallest counts.  Rows without a key are one key, in a bucket of their own."""
    from ..session import ship_package
    ship_package(stream.sparkSession)
    rest = [c for c in stream.columns if c != key]
    fields = {f.name: f.dataType for f in stream.schema.fields}
    # whole numbers travel as decimals: pandas makes floats of those that share a column with a null
    kept = {c: DecimalType(20, 0) if isinstance(fields[c], IntegralType) else fields[c] for c in rest}
    known = seed.select(F.col(key).cast(fields[key]), *[F.lit(None).cast(kept[c]).alias(c) for c in rest], F.lit(True).alias("_done"))
    named = F.hex(key) if isinstance(fields[key], BinaryType) else F.col(key).cast("string")
    both = stream.select(key, *[F.col(c).cast(kept[c]).alias(c) for c in rest], F.lit(False).alias("_done")).unionByName(known) \
        .withColumn("_id", F.coalesce(named, F.lit(""))) \
        .withColumn("_bucket", F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets))).cast("int"))

    def step(k, frames, state):
        old = set(state.get[0]) if state.exists else set()
        done, best = set(old), None
        for f in frames:
            done.update(f.loc[f["_done"], "_id"])
            new = f[~f["_done"] & ~f["_id"].isin(done)]
            if len(new):
                best = new if best is None else pd.concat([best, new])
                if best["_id"].duplicated().any():
                    best = (best.sort_values(rest, kind="stable") if rest else best).drop_duplicates("_id")
        if best is not None:
            best = best[~best["_id"].isin(done)]
            done.update(best["_id"])
        if len(done) > len(old):
            state.update((sorted(done),))
        if best is not None and len(best):
            yield best[[key, *rest]]
    shape = ", ".join(f"`{c}` {t.simpleString()}" for c, t in [(key, fields[key]), *kept.items()])
    out = both.groupBy("_bucket").applyInPandasWithState(step, shape, "done array<string>", "append", "NoTimeout")
    # a filter that holds always: it puts the rows into the form that a pandas UDF behind it needs
    return out.filter(F.spark_partition_id() >= 0).select(key, *[F.col(c).cast(fields[c]).alias(c) for c in rest])


def score_first_seen(stream: DataFrame, seed: DataFrame, key: str, score: Callable[[DataFrame], DataFrame],
                     sink_path: str, checkpoint: str) -> None:
    """Score every key once, with keyed state instead of a look at all scores.
    ``seed`` streams the keys scored beforehand; the scores are appended to ``sink_path``."""
    run_available_now(score(first_seen(stream, seed, key)), sink_path, checkpoint)


def daily_activity(stream: DataFrame, ts: str = "event_time", key: str = "author", delay: str = "1 hour") -> DataFrame:
    """Per (author, UTC day) counts; a day is final once the watermark
    (latest event time minus ``delay``) passes its end."""
    t = stream.withColumn(ts, F.col(ts).cast("timestamp"))   # TIMESTAMP_NTZ inputs become TIMESTAMP
    g = (t.withWatermark(ts, delay).groupBy(F.window(ts, "1 day").alias("w"), key)
         .agg(F.count(F.lit(1)).alias("n")))
    return g.select(key, F.date_format(F.col("w.start"), "yyyy-MM-dd").alias("day"), "n")
