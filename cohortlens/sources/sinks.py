"""Sinks and write-backs.

Self-overwrite (replace a table with a query over itself) is done as
"write a new version, then point readers at it": results go to a fresh path
under the target and a small ``_CURRENT`` marker names the live version, so a
reader never sees a half-written table and the job never overwrites its own
input.  Upserts and field updates are joins with ``coalesce``.
"""

from __future__ import annotations

import uuid
from typing import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv_quoted(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with header, every field quoted, quotes escaped by doubling.
    Embedded newlines survive a ``multiLine`` read; null is written as ``\\N``
    so that it stays distinct from an empty string."""
    (df.write.mode(mode).option("header", True).option("quoteAll", True).option("escape", '"')
     .option("nullValue", NULL_MARK).csv(path))


NULL_MARK = "\\N"


def write_rolling(df: DataFrame, path: str, max_records: int, fmt: str = "csv", mode: str = "overwrite") -> None:
    """Parts of at most ``max_records`` rows each."""
    w = df.write.mode(mode).option("maxRecordsPerFile", max_records)
    if fmt == "csv":
        w = w.option("header", True).option("quoteAll", True).option("escape", '"')
    w.format(fmt).save(path)


def write_rolling_bytes(df: DataFrame, path: str, max_bytes: int, mode: str = "overwrite") -> None:
    """Quoted CSV parts of at most ``max_bytes`` bytes, header included, or of one
    row more.  Within each task the encoded sizes are summed up and the rows cut at
    every multiple of the bound; the parts are folders ``roll=task-number``.  A row
    is never cut and no row is shuffled."""
    from ..session import ship_package
    ship_package(df.sparkSession)
    header = len(",".join(f'"{c}"' for c in df.columns).encode()) + 1
    room = max(1, max_bytes - header)
    how = {"quoteAll": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    line = F.to_csv(F.struct(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns]), how)
    sized = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("r"),
                      (F.octet_length(line) + 1).cast("long").alias("b"))

    def cut(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        task, before = TaskContext.get().partitionId(), 0
        for b in batches:
            ends = before + np.cumsum(b.column("b").to_numpy())
            starts = ends - b.column("b").to_numpy()
            before = int(ends[-1]) if len(ends) else before
            yield pa.RecordBatch.from_arrays([b.column("r"), pa.array([f"{task}-{k}" for k in (starts // room).tolist()])], ["r", "roll"])
    rows = sized.mapInArrow(cut, f"r {sized.schema['r'].dataType.simpleString()}, roll string")
    rows.select("r.*", "roll").write.mode(mode).option("header", True).options(**how).partitionBy("roll").csv(path)


def append_partitioned(df: DataFrame, path: str, partition_by: Sequence[str] = ("month",)) -> None:
    """Append to a table partitioned by month; rows are rebalanced on the
    partition columns first (a hot month is split), so files = months, not
    tasks times months."""
    df.hint("rebalance", *partition_by).write.mode("append").partitionBy(*partition_by).parquet(path)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def current_version(spark: SparkSession, table: str) -> str | None:
    fs, p = _fs(spark, f"{table}/_CURRENT")
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        reader = spark.sparkContext._jvm.java.io.BufferedReader(
            spark.sparkContext._jvm.java.io.InputStreamReader(stream))
        return reader.readLine().strip()
    finally:
        stream.close()


def read_versioned(spark: SparkSession, table: str) -> DataFrame:
    v = current_version(spark, table)
    if v is None:
        raise FileNotFoundError(f"no version of {table}")
    return spark.read.parquet(f"{table}/{v}")


def replace_versioned(df: DataFrame, table: str) -> str:
    """Write ``df`` as a new version of ``table`` and make it current
    (the marker is replaced by one overwriting rename after the data is
    complete, so there is a live version at any time)."""
    spark = df.sparkSession
    v = f"v-{uuid.uuid4().hex[:12]}"
    df.write.mode("errorifexists").parquet(f"{table}/{v}")
    fs, p = _fs(spark, f"{table}/_CURRENT")
    tmp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{table}/_CURRENT.{v}")
    out = fs.create(tmp, True)
    out.write(bytearray(v.encode()))
    out.close()
    jvm = spark.sparkContext._jvm
    option = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
    how = jvm.java.lang.reflect.Array.newInstance(option, 1)
    how[0] = jvm.java.lang.Enum.valueOf(option, "OVERWRITE")
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark.sparkContext._jsc.hadoopConfiguration()) \
        .rename(tmp, p, how)
    return v


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """One row per key: the greatest by ``order`` (by default by all other
    columns), a partial aggregate."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    pos = F.struct(*[F.col(c) for c in (order or rest)], *[F.col(c) for c in rest])
    row = F.struct(*[F.col(c) for c in rest])
    return df.groupBy(*keys).agg(F.max_by(row, pos).alias("_row")).select(*keys, "_row.*")


def upsert(old: DataFrame, new: DataFrame, key: str | Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """Merge-matched / insert-unmatched: new values win per column where
    present (``coalesce(new, old)``), columns only in ``new`` are added; of rows
    of ``new`` with one key the greatest by ``order`` counts."""
    keys = [key] if isinstance(key, str) else list(key)
    new = last_per_key(new, keys, order)
    cols = [c for c in old.columns if c not in keys]
    more = [c for c in new.columns if c not in keys and c not in cols]
    n = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in cols if c in new.columns], *more)
    j = old.join(n, on=keys, how="full_outer")
    return j.select(*keys, *[(F.coalesce(F.col(f"_new_{c}"), F.col(c)) if c in new.columns else F.col(c)).alias(c)
                             for c in cols], *more)


def set_fields(target: DataFrame, values: DataFrame, key: str | Sequence[str], fields: Sequence[str],
               overwrite: bool = True, order: Sequence[str] | None = None) -> DataFrame:
    """Set ``fields`` on every target row matching the key; with
    ``overwrite=False`` an existing (non-null) value is kept.  Of value rows
    with one key the greatest by ``order`` counts, so target rows never multiply."""
    keys = [key] if isinstance(key, str) else list(key)
    v = last_per_key(values, keys, order).select(*keys, *[F.col(f).alias(f"_v_{f}") for f in fields])
    j = target.join(v, on=keys, how="left")
    for f in fields:
        if f in target.columns:
            e = F.coalesce(F.col(f"_v_{f}"), F.col(f)) if overwrite else F.coalesce(F.col(f), F.col(f"_v_{f}"))
        else:
            e = F.col(f"_v_{f}")
        j = j.withColumn(f, e)
    return j.drop(*[f"_v_{f}" for f in fields])


def _partition_values(df: DataFrame, partition_by: str) -> list:
    """The distinct values of a partition column, as text (at most one a partition)."""
    return [r[0] for r in df.select(F.col(partition_by).cast("string")).distinct().collect()]


def _in_partitions(partition_by: str, values: list):
    c = F.col(partition_by).cast("string")
    some = c.isin([v for v in values if v is not None])
    return some | c.isNull() if None in values else some


def _read_partitioned(spark: SparkSession, table: str, partition_by: str) -> DataFrame:
    """The rows of ``table``; the partition column is text, as in the folder names."""
    fields = spark.read.parquet(table).schema.fields
    schema = ", ".join(f"`{f.name}` {'string' if f.name == partition_by else f.dataType.simpleString()}" for f in fields)
    return spark.read.schema(schema).parquet(table)


def stage_partitions(rows: DataFrame, table: str, partition_by: str) -> str:
    """Write the new rows of the touched partitions beside the live ones, in a folder
    that readers of ``table`` pass over; the live rows stay as they are.  Rows are
    rebalanced on the partition first, so files = partitions, not tasks times these."""
    path = f"{table}/_staged-{uuid.uuid4().hex[:12]}"
    rows.hint("rebalance", partition_by).write.mode("errorifexists").partitionBy(partition_by).parquet(path)
    return path


def swap_partitions(spark: SparkSession, table: str, staged: str, partition_by: str, touched: list) -> None:
    """Put the staged rows in place of the ``touched`` partitions (dynamic partition
    overwrite); a touched partition without rows goes.  No other partition's file
    changes.  Running it again after a loss gives the same table."""
    new = _read_partitioned(spark, staged, partition_by)
    gone = sorted(set(touched) - set(_partition_values(new, partition_by)), key=str)
    emptied = _read_partitioned(spark, table, partition_by).filter(_in_partitions(partition_by, gone)) \
        .select(F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("d")).distinct() if gone else None
    folders = [r["d"] for r in emptied.collect()] if gone else []
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition_by).parquet(table)
    jvm = spark.sparkContext._jvm
    for d in folders:  # at most one a touched partition; file paths come percent-encoded
        fs, _ = _fs(spark, table)
        fs.delete(jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(d)), True)
    fs, p = _fs(spark, staged)
    fs.delete(p, True)


def _rewrite(table: str, rows: DataFrame, columns: Sequence[str], partition_by: str, touched: list) -> None:
    spark = rows.sparkSession
    if touched:
        staged = stage_partitions(rows.select(*columns), table, partition_by)
        swap_partitions(spark, table, staged, partition_by, touched)


def upsert_partitions(spark: SparkSession, table: str, new: DataFrame, key: str | Sequence[str],
                      partition_by: str = "month", order: Sequence[str] | None = None) -> list:
    """S13 on a stored table: as ``upsert``, but only the partitions that hold a
    matched key or get a row are read whole and written; returns their values.

    The keys of ``new`` are looked up with a scan of the key columns alone.  A matched
    row moves if ``new`` names another partition; an unmatched one goes where ``new``
    says (the null partition if it does not).  ``new`` is stored first, so it may be a
    query over ``table`` itself; its columns must be columns of ``table``.  Rows are
    written to a staging folder before any live file changes."""
    from ..session import materialize
    keys = [key] if isinstance(key, str) else list(key)
    old = _read_partitioned(spark, table, partition_by)
    more = [c for c in new.columns if c not in old.columns]
    if more:
        raise ValueError(f"columns that {table} does not have: {more}")
    new = new.withColumn(partition_by, F.col(partition_by).cast("string")) if partition_by in new.columns \
        else new.withColumn(partition_by, F.lit(None).cast("string"))
    new = materialize(last_per_key(new, keys, order), "upsert-new")
    found = old.select(*keys, partition_by).join(new.select(*keys), on=keys, how="left_semi")
    held = _partition_values(found, partition_by)
    fresh = new.join(old.select(*keys), on=keys, how="left_anti").select(partition_by) \
        .unionByName(new.filter(F.col(partition_by).isNotNull()).select(partition_by))
    touched = sorted({*held, *_partition_values(fresh, partition_by)}, key=str)
    rows = upsert(old.filter(_in_partitions(partition_by, touched)), new, keys)
    _rewrite(table, rows, old.columns, partition_by, touched)
    return touched


def set_fields_partitions(spark: SparkSession, table: str, values: DataFrame, key: str | Sequence[str],
                          fields: Sequence[str], partition_by: str = "month", overwrite: bool = True,
                          order: Sequence[str] | None = None) -> list:
    """S14 on a stored table: as ``set_fields``, but only the partitions that hold a
    matched key are written; returns their values."""
    from ..session import materialize
    keys = [key] if isinstance(key, str) else list(key)
    old = _read_partitioned(spark, table, partition_by)
    missing = [f for f in [*fields, *keys] if f not in old.columns or f == partition_by]
    if missing:
        raise ValueError(f"not settable columns of {table}: {missing}")
    values = materialize(last_per_key(values, keys, order).select(*keys, *fields), "set-values")
    touched = sorted(_partition_values(
        old.select(*keys, partition_by).join(values.select(*keys), on=keys, how="left_semi"), partition_by), key=str)
    rows = set_fields(old.filter(_in_partitions(partition_by, touched)), values, keys, fields, overwrite)
    _rewrite(table, rows, old.columns, partition_by, touched)
    return touched


def write_layout(df: DataFrame, path: str, partition_by: str = "month", sort_by: Sequence[str] = ("author",),
                 tiebreak: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Layout for look-ups: partitioned by month (pruning), sorted by author
    inside each file (Parquet min/max statistics make author filters skip).

    Range partitioning on (month, author, tiebreak...) balances tasks by
    sampling: a month holding a third of the data is cut into many ranges, and
    the tie-break columns let even one hot author span several tasks; each
    file covers a narrow author range."""
    keys = [partition_by, *sort_by, *[c for c in tiebreak if c in df.columns]]
    (df.repartitionByRange(*keys).sortWithinPartitions(*keys)
     .write.mode(mode).partitionBy(partition_by).parquet(path))


def write_zstd_ndjson(df: DataFrame, directory: str, window_log: int = 31, level: int = 3,
                      prefix: str = "part", frame_bytes: int | None = None) -> None:
    """Archive writer: each task streams its rows as JSON lines into one .zst
    file with a ``window_log`` window (frame without content size, so readers
    need the long window).  With ``frame_bytes`` a frame ends after that many
    bytes, in mid-line too.  Used to produce test archives."""
    write_zstd_lines(df.select(F.to_json(F.struct(*df.columns)).cast("binary").alias("value")), directory,
                     window_log, level, prefix, frame_bytes)


def write_zstd_lines(lines: DataFrame, directory: str, window_log: int = 31, level: int = 3,
                     prefix: str = "part", frame_bytes: int | None = None) -> None:
    """As ``write_zstd_ndjson`` for a column ``value`` of ready lines (binary)."""
    target = directory.rstrip("/")

    def write(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid as _u
        import pyarrow.fs as pafs
        import zstandard as zstd
        from pyspark import TaskContext
        pid = TaskContext.get().partitionId() if TaskContext.get() else 0
        params = zstd.ZstdCompressionParameters.from_level(level, window_log=window_log)
        cctx = zstd.ZstdCompressor(compression_params=params)   # streamed: no content size in the frame
        uri = target if "://" in target else "file://" + (target[5:] if target.startswith("file:") else target)
        fs, base = pafs.FileSystem.from_uri(uri)
        fs.create_dir(base, recursive=True)
        # one file per partition id: a re-run attempt replaces it with identical content
        name = f"{prefix}-{pid:05d}.json.zst"
        tmp = f"{base}/_tmp-{_u.uuid4().hex[:8]}-{name}"   # hidden from readers until complete
        n, room = 0, frame_bytes
        with fs.open_output_stream(tmp, compression=None) as fh:   # bytes as written (no extension codec)
            with cctx.stream_writer(fh, closefd=False) as w:
                for pdf in it:
                    for v in pdf["value"]:
                        line = bytes(v) + b"\n"
                        while room is not None and len(line) >= room:
                            w.write(line[:room])
                            w.flush(zstd.FLUSH_FRAME)
                            line, room = line[room:], frame_bytes
                        w.write(line)
                        room = room and room - len(line)
                        n += 1
        fs.move(tmp, f"{base}/{name}")
        yield pd.DataFrame({"file": [name], "rows": [n]})

    from ..session import ship_package
    ship_package(lines.sparkSession)
    lines.mapInPandas(write, "file string, rows long").count()
