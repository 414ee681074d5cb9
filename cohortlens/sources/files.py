"""File sources.

Everything is a distributed read: the driver lists nothing and reads nothing
but schemas.  The long-window zstd reader (S3) turns a DataFrame of file paths
into groups of zstd frames and these into rows with ``mapInArrow``: each task
streams its frames through a ``zstandard`` decompressor (bounded memory) and
yields fixed-size batches.
"""

from __future__ import annotations

from typing import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# ------------------------------------------------------------------ fixed record shapes
COMMENT_SCHEMA = ("link_id string, parent_id string, created_utc bigint, subreddit string, author string, "
                  "body string, score bigint, is_submitter boolean")
SUBMISSION_SCHEMA = ("id string, created_utc bigint, subreddit string, author string, title string, "
                     "selftext string, score bigint, num_comments bigint")


def read_ndjson(spark: SparkSession, paths: str | Sequence[str], schema: StructType | str) -> DataFrame:
    """NDJSON (optionally .zst/.gz) with a declared schema: missing keys are
    null, keys not in the schema are dropped, nothing is inferred."""
    return spark.read.schema(schema).json(paths)


def read_ndjson_discovered(spark: SparkSession, paths: str | Sequence[str], sampling_ratio: float = 1.0) -> DataFrame:
    """NDJSON with the schema discovered as the union of all keys;
    unparsable lines dropped."""
    return (spark.read.option("mode", "DROPMALFORMED").option("samplingRatio", sampling_ratio)
            .json(paths))


GROUP_BYTES = 64 << 20  # compressed bytes that one task decodes
FRAMES_SCHEMA = "path string, start long, stop long"


def _local(path: str) -> str:
    return path[len("file:"):] if path.startswith("file:") and not path.startswith("file://") else path


def zstd_frames(fh, size: int) -> Iterator[tuple[int, int]]:
    """(first byte, byte after the last) of every zstd frame of an open file, from its
    frame and block headers alone; skippable frames are passed over."""
    import zstandard as zstd
    at = 0
    while at < size:
        fh.seek(at)
        head = fh.read(18)
        if len(head) >= 8 and head[1:4] == b"\x2a\x4d\x18" and head[0] >> 4 == 5:
            at += 8 + int.from_bytes(head[4:8], "little")
            continue
        start, at = at, at + zstd.frame_header_size(head)
        checksum = zstd.get_frame_parameters(head).has_checksum
        last = False
        while not last:
            fh.seek(at)
            block = fh.read(3)
            if len(block) < 3:
                raise ValueError(f"zstd frame at byte {start} is cut off")
            word = int.from_bytes(block, "little")
            last = bool(word & 1)
            at += 3 + (1 if word >> 1 & 3 == 1 else word >> 3)  # a run block holds one byte
        at += 4 * checksum
        if at > size:
            raise ValueError(f"zstd frame at byte {start} is cut off")
        yield start, at


def read_zstd_lines(spark: SparkSession, directory: str, glob: str = "*.zst", batch_lines: int = 10_000,
                    max_window_log: int = 31, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Lines of zstd files as (file, value binary), frames read side by side.

    One task per file finds the frames by their headers; consecutive frames of
    together at least ``group_bytes`` compressed bytes become one group; the groups
    are stored and spread over as many tasks as their bytes ask for.  A line may run over frames and groups: a group
    but the first starts after its first line break and ends with the line that
    begins at or before its end, which is read from the frames that follow.  A frame
    cannot be cut, so a file of one frame is one task's work, in bounded memory.
    Blank lines are passed over; no byte is changed."""
    paths = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(directory).select("path")

    def find(batches):
        import pyarrow as pa
        import pyarrow.fs as pafs
        for b in batches:
            for path in b.column(0).to_pylist():
                p = _local(path)
                fs, name = pafs.FileSystem.from_uri(p if "://" in p else "file://" + p)
                with fs.open_input_file(name) as fh:
                    starts, begin, stop = [], None, 0
                    for a, stop in zstd_frames(fh, fh.size()):
                        if begin is None or a - begin >= group_bytes:
                            starts.append(a)
                            begin = a
                stops = starts[1:] + [stop]
                if starts:
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(starts)), pa.array(starts, pa.int64()),
                                                      pa.array(stops[:len(starts)], pa.int64())], ["path", "start", "stop"])

    def decode(batches):
        import pyarrow as pa
        import pyarrow.fs as pafs
        for b in batches:
            for path, start, stop in zip(*(c.to_pylist() for c in b.columns)):
                p = _local(path)
                fs, name = pafs.FileSystem.from_uri(p if "://" in p else "file://" + p)
                with fs.open_input_file(name) as fh:
                    for lines in _batched(_group_lines(fh, start, stop, max_window_log), batch_lines):
                        yield pa.RecordBatch.from_arrays([pa.array([path] * len(lines)), pa.array(lines, pa.binary())],
                                                         ["file", "value"])

    from ..session import materialize, ship_package
    ship_package(spark)
    groups = materialize(paths.mapInArrow(find, FRAMES_SCHEMA), "zstd-groups")
    # rows of a few bytes stand for much work: the count of tasks is told by the frames' bytes
    n = groups.agg(F.count("*").alias("groups"), F.sum(F.col("stop") - F.col("start")).alias("bytes")).first()
    tasks = max(1, min(n["groups"], -(-(n["bytes"] or 0) // group_bytes)))
    return groups.repartition(tasks).mapInArrow(decode, "file string, value binary")


def _batched(lines, n: int):
    buf = []
    for line in lines:
        if line:
            buf.append(line)
        if len(buf) >= n:
            yield buf
            buf = []
    if buf:
        yield buf


def _pieces(fh, start: int, stop: int, max_window_log: int) -> Iterator[bytes]:
    """Decoded bytes of the frames from ``start`` up to ``stop``."""
    import zstandard as zstd
    at = start
    dctx = zstd.ZstdDecompressor(max_window_size=2 ** max_window_log)

    class Part:
        def read(self, n=-1):
            nonlocal at
            fh.seek(at)
            out = fh.read(min(n if n >= 0 else stop - at, stop - at))
            at += len(out)
            return out
    with dctx.stream_reader(Part(), read_across_frames=True, closefd=False) as r:
        while piece := r.read(1 << 20):
            yield piece


def _group_lines(fh, start: int, stop: int, max_window_log: int) -> Iterator[bytes]:
    """Lines that begin in the decoded bytes of [start, stop): the first group's from
    its first byte, others' from after their first line break, and the line that
    begins right at the end."""
    rest, inside = [], start == 0
    for piece in _pieces(fh, start, stop, max_window_log):
        if not inside:
            cut = piece.find(b"\n")
            if cut < 0:
                continue
            inside, piece = True, piece[cut + 1:]
        parts = piece.split(b"\n")
        if len(parts) > 1:
            yield b"".join((*rest, parts[0]))
            yield from parts[1:-1]
            rest = []
        rest.append(parts[-1])
    if not inside:
        return  # all of it belongs to a line of an earlier group
    for piece in _pieces(fh, stop, fh.size(), max_window_log) if stop < fh.size() else ():
        cut = piece.find(b"\n")
        rest.append(piece if cut < 0 else piece[:cut])
        if cut >= 0:
            break
    yield b"".join(rest)


def _checked(lines: DataFrame, schema: StructType | str) -> DataFrame:
    """(file, value, r: the record, reason: null for a good line)."""
    sch = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    bad = "_bad_line"
    parsed = F.from_json("text", StructType(sch.fields + [StructType.fromDDL(f"{bad} string").fields[0]]),
                         {"columnNameOfCorruptRecord": bad})
    reason = F.when(~F.is_valid_utf8("text"), "bytes").when(F.col(f"r.{bad}").isNotNull(), "json")
    return lines.withColumn("text", F.col("value").cast("string")).withColumn("r", parsed) \
        .select("file", "value", F.struct(*[F.col(f"r.`{f.name}`") for f in sch.fields]).alias("r"), reason.alias("reason"))


def read_zstd_long_window(spark: SparkSession, directory: str, schema: StructType | str, glob: str = "*.zst",
                          batch_lines: int = 10_000, max_window_log: int = 31,
                          group_bytes: int = GROUP_BYTES) -> DataFrame:
    """S3: NDJSON compressed with a long zstd window (``--long=31``), which the
    JVM codec rejects: the good rows of ``read_zstd_checked``."""
    lines = read_zstd_lines(spark, directory, glob, batch_lines, max_window_log, group_bytes)
    return _checked(lines, schema).filter("reason is null").select("r.*")


def read_zstd_checked(spark: SparkSession, directory: str, schema: StructType | str, glob: str = "*.zst",
                      batch_lines: int = 10_000, max_window_log: int = 31,
                      group_bytes: int = GROUP_BYTES) -> tuple[DataFrame, DataFrame]:
    """S3: (rows, bad lines) of zstd NDJSON files; bad lines are (file, value binary,
    reason): 'bytes' if the line is not UTF-8, 'json' if it does not parse as
    ``schema``.  Their bytes are kept as they stand in the file.  The files are
    decoded once: both outputs read the stored lines."""
    from ..session import materialize
    lines = read_zstd_lines(spark, directory, glob, batch_lines, max_window_log, group_bytes)
    # of a good line the record is stored, of a bad one the bytes
    lines = _checked(lines, schema).withColumn("value", F.expr("if(reason is null, null, value)"))
    lines = materialize(lines, "zstd-lines")
    return lines.filter("reason is null").select("r.*"), \
        lines.filter("reason is not null").select("file", "value", "reason")


def read_csv(spark: SparkSession, paths: str | Sequence[str], schema: StructType | str,
             header: bool = True, multiline: bool = False, null_value: str | None = None) -> DataFrame:
    """CSV with header and a declared schema."""
    r = (spark.read.schema(schema).option("header", header).option("multiLine", multiline)
         .option("escape", '"'))
    if null_value is not None:
        r = r.option("nullValue", null_value).option("emptyValue", "")
    return r.csv(paths)


def read_csv_quarantine(spark: SparkSession, paths: str | Sequence[str], schema: StructType | str,
                        header: bool = False, corrupt: str = "_corrupt") -> tuple[DataFrame, DataFrame]:
    """PERMISSIVE CSV read; rows with a wrong field count (short or long)
    land in the corrupt-record column.  Returns (good rows, bad raw lines)."""
    # A pruned parse never compares a row's field count with the schema, so this
    # one read parses whole rows (the session's setting is left alone).
    sch = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    sch = StructType(sch.fields + [StructType.fromDDL(f"{corrupt} string").fields[0]])
    df = (spark.read.schema(sch).option("header", header).option("mode", "PERMISSIVE")
          .option("columnPruning", False).option("columnNameOfCorruptRecord", corrupt).csv(paths))
    # the corrupt column must be materialised before filtering on it (Spark rule)
    df = df.withColumn("_bad", F.col(corrupt).isNotNull())
    good = df.filter(~F.col("_bad")).drop(corrupt, "_bad")
    bad = df.filter(F.col("_bad")).select(F.col(corrupt).alias("raw"), *[f.name for f in sch.fields[:-1]])
    return good, bad


def read_csv_without_nul(spark: SparkSession, paths: str | Sequence[str], schema: StructType | str,
                         sep: str = ",", header: bool = True, multiline: bool = False,
                         null_value: str = "") -> tuple[DataFrame, DataFrame]:
    """CSV records without those that hold a NUL byte in any field, and a report
    per file: (file_name, skipped, loaded).  Files whose records are lines are split
    over tasks; ``multiline`` (needed for quoted line breaks) reads a file in one task."""
    sch = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    raw = StructType.fromDDL(", ".join(f"`{f.name}` string" for f in sch.fields))
    rows = (spark.read.schema(raw).option("header", header).option("multiLine", multiline).option("sep", sep)
            .option("escape", '"').option("columnPruning", False).option("nullValue", null_value)
            .option("emptyValue", "").csv(paths).select("*", F.col("_metadata.file_name").alias("file_name")))
    has_nul = F.lit(False)
    for f in sch.fields:
        has_nul = has_nul | F.coalesce(F.col(f.name).contains("\x00"), F.lit(False))
    good = rows.filter(~has_nul).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in sch.fields])
    report = rows.groupBy("file_name").agg(F.count_if(has_nul).alias("skipped"), F.count_if(~has_nul).alias("loaded"))
    return good, report


def read_routed(spark: SparkSession, directory: str, routes: dict[str, tuple[str, StructType | str]],
                fmt: str = "csv", header: bool = True) -> DataFrame:
    """Many files in one tree, routed by a file-name pattern to a row kind.

    ``routes``: kind -> (glob on the file name, schema).  Each kind is one scan
    with ``pathGlobFilter``; the union carries ``kind``.  A kind with no files
    yields an empty DataFrame with its schema."""
    out = None
    for kind, (glob, schema) in routes.items():
        sch = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        try:
            df = (spark.read.schema(sch).option("header", header).option("pathGlobFilter", glob)
                  .option("recursiveFileLookup", True).format(fmt).load(directory))
        except Exception as e:  # no matching files
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
                raise
            df = spark.createDataFrame([], sch)
        df = df.withColumn("kind", F.lit(kind))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out
