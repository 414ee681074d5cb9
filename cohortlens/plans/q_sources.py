"""Queries: sources and sinks.

Each query first writes its input files (derived from the test tables) under
the session's shared ``spark.checkpoint.dir`` and then reads them back with the
operator under test, so the oracle is the source view itself.  Where a query
needs bad input (malformed JSON, short/long CSV rows, NUL bytes), a fixed rule
on the row id decides which lines are damaged; every row of the table is still
written, read and compared.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..session import scratch_dir
from ..sources import files as FS
from ..sources import sinks as SK
from ..sources import skipping as SX
from . import views as V
from .catalog import query

EV_DECLARED = "id string, author string, created_utc bigint, community string, score bigint, parent_id string"


def _ev(spark, sf):
    return V.ev(spark, sf).select("id", "author", "created_utc", "community", "score", "parent_id")


@query("scan_ndjson_declared", "S1", """
select id, author, created_utc, community, score, parent_id, null::varchar title from ev""")
def scan_ndjson_declared(spark, sf):
    d = scratch_dir(spark, "ndjson-declared")
    SK.write_zstd_ndjson(_ev(spark, sf), d, window_log=20)  # within the JVM codec's window
    # declared schema: `title` is not in the files (null); no other key is read
    return FS.read_ndjson(spark, d, EV_DECLARED + ", title string")


@query("scan_ndjson_discovered", "S2", """
select id, author, created_utc, community, score, parent_id from ev where cast(id as bigint) % 97 <> 0""")
def scan_ndjson_discovered(spark, sf):
    d = scratch_dir(spark, "ndjson-discovered")
    e = _ev(spark, sf)
    line = F.when(F.col("id").cast("bigint") % 97 == 0, F.concat(F.lit("not json {"), F.col("id"))) \
            .otherwise(F.to_json(F.struct(*e.columns)))
    e.select(line.alias("value")).write.text(d)
    r = FS.read_ndjson_discovered(spark, d)
    return r.select("id", "author", "created_utc", "community", "score", "parent_id")


@query("scan_ndjson_longwindow", "S3", f"""
select id, author, created_utc, community, score, parent_id from ev""")
def scan_ndjson_longwindow(spark, sf):
    d = scratch_dir(spark, "ndjson-long")
    SK.write_zstd_ndjson(_ev(spark, sf), d, window_log=31)
    return FS.read_zstd_long_window(spark, d, EV_DECLARED)


FRAME = 10_000


@query("scan_zstd_frames", "S3", """
select id, author, created_utc, community, score, parent_id, null::varchar reason, true as side_by_side from ev
 where cast(id as bigint) % 83 <> 0 and cast(id as bigint) % 79 <> 0
union all
select id, null, null, null, null, null, case when cast(id as bigint) % 83 = 0 then 'bytes' else 'json' end, true from ev
 where cast(id as bigint) % 83 = 0 or cast(id as bigint) % 79 = 0""")
def scan_zstd_frames(spark, sf):
    """Files of many frames that end in mid-line, with lines that are no UTF-8 or no
    JSON: the rows, the bad lines, and whether more tasks than files read them."""
    d = scratch_dir(spark, "ndjson-frames")
    e, k = _ev(spark, sf), F.col("id").cast("bigint")
    line = F.when(k % 83 == 0, F.concat(F.unhex(F.lit("FF")), F.col("id").cast("binary"))) \
        .when(k % 79 == 0, F.concat(F.lit("{"), "id").cast("binary")) \
        .otherwise(F.to_json(F.struct(*e.columns)).cast("binary"))
    SK.write_zstd_lines(e.select(line.alias("value")), d, frame_bytes=FRAME)
    # small files are read in eighths, so that groups are tried; large ones in groups of the usual size
    size = spark.read.format("binaryFile").load(d).agg(F.sum("length")).first()[0] or 0
    group = max(1, min(FS.GROUP_BYTES, size // 8))
    good, bad = FS.read_zstd_checked(spark, d, EV_DECLARED, group_bytes=group)
    lines = FS.read_zstd_lines(spark, d, group_bytes=group)
    side = lines.select("file", F.spark_partition_id().alias("task")).agg(
        (F.count_distinct("task") > F.count_distinct("file")).alias("side_by_side"))
    rest = [F.lit(None).cast(good.schema[c].dataType).alias(c) for c in good.columns if c != "id"]
    digits = F.regexp_extract(F.substring("value", 2, 1 << 30).cast("string"), "[0-9]+", 0)
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(
        bad.select(digits.alias("id"), *rest, "reason")).crossJoin(F.broadcast(side))


POST_COLS = ["id", "author", "created_utc", "community", "score", "num_comments", "sentiment_complex"]
POST_SCHEMA = ("id string, author string, created_utc bigint, community string, score bigint, "
               "num_comments bigint, sentiment_complex double")


@query("scan_csv", "S4", f"select {', '.join(POST_COLS)} from posts")
def scan_csv(spark, sf):
    d = scratch_dir(spark, "csv")
    V.posts(spark, sf).select(*POST_COLS).write.option("header", True).csv(d)
    return FS.read_csv(spark, d, POST_SCHEMA)


@query("scan_csv_quarantine", "S5", """
select id, (cast(id as bigint) % 101 = 0 or cast(id as bigint) % 103 = 0) bad from posts""")
def scan_csv_quarantine(spark, sf):
    d = scratch_dir(spark, "csv-bad")
    p = V.posts(spark, sf)
    k = F.col("id").cast("bigint")
    base = F.concat_ws(",", "id", F.coalesce("author", F.lit("")), "created_utc", "community")
    line = (F.when(k % 101 == 0, base)                                                  # short row
            .when(k % 103 == 0, F.concat_ws(",", base, "score", F.lit("extra")))        # long row
            .otherwise(F.concat_ws(",", base, "score")))
    p.select(line.alias("value")).write.text(d)
    good, bad = FS.read_csv_quarantine(spark, d, "id string, author string, created_utc bigint, community string, "
                                                 "score bigint")
    return good.select("id", F.lit(False).alias("bad")).unionByName(
        bad.select(F.coalesce("id", F.split_part("raw", F.lit(","), F.lit(1))).alias("id"), F.lit(True).alias("bad")))


@query("scan_nul_filter", "S6", """
select id, author, case when cast(id as bigint) % 3 = 0 then concat('a"b', chr(10), id) else 'ok' end flag,
       cast(null as bigint) skipped from posts where cast(id as bigint) % 89 <> 0
union all
select 'report', null, null, count(*) from posts where cast(id as bigint) % 89 = 0""")
def scan_nul_filter(spark, sf):
    d = scratch_dir(spark, "nul")
    p = V.posts(spark, sf)
    k = F.col("id").cast("bigint")
    # a header, quoted line breaks and quotes, and NUL bytes in every 89th record
    flag = F.when(k % 89 == 0, F.lit("a\x00b")).when(k % 3 == 0, F.concat(F.lit('a"b\n'), "id")).otherwise(F.lit("ok"))
    p.select("id", "author", flag.alias("flag")).write.option("header", True).option("escape", '"') \
        .option("quoteAll", True).option("nullValue", SK.NULL_MARK).csv(d)
    rows, report = FS.read_csv_without_nul(spark, d, "id string, author string, flag string", multiline=True,
                                            null_value=SK.NULL_MARK)
    total = report.agg(F.sum("skipped").alias("skipped"))
    return rows.withColumn("skipped", F.lit(None).cast("bigint")).unionByName(
        total.select(F.lit("report").alias("id"), F.lit(None).cast("string").alias("author"),
                     F.lit(None).cast("string").alias("flag"), "skipped"))


ACT_SCHEMA = "author string, created_utc bigint, community string, score bigint"


@query("scan_by_filename", "S7", """
select 'post' kind, author, created_utc, community, score from posts
union all select 'reply' kind, author, created_utc, community, score from replies""")
def scan_by_filename(spark, sf):
    d = scratch_dir(spark, "routed")
    cols = ["author", "created_utc", "community", "score"]
    V.posts(spark, sf).select(*cols).write.option("header", True).csv(f"{d}/_posts")
    V.replies(spark, sf).select(*cols).write.option("header", True).csv(f"{d}/_replies")
    _rename_parts(spark, f"{d}/_posts", f"{d}/data", "RS_")
    _rename_parts(spark, f"{d}/_replies", f"{d}/data", "RC_")
    return FS.read_routed(spark, f"{d}/data", {"post": ("RS_*.csv", ACT_SCHEMA), "reply": ("RC_*.csv", ACT_SCHEMA)})


def _rename_parts(spark, src: str, dst: str, prefix: str) -> None:
    """Give Spark part files archive-style names (metadata operations only)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    sp, dp = jvm.org.apache.hadoop.fs.Path(src), jvm.org.apache.hadoop.fs.Path(dst)
    fs = sp.getFileSystem(conf)
    fs.mkdirs(dp)
    for i, st in enumerate(fs.listStatus(sp)):
        name = st.getPath().getName()
        if name.startswith("part-"):
            fs.rename(st.getPath(), jvm.org.apache.hadoop.fs.Path(dp, f"{prefix}{i:05d}.csv"))


DOC_SCHEMA = "id bigint, title string, selftext string"


@query("sink_csv_quoted", "S8", "select id, title, selftext from docs")
def sink_csv_quoted(spark, sf):
    d = scratch_dir(spark, "quoted")
    SK.write_csv_quoted(V.docs(spark, sf).select("id", "title", "selftext"), d)
    return FS.read_csv(spark, d, DOC_SCHEMA, multiline=True, null_value=SK.NULL_MARK)


@query("sink_rolling", "S9", "select id, author, score from posts")
def sink_rolling(spark, sf):
    d = scratch_dir(spark, "rolling")
    SK.write_rolling(V.posts(spark, sf).select("id", "author", "score"), d, max_records=1000)
    return FS.read_csv(spark, d, "id string, author string, score bigint", multiline=True)


@query("sink_merge_parts", "S10", "select id, community, num_comments from posts")
def sink_merge_parts(spark, sf):
    d = scratch_dir(spark, "parts")
    (V.posts(spark, sf).select("id", "community", "num_comments")
     .write.option("header", True).csv(d))
    # every part carries its header; the reader drops each of them
    return FS.read_csv(spark, d, "id string, community string, num_comments bigint")


@query("sink_append", "S11", "select link_id, parent_id, author, score, month from replies")
def sink_append(spark, sf):
    d = scratch_dir(spark, "append")
    r = V.replies(spark, sf).select("link_id", "parent_id", "author", "score", "month")
    SK.append_partitioned(r.filter(F.col("month") < "1998-01"), d)
    SK.append_partitioned(r.filter(F.col("month") >= "1998-01"), d)
    return spark.read.parquet(d).select("link_id", "parent_id", "author", "score", "month")


@query("sink_replace", "S12 F3", "select id, community, community_grp from tposts")
def sink_replace(spark, sf):
    from ..functions.tags import community_group
    from ..params import FIXTURE_GROUPS
    t = scratch_dir(spark, "replace")
    SK.replace_versioned(V.posts(spark, sf).select("id", "community"), t)
    cur = SK.read_versioned(spark, t)
    SK.replace_versioned(cur.withColumn("community_grp", community_group("community", FIXTURE_GROUPS)), t)
    return SK.read_versioned(spark, t)


@query("sink_upsert", "S13", """
with old as (select id, author, sentiment_complex from posts),
new as (select link_id id, null::varchar author, avg(sentiment) sentiment_complex from replies
         group by link_id
        union all
        select concat('ev', id) id, author, null::double sentiment_complex from ev)
select coalesce(n.id, o.id) id, coalesce(n.author, o.author) author,
       round(coalesce(n.sentiment_complex, o.sentiment_complex), 6) sentiment_complex
from old o full outer join new n on o.id = n.id""")
def sink_upsert(spark, sf):
    old = V.posts(spark, sf).select("id", "author", "sentiment_complex")
    upd = (V.replies(spark, sf).groupBy(F.col("link_id").alias("id"))
           .agg(F.avg("sentiment").alias("sentiment_complex")))
    ins = V.ev(spark, sf).select(F.concat(F.lit("ev"), "id").alias("id"), "author",
                                 F.lit(None).cast("double").alias("sentiment_complex"))
    new = upd.unionByName(ins, allowMissingColumns=True)
    return SK.upsert(old, new, "id")


@query("set_fields", "S14", """
with v as (select link_id id, avg(sentiment) s from replies group by link_id)
select p.id, p.author, round(coalesce(p.sentiment_complex, v.s), 6) sentiment_complex
from posts p left join v on p.id = v.id""")
def set_fields(spark, sf):
    p = V.posts(spark, sf).select("id", "author", "sentiment_complex")
    v = V.replies(spark, sf).groupBy(F.col("link_id").alias("id")).agg(F.avg("sentiment").alias("sentiment_complex"))
    return SK.set_fields(p, v, "id", ["sentiment_complex"], overwrite=False)


LATE = "1997-06"  # months that the write-backs of single partitions touch start here


def _by_month(spark, sf, name):
    """Posts as a stored table by month, and its files: (path, file names)."""
    from ..session import materialize
    d = scratch_dir(spark, name)
    SK.append_partitioned(V.posts(spark, sf).select("id", "author", "sentiment_complex", "month"), d)
    before = spark.read.parquet(d).select(F.col("_metadata.file_path").alias("file")).distinct()
    return d, materialize(before, f"{name}-files")


def _with_kept(spark, table, before):
    """Rows of ``table``, with whether their file was there before the write-back."""
    rows = spark.read.parquet(table).select("id", "author", "sentiment_complex", F.col("month").cast("string").alias("month"),
                                            F.col("_metadata.file_path").alias("file"))
    return rows.join(before.withColumn("kept", F.lit(True)), on="file", how="left") \
        .select("id", "author", "sentiment_complex", "month", F.coalesce("kept", F.lit(False)).alias("kept"))


@query("upsert_by_month", "S13", f"""
with new as (select p.id, avg(r.sentiment) s from posts p join replies r on r.link_id = p.id
              where p.month >= '{LATE}' group by p.id),
rows as (select p.id, p.author, round(coalesce(n.s, p.sentiment_complex), 6) sentiment_complex, p.month
           from posts p left join new n on p.id = n.id
         union all select concat('ev', id), author, null, '2100-01' from ev),
touched as (select distinct p.month from posts p join new n on p.id = n.id union select '2100-01')
select id, author, sentiment_complex, month, month not in (select month from touched) kept from rows""")
def upsert_by_month(spark, sf):
    """S13 into a table by month: new scores for late posts, new rows in a new month;
    ``kept``: the row's file is the one from before."""
    d, before = _by_month(spark, sf, "upsert-month")
    late = V.posts(spark, sf).filter(F.col("month") >= LATE).select("id")
    upd = V.replies(spark, sf).groupBy(F.col("link_id").alias("id")).agg(F.avg("sentiment").alias("sentiment_complex")) \
        .join(late, on="id", how="left_semi")
    ins = V.ev(spark, sf).select(F.concat(F.lit("ev"), "id").alias("id"), "author", F.lit("2100-01").alias("month"))
    SK.upsert_partitions(spark, d, upd.unionByName(ins, allowMissingColumns=True), "id")
    return _with_kept(spark, d, before)


@query("set_fields_by_month", "S14", f"""
with v as (select p.id, avg(r.sentiment) s from posts p join replies r on r.link_id = p.id
            where p.month >= '{LATE}' group by p.id),
touched as (select distinct p.month from posts p join v on p.id = v.id)
select p.id, p.author, round(coalesce(p.sentiment_complex, v.s), 6) sentiment_complex, p.month,
       p.month not in (select month from touched) kept
from posts p left join v on p.id = v.id""")
def set_fields_by_month(spark, sf):
    """S14 in a table by month: a score for late posts that have none."""
    d, before = _by_month(spark, sf, "set-month")
    late = V.posts(spark, sf).filter(F.col("month") >= LATE).select("id")
    v = V.replies(spark, sf).groupBy(F.col("link_id").alias("id")).agg(F.avg("sentiment").alias("sentiment_complex")) \
        .join(late, on="id", how="left_semi")
    SK.set_fields_partitions(spark, d, v, "id", ["sentiment_complex"], overwrite=False)
    return _with_kept(spark, d, before)


@query("sink_layout", "S15 P8", """
select link_id, author, score, month from replies where month = '1997-06'""")
def sink_layout(spark, sf):
    d = scratch_dir(spark, "layout")
    SK.write_layout(V.replies(spark, sf).select("link_id", "author", "score", "month"), d, tiebreak=("link_id",))
    return spark.read.parquet(d).filter(F.col("month") == "1997-06").select("link_id", "author", "score", "month")


ROLL = 20_000


@query("sink_rolling_bytes", "S9", "select id, author, score, true as within from posts")
def sink_rolling_bytes(spark, sf):
    """Every row read back, with whether its part's file keeps the bound (and one row more)."""
    d = scratch_dir(spark, "rolling-bytes")
    SK.write_rolling_bytes(V.posts(spark, sf).select("id", "author", "score"), d, ROLL)
    rows = spark.read.schema("id string, author string, score bigint, roll string").option("header", True) \
        .option("escape", '"').csv(d)
    return rows.select("id", "author", "score", (F.col("_metadata.file_size") <= ROLL + 200).alias("within"))


LOOK_UPS = {"created_day": "1997-06-01", "community": "1-URGENT/F", "parent_id": "1:1", "author": "u1"}


def _indexed(spark, sf):
    d = scratch_dir(spark, "indexed")
    r = V.replies(spark, sf).select("link_id", "parent_id", "author", "created_day", "community", "score", "month")
    SK.write_layout(r, f"{d}/rows", tiebreak=("link_id",))
    SX.build_index(spark, f"{d}/rows", list(LOOK_UPS), f"{d}/index")
    return f"{d}/rows", f"{d}/index"


@query("index_lookup", "S15", " union all ".join(
    f"select '{k}' as key_name, link_id, parent_id, author, created_day, community, score from replies where cast({k} as varchar) = '{v}'"
    for k, v in LOOK_UPS.items()))
def index_lookup(spark, sf):
    """Rows found through the data-skipping index, for one value of every key."""
    table, index = _indexed(spark, sf)
    outs = [SX.look_up(spark, table, index, k, [v]).select(
        F.lit(k).alias("key_name"), "link_id", "parent_id", "author", "created_day", "community", "score") for k, v in LOOK_UPS.items()]
    return reduce(lambda a, b: a.unionByName(b), outs)


@query("index_files", "S15")
def index_files(spark, sf):
    """For every key: the files that its look-up reads, those that hold the value, all files."""
    table, index = _indexed(spark, sf)
    per = spark.read.parquet(table).withColumn("file", F.col("_metadata.file_path"))
    total = per.agg(F.count_distinct("file").alias("files_all"))
    out = [(k, len(SX.files_for(spark, index, k, [v]))) for k, v in LOOK_UPS.items()]
    read = spark.createDataFrame(out, "key_name string, files_read int")
    holding = [per.filter(F.col(k).cast("string") == v).agg(F.count_distinct("file").alias("files_holding"))
               .select(F.lit(k).alias("key_name"), "files_holding") for k, v in LOOK_UPS.items()]
    return read.join(reduce(lambda a, b: a.unionByName(b), holding), "key_name").crossJoin(total)
