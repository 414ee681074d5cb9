"""Session settings the engine relies on, and the shared scratch location."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every query assumes.  Day/month tags are UTC (not the host zone).
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app: str = "cohortlens", extra: dict | None = None) -> SparkSession:
    """Local/test session.  On a cluster the launcher supplies master, memory and
    ``spark.checkpoint.dir``; only the engine settings are forced here."""
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.driver.memory", os.environ.get("COHORTLENS_DRIVER_MEM", "8g")))
    for k, v in {**ENGINE_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_engine_conf(spark)
    return spark


def ensure_engine_conf(spark: SparkSession) -> None:
    """Apply the runtime-settable engine settings to a session made elsewhere,
    and make the package importable by the Python workers."""
    for k, v in ENGINE_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    ship_package(spark)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers (``addPyFile``, the
    runtime form of ``--py-files``) once per SparkContext, so pandas UDFs and
    ``mapInPandas`` functions defined here unpickle wherever the driver runs."""
    sc = spark.sparkContext
    if getattr(sc, "_cohortlens_shipped", False):
        return
    import io
    import uuid
    import zipfile

    import pyarrow.fs as pafs
    pkg = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    # the archive goes to the shared checkpoint folder (any Arrow filesystem)
    base = scratch_dir(spark)
    uri = base if "://" in base else "file://" + (base[5:] if base.startswith("file:") else base)
    fs, root = pafs.FileSystem.from_uri(uri)
    fs.create_dir(f"{root}/_pkg", recursive=True)
    name = f"_pkg/cohortlens-{uuid.uuid4().hex[:12]}.zip"
    with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
        out.write(buf.getvalue())
    sc.addPyFile(f"{base}/{name}")
    sc._cohortlens_shipped = True


def scratch_dir(spark: SparkSession, name: str | None = None) -> str:
    """A fresh folder under the cluster's shared ``spark.checkpoint.dir``.

    The setting is read from the session; only when it is unset (local tests)
    is a temporary folder created and registered as the checkpoint dir.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="cohortlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    base = base.rstrip("/")
    if name is None:
        return base
    # unique child so that re-runs never read an earlier run's files
    import uuid
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df, path: str):
    """``df`` written as Parquet to ``path`` and read back; the shuffle files of the job go
    as soon as it has ended, not when the driver collects its garbage."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode("errorifexists").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a stored intermediate that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df, name: str):
    """Write ``df`` once as Parquet under the shared checkpoint folder and read
    it back: cuts the lineage of an intermediate that several branches of a
    plan consume (each would otherwise recompute it from the sources), and a
    lost executor re-reads files instead of recomputing the upstream joins.
    The read-back keeps column pruning and filter pushdown (unlike an RDD
    checkpoint)."""
    return stored(df, scratch_dir(df.sparkSession, name))
