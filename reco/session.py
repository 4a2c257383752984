"""Spark session helpers.

Everything in this package is plain DataFrame / SQL / ``pyspark.ml`` code; the
only session-level concerns are AQE (runtime coalescing and skew-join
splitting), a sane shuffle width, and a *shared* checkpoint directory for
lineage cuts in iterative jobs (ALS, parameter grids).
"""

from __future__ import annotations

import gc
import math
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(master: str | None = None, app: str = "reco",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Session for local runs and tests.

    On a cluster the session normally comes from ``spark-submit``; this helper
    only fills in what is unset.  The Spark UI stays off.
    """
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus)
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", str(parts))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.driver.memory", os.environ.get("RECO_DRIVER_MEMORY", "16g"))
         .config("spark.sql.files.maxPartitionBytes", str(64 * 1024 * 1024))
         # remove reliable checkpoints once their DataFrames are garbage
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    from reco.deploy import ship_package
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder the cluster names, if any."""
    d = spark.conf.get(CHECKPOINT_CONF, None)
    if d:
        return d
    return spark.sparkContext.getCheckpointDir()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use ``spark.checkpoint.dir`` when the cluster sets it; otherwise create a
    fresh scratch folder on a ``local`` master (runs and tests on one machine),
    and raise on any other."""
    d = spark.conf.get(CHECKPOINT_CONF, None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="reco-ckpt-")
        spark.conf.set(CHECKPOINT_CONF, d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def app_scratch_dir(spark: SparkSession) -> str:
    """This application's own folder under the shared checkpoint directory
    (Spark creates one per application)."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that nobody holds any more:
    its cleaner acts when the driver's JVM collects its garbage, which a driver
    with little to do may not do before the disk is full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a table in the application's folder and read from
    there (a lineage cut several times smaller than a checkpoint, whose rows are
    not encoded); the shuffle files it was made from go."""
    path = f"{app_scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    free_shuffles(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def passes_for(spark: SparkSession, rows: int, pass_rows: int) -> int:
    """Passes of a job that shuffles ``rows`` rows: ``pass_rows`` each on up to
    eight cores, more on larger clusters (whose disks grow with them)."""
    return max(1, math.ceil(rows / (pass_rows * max(1, spark.sparkContext.defaultParallelism / 8))))


def in_pass(key: Column, passes: int, i: int) -> Column:
    """Whether the entity ``key`` is worked out in pass ``i``."""
    return F.pmod(F.xxhash64(key.cast("long"), F.lit(23)), F.lit(passes)) == i


def each_pass(passes: int, work, name: str) -> DataFrame:
    """The union of what ``work(i)`` gives; with several passes each is stored
    before the next begins, so that the disk holds the shuffle of one."""
    if passes == 1:
        return work(0)
    out = None
    for i in range(passes):
        part = stored(work(i), name)
        out = part if out is None else out.unionByName(part)
    return out


def drop_checkpoints(spark: SparkSession) -> None:
    """Delete this application's checkpoint folder (checkpoints and scratch
    exports) through the Hadoop FileSystem API, so it works for any shared FS
    URI.  Call at the end of a job, after every result has been consumed."""
    d = spark.sparkContext.getCheckpointDir()
    if not d:
        return
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(d)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(path):
        fs.delete(path, True)
