"""Session settings and the one place that knows about checkpoint storage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings a cluster job should start with. AQE coalesces the generous shuffle-partition
# count down and splits skewed join partitions at run time.
SESSION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "100000",
}


def build_session(app_name: str, master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the package to the Python workers, once per application, so that a job may start from any folder."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="package-")  # on the driver only; Spark hands it out
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "witnessgrid.zip")
    with zipfile.ZipFile(target, "w") as packed:
        for place, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(place, name)
                    packed.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(target)
    _shipped.add(context.applicationId)


BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of about 4 MB: by rows alone, long texts make batches of many times that, held by
    the JVM and by each Python worker at once. A smaller limit of the session stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    told = spark.conf.get(name, None)
    if told is None or not told.isdigit() or int(told) > BATCH_BYTES or int(told) <= 0:
        spark.conf.set(name, str(BATCH_BYTES))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of ``spark.checkpoint.dir``; a temporary one only in local mode."""
    if spark.sparkContext.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss, unlike a local checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared checkpoint folder; what is there goes when the application ends."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def stash(df: DataFrame, codec: str | None = None) -> DataFrame:
    """``df`` written once as Parquet in the shared checkpoint folder and read back.

    Like :func:`cut_lineage`, but columnar and compressed, so later reads prune columns and
    the planner knows the size.
    """
    spark = df.sparkSession
    path = shared_path(spark, "stash")
    df.write.parquet(path, compression=codec)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._stash_path = path
    return kept


def drop_stash(df: DataFrame) -> None:
    """Free the files of a frame that :func:`stash` returned, or of running totals, once nothing reads them any more."""
    target = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._stash_path)
    target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
