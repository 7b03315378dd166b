"""Sessions, the shared folder and written tables."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def local_session(cores: int | str = 8, name: str = "tidewatch") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset on one
    machine, as in tests, a temporary folder is made and set.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidewatch-")
        spark.conf.set(CHECKPOINT_DIR, folder)
    return folder.rstrip("/")


def work_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for one run of an operator, below the shared folder."""
    return f"{shared_folder(spark)}/tidewatch/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str, mode: str = "error") -> DataFrame:
    """Write ``df`` and read it back: lineage ends here, and a lost executor costs a reread."""
    df.write.mode(mode).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def released(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps; it does so when the driver's objects for them are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
