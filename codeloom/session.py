"""Session defaults and the shared work folder.

Nothing here overrides what a cluster has set: a value is applied only where
the running session has none of its own.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "codeloom", cores: int | None = None, shuffle: int = 8) -> SparkSession:
    """A single-machine session for tests and the benchmark; its shared folder goes with the process."""
    shared = tempfile.mkdtemp(prefix="codeloom-")
    atexit.register(shutil.rmtree, shared, ignore_errors=True)
    spark = (
        SparkSession.builder.master(f"local[{cores or '*'}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CODELOOM_DRIVER_MEMORY", "12g"))
        .config("spark.checkpoint.dir", f"file://{shared}")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset (a test on one machine) a temporary folder is taken, which goes with the process.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = getattr(spark.sparkContext, "_codeloom_shared", None)
        if path is None:
            folder = tempfile.mkdtemp(prefix="codeloom-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            path = spark.sparkContext._codeloom_shared = f"file://{folder}"
    return path.rstrip("/")


def work_dir(spark: SparkSession) -> str:
    """The folder of this application's work tables; ``release`` drops it."""
    return f"{shared_dir(spark)}/codeloom/{spark.sparkContext.applicationId}"


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table under the shared folder."""
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and its Path class."""
    jvm = spark._jvm
    return jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a work table that nothing reads any more."""
    fs, make = file_system(spark, path)
    fs.delete(make(path), True)


def release(spark: SparkSession) -> None:
    """Deletes all work tables of this application; results that still read them must have been written."""
    drop(spark, work_dir(spark))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage by a table in the shared folder, which outlives lost executors."""
    path = work_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
