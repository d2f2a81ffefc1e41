"""The Spark session and the way tables are read."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(cpus: int | str = "*", shuffle: int = 8, app: str = "foliant") -> SparkSession:
    """A local session with UTC time, AQE and Arrow; a cluster supplies its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


ROOT = str(Path(__file__).resolve().parent.parent)


def reach(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package from where the driver has it; a cluster installs or ships it."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    reach(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the cluster's spark.checkpoint.dir, else (in local tests) a new temporary one."""
    set_ = spark.conf.get("spark.checkpoint.dir", None)
    if set_:
        return set_
    folder = "file://" + tempfile.mkdtemp(prefix="foliant-")
    if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        spark.conf.set("spark.checkpoint.dir", folder)
        return folder
    raise RuntimeError("spark.checkpoint.dir names no shared folder: " + os.environ.get("SPARK_MASTER", ""))


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


@contextmanager
def cancellable(spark: SparkSession, name: str) -> Iterator[Callable[[], None]]:
    """Work inside carries a tag; the function given ends it, from any thread: running tasks stop and none is begun."""
    tag = f"foliant-{name}"
    context = spark.sparkContext
    context.addJobTag(tag)
    context.setInterruptOnCancel(True)
    try:
        yield lambda: context.cancelJobsWithTag(tag)
    finally:
        context.removeJobTag(tag)
        context.setInterruptOnCancel(False)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system that Spark writes to; one that isn't there is no error."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
