"""Session services shared by the operators: shipping the package to the
executors, and cutting lineage in storage that every executor can read."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

_PACKAGE_DIR = os.path.dirname(os.path.abspath(__file__))
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors, once per application.

    Spark's own file server hands the archive out, so nothing depends on a
    folder that driver and executors share.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(_PACKAGE_DIR)
    target = os.path.join(tempfile.mkdtemp(prefix="maskloom-"), "maskloom.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(_PACKAGE_DIR):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, root))
    context.addPyFile(target)
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share.

    Where it is unset, a folder of this machine serves a local session; on a cluster that fails,
    as executors of other machines could neither write nor read there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", "")
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("Set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="maskloom-checkpoints-")
    spark.sparkContext.setCheckpointDir(local)
    return local


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder that a job of this package wrote, by the file system that holds it."""
    if "/pipeline-" not in folder and "/warc-" not in folder:
        raise ValueError("Only folders of this package's jobs are removed")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` eagerly into the shared folder and go on from there.

    A lost executor then costs a re-read of those files, not of the lineage.
    """
    spark = df.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Deal out a small scan: a file of one row group would run as one task.

    Inputs of several waves of tasks are left alone, so nothing is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < 2 * cores else df
