"""Session settings and materialisation."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Adaptive execution does the partition sizing and the skew joins; UTC keeps times comparable.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",  # checkpoints go when nothing refers to them
}


def session(master: str = "local[*]", **settings: str) -> SparkSession:
    return SparkSession.builder.master(master).config(map=SETTINGS | settings).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of checkpoints, which all executors share.

    Where none is set, a temporary folder is, but only if the session runs on this machine alone:
    executors of a cluster don't see each other's disks, so there it is an error.
    """
    context = spark.sparkContext
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="granary-"))
    return context.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/granary-{uuid.uuid4().hex}/{name}"


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder that scratch() named, in whatever store it is."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    if not folder.getName().startswith("granary-"):
        raise ValueError(f"{path} is no scratch folder")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialized(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
