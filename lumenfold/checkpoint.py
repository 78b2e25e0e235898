"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's `spark.checkpoint.dir`. Where it is unset, a temporary folder if all runs on this machine (as in tests), else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="spark-ckpt-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """`df` worked out once and written to the shared folder, and read from there from now on.

    With `spark.cleaner.referenceTracking.cleanCheckpoints` Spark removes the files once nothing refers to them.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_table(df: DataFrame) -> DataFrame:
    """As `shared_checkpoint`, as a Parquet table of its own, for wide rows of which later steps read a few columns."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
