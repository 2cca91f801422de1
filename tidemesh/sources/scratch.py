"""Folders for what queries write and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder under the session's ``spark.checkpoint.dir``, which all machines share; a temporary one only where the master is this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    master = spark.sparkContext.master
    if not base and not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir names no folder, and a temporary one would lie on one machine of the cluster")
    return f"{base or tempfile.mkdtemp(prefix='tidemesh-')}/scratch-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` materialised in the shared folder, for what several parts of a plan need and is dear to make."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder(df.sparkSession))
    return df.checkpoint(eager=True)
