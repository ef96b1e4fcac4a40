"""Reading tables, and the shared folder in which lineage is cut."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a folder of parquet tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder for checkpoints: the one that the session names, else (only in local mode) a new one.

    A cluster must name a folder that all executors share, so there an unset folder is an error
    and never a machine's own temporary one.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if context._jsc.sc().getCheckpointDir().isEmpty():
            context.setCheckpointDir(named)
        return named
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="refrain-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(frame: DataFrame) -> DataFrame:
    """``frame`` written to the checkpoint folder and read from there: a lost executor loses nothing."""
    checkpoint_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)
