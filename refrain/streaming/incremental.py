"""Micro-batches over new files, upserts and expiring keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from refrain.operators.state import last_writer, pending, upsert


def read_new_files(spark: SparkSession, folder: str, like: DataFrame, files_a_batch: int = 100) -> DataFrame:
    """A stream of the parquet files of ``folder``; files already seen stay in the checkpoint."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def run_batches(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """``work`` for each micro-batch, every ``every`` (such as '5 minutes') or once over what there is."""
    writer = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def upsert_into(path: str, keys: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """K1, K5: a batch writer that keeps the last row of each key under ``path/v=<batch>``; a batch that runs again writes the same version.

    The table is the highest version up to the last finished batch, so readers never see half a batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = last_writer(batch, keys, order).select(*batch.columns)
        old = current(spark, path, number)
        rows = new if old is None else last_writer(old.unionByName(new), keys, order).select(*batch.columns)
        rows.write.mode("overwrite").parquet(f"{path}/v={number}")

    return write


def current(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The latest version of a table written by ``upsert_into`` (before version ``before``), or None."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(fs_path):
        return None
    done = [int(s.getPath().getName()[2:]) for s in fs.listStatus(fs_path) if s.getPath().getName().startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    done = [v for v in done if before is None or v < before]
    return spark.read.parquet(f"{path}/v={max(done)}") if done else None


def changed_only(keys: list[str], marks: list[str], known: Callable[[SparkSession], DataFrame | None], work: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A batch writer that hands on only rows that are new or whose marks changed (the file source alone sees new files only)."""

    def write(batch: DataFrame, number: int) -> None:
        before = known(batch.sparkSession)
        work(batch if before is None else pending(batch, before, keys, marks))

    return write


def first_within(stream: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """I4: the first row of each key within the life that ``delay`` gives a key; state ends with the watermark."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def counts_by_window(stream: DataFrame, at: str, size: str, delay: str, key: str) -> DataFrame:
    """Counts of ``key`` in windows of ``size``; rows later than ``delay`` are left out."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, size).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


__all__ = ["changed_only", "counts_by_window", "current", "first_within", "read_new_files", "run_batches", "upsert", "upsert_into"]
