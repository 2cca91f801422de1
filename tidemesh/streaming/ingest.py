"""Restartable ingest: files that arrive become rows of a partitioned table, each batch once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = "batch_id"


def overwrite_partitions(df: DataFrame, path: str, *columns: str) -> None:
    """Write ``df`` partitioned by ``columns``; partitions that it holds are replaced, all others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*columns).parquet(path)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that may not be there yet: then it has no rows. Only a missing path counts as that."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


LOG_SCHEMA = f"rows long, first_day date, last_day date, {BATCH} long"


def ingest_files(
    spark: SparkSession, source: str, checkpoint: str, table: str, log: str, transform: Callable[[DataFrame], DataFrame], partition: str, date_col: str,
    file_format: str = "parquet", files_per_batch: int = 1000, schema=None,
) -> int:
    """Take the files of ``source`` that no earlier run took, batch by batch, and end; the number of batches.

    Spark's file stream remembers in ``checkpoint`` which files went into
    which batch. A batch's rows, after ``transform``, become the partitions
    (``partition``, batch_id) of ``table``, and its line of the log the
    partition batch_id of ``log``: rows taken, first and last ``date_col``. A
    batch whose run was lost, between the two writes or anywhere else, comes
    again with the same number and the same files and replaces what it had
    written, so every file counts once. Only one writer may run at a time.

    Defined cases: an empty batch, or one that ``transform`` leaves nothing
    of, writes a log line with 0 rows; files that are taken are not looked at
    again, even if they change.
    """
    taken: list[int] = []

    def write(batch: DataFrame, batch_id: int) -> None:
        # Rows and log are two outputs of one scan; files are few enough to be read for each.
        rows = transform(batch).withColumn(BATCH, F.lit(batch_id).cast("long"))
        overwrite_partitions(rows, table, partition, BATCH)
        day = F.col(date_col).cast("date")
        line = batch.agg(F.count(F.lit(1)).alias("rows"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))
        overwrite_partitions(line.withColumn(BATCH, F.lit(batch_id).cast("long")), log, BATCH)
        taken.append(batch_id)

    shape = schema if schema is not None else spark.read.format(file_format).load(source).schema
    stream = spark.readStream.format(file_format).schema(shape).option("maxFilesPerTrigger", files_per_batch).load(source)
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(taken)
