"""Rolling windows over a stream of events: an extension, not something the batch queries need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_events(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stream of the files that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def rolling_counts(rows: DataFrame, lateness: str | None, length: str, step: str) -> DataFrame:
    """Events and their values per type in sliding windows: (start, end, event_type, events, value_sum).

    With ``lateness`` the stream drops what is later than that and forgets
    closed windows. Calendar months aren't expressible as stream windows; the
    batch operators serve those.
    """
    if lateness:
        rows = rows.withWatermark("ts", lateness)
    out = rows.groupBy(F.window("ts", length, step).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value_sum"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "events", "value_sum")
