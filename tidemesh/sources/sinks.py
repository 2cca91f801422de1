"""Sinks: partitioned tables, delimited files, GraphML and LaTeX."""

from __future__ import annotations

import zipfile
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_by_window(df: DataFrame, path: str, window: str = "window_id", max_records: int = 2_000_000) -> None:
    """A table partitioned by window; large windows have several files."""
    df.repartition(window).write.option("maxRecordsPerFile", max_records).partitionBy(window).mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", header: bool = True) -> None:
    df.write.option("header", header).mode(mode).csv(path)


#: What a failed write says if a task ran out of memory.
OUT_OF_MEMORY = ("OutOfMemoryError", "Java heap space", "GC overhead limit", "Container killed", "exceeding memory limits", "UNABLE_TO_ACQUIRE_MEMORY")


def write_csv_by_window(df: DataFrame, path: str, parts: int = 400, max_records: int = 150_000, attempts: int = 3, window: str = "window_id") -> int:
    """Delimited files of bounded length, rows of a window together; a write that runs out of memory is tried again with files half as long, any other failure is raised. The length that went through."""
    for k in range(attempts):
        try:
            df.repartition(parts, window).sortWithinPartitions(window).write.option("header", True).option("maxRecordsPerFile", max(max_records >> k, 1)).mode("overwrite").csv(path)
        except Exception as e:
            if k == attempts - 1 or not any(x in str(e) for x in OUT_OF_MEMORY):
                raise
        else:
            return max(max_records >> k, 1)
    raise ValueError("attempts must be positive")


def merge_to_one(spark: SparkSession, path: str, target: str) -> None:
    """The files of ``write_csv_by_window`` as one file under one header, for tools that want that: one task passes the rows through."""
    rows = spark.read.option("header", True).csv(path)
    rows.coalesce(1).write.option("header", True).mode("overwrite").csv(target)


def fields_of(frames: list[DataFrame], preferred: list[str] | None = None) -> list[str]:
    """The preferred columns, then all others in the order in which they first appear."""
    return list(dict.fromkeys([*(preferred or []), *[c for f in frames for c in f.columns]]))


def write_rows(frames: list[DataFrame], path: str, fields: list[str] | None = None) -> None:
    """Rows of tables with different columns as delimited text; what a table lacks is empty."""
    names = fields or fields_of(frames)
    rows = [f.select(*[F.col(f"`{c}`").cast("string").alias(c) if c in f.columns else F.lit(None).cast("string").alias(c) for c in names]) for f in frames]
    write_csv(union_rows(rows), path)


def union_rows(frames: list[DataFrame]) -> DataFrame:
    """Rows of tables with different columns; what one lacks is null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def graphml(edges: DataFrame, window: int) -> DataFrame:
    """GraphML lines of one window's graph, ordered by ``line``; a graph is a planar one, so its lines are few."""
    e = edges.filter(F.col("window_id") == window)
    quote = lambda c: F.replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    nodes = e.select(F.col("u").alias("n")).union(e.select("v")).distinct().select(F.lit(1).alias("part"), F.concat(F.lit('<node id="'), quote("n"), F.lit('"/>')).alias("line"))
    links = e.select(F.lit(2).alias("part"), F.concat(F.lit('<edge source="'), quote("u"), F.lit('" target="'), quote("v"), F.lit('"><data key="d0">'), F.col("distance").cast("string"), F.lit("</data></edge>")).alias("line"))
    spark = edges.sparkSession
    head = spark.createDataFrame([(0, f'<?xml version="1.0" encoding="utf-8"?><graphml><key id="d0" for="edge" attr.name="distance" attr.type="double"/><graph id="{escape(str(window))}" edgedefault="undirected">'), (3, "</graph></graphml>")], "part int, line string")
    return head.unionByName(nodes).unionByName(links)


def append_log(spark: SparkSession, path: str, source: str, status: str, rows: int, first: str | None = None, last: str | None = None) -> None:
    """One line of an ingest log table: what was fetched, how it went, its rows and its range of dates."""
    line = spark.sql("SELECT current_timestamp() AS at").select("at", F.lit(source).alias("source"), F.lit(status).alias("status"), F.lit(rows).cast("long").alias("rows"), F.lit(first).cast("date").alias("first_day"), F.lit(last).cast("date").alias("last_day"))
    line.write.mode("append").parquet(path)


def append_logs(fetches: DataFrame, path: str) -> None:
    """Many lines of an ingest log at once: (source, status, rows, first_day, last_day) each, with the time of the write."""
    fetches.select(F.current_timestamp().alias("at"), "source", "status", "rows", "first_day", "last_day").write.mode("append").parquet(path)


def log_summary(log: DataFrame) -> DataFrame:
    """Of an ingest log: fetches, those that failed, the rows that came, and the dates from the first to the last."""
    good = F.col("status") == "success"
    return log.agg(
        F.count(F.lit(1)).alias("fetches"), F.sum((~good).cast("int")).alias("failed"), F.sum(F.when(good, F.col("rows")).otherwise(0)).alias("total_rows"),
        F.min(F.when(good, F.col("first_day"))).alias("first_day"), F.max(F.when(good, F.col("last_day"))).alias("last_day"), F.max("at").alias("last_update"),
    )


def zip_files(folder: str, pattern: str, target: str) -> int:
    """Files of the driver's folder that match, such as rendered figures, in one archive; their number."""
    found = sorted(Path(folder).glob(pattern))
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in found:
            z.write(f, f.name)
    return len(found)
