"""Folders of quote archives: which of them hold a period, and a scan that opens no others."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .quotes import LAYOUT, list_archives, parse_records, unpack_records

#: How yearly and monthly archives are named: fixed by the publisher.
NAME = r"COTAHIST_(?:A|M(\d{2}))(\d{4})\.ZIP$"


def catalogue(paths: DataFrame, path: str = "path") -> DataFrame:
    """The archives among the paths, with their year and month (null: the whole year); other files are left out."""
    name = F.upper(F.col(path))
    found = paths.filter(name.rlike(NAME))
    return found.withColumn("year", F.regexp_extract(name, NAME, 2).cast("int")).withColumn("month", F.nullif(F.regexp_extract(name, NAME, 1), F.lit("")).cast("int"))


def months_of(spark: SparkSession, first: dt.date, last: dt.date) -> DataFrame:
    """(year, month) of every month that a period touches; none if it ends before it begins."""
    count = max(0, (last.year - first.year) * 12 + last.month - first.month + 1) if first <= last else 0
    start = first.year * 12 + first.month - 1
    return spark.range(start, start + count).select(F.floor(F.col("id") / 12).cast("int").alias("year"), (F.col("id") % 12 + 1).cast("int").alias("month"))


def holding(archives: DataFrame, months: DataFrame) -> DataFrame:
    """The archives that a period's months are read from, each with the months it serves: a month's own archive, or its year's where it has none.

    Of several archives of one month or year, such as copies in two folders,
    the one whose path comes last counts, so no record is read twice.
    """
    one = Window.partitionBy("year", "month").orderBy(F.desc("path"))
    once = archives.withColumn("_rank", F.row_number().over(one)).filter("_rank = 1").drop("_rank")
    own = once.filter("month is not null").join(months, ["year", "month"])
    rest = months.join(own.select("year", "month"), ["year", "month"], "left_anti").groupBy("year").agg(F.collect_set("month").alias("months"))
    return own.withColumn("months", F.array("month")).unionByName(once.filter("month is null").join(rest, "year").select(*own.columns, "months"))


def missing_months(archives: DataFrame, months: DataFrame) -> DataFrame:
    """The months of a period that no archive holds: what is left to fetch."""
    held = holding(archives, months).select("year", F.explode("months").alias("month"))
    return months.join(held, ["year", "month"], "left_anti")


def records_of(archives: DataFrame, first: dt.date, last: dt.date, layout: tuple = LAYOUT, market: str | None = None) -> DataFrame:
    """Records of a period from archives (year, months, content).

    Lines of other kinds, days and markets go before they are parsed: these
    are fixed places of a line. An archive may serve some of its months only.
    """
    lines = unpack_records(archives)
    day = F.substring("value", 3, 8)
    kept = F.col("value").startswith("01") & day.between(first.strftime("%Y%m%d"), last.strftime("%Y%m%d"))
    if market is not None:
        kept = kept & (F.substring("value", 25, 3) == market)
    return parse_records(lines.filter(kept), layout)


def read_period(spark: SparkSession, folder: str, first: dt.date, last: dt.date, layout: tuple = LAYOUT, market: str | None = None) -> DataFrame:
    """Records of a period from a folder of archives, on whatever file system Spark reads.

    The folder is listed without its contents; the names decide, and only the
    archives of the period's months are opened. Their paths, one an archive,
    pass through the driver. A yearly archive also serves months that have an
    archive of their own: these are dropped from it by the dates of the lines.
    No archive of the period gives no rows.
    """
    chosen = holding(catalogue(list_archives(spark, folder)), months_of(spark, first, last)).select("path", "year", "month", "months").collect()
    if not chosen:
        return parse_records(spark.createDataFrame([], "value string"), layout)
    parts = []
    yearly = [r for r in chosen if r["month"] is None]
    monthly = [r["path"] for r in chosen if r["month"] is not None]
    if monthly:
        parts.append(records_of(spark.read.format("binaryFile").load(monthly), first, last, layout, market))
    if yearly:
        served = [f"{r['year']:04d}{m:02d}" for r in yearly for m in r["months"]]
        rows = records_of(spark.read.format("binaryFile").load([r["path"] for r in yearly]), first, last, layout, market)
        parts.append(rows.filter(F.date_format("obs_date", "yyyyMM").isin(served)))
    return parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0]
