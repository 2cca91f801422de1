"""Keeps a table of rolling pair correlations up to date while trades arrive.

    python -m jobs.rolling_correlations --trades DIR --assets DIR --output DIR --checkpoint DIR [--config FILE]

Trades are the files of a folder, or those that a glob names. Each run takes
the ones that no earlier run took and recomputes only the months and the
calendar windows from the first changed month on. Under the output folder:

- ``sums/month=/batch_id=``: traded value and quantity by period and asset, as they came
- ``log/batch_id=``: one line a batch
- ``panel/month=``: close and volume by period and asset
- ``moments/month=``: co-moments of the returns of each pair of assets
- ``correlations/window_start=``: the result
- ``mark``: the last batch whose rows are in all of these

Months and windows are replaced whole, so a run that is lost halfway is made
good by the next one: the mark still names the batch before.
"""

from __future__ import annotations

import argparse
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemesh.operators import calendar, cleaning, correlation
from tidemesh.streaming.ingest import BATCH, ingest_files, overwrite_partitions, read_table

logger = logging.getLogger("rolling_correlations")

SUMS = f"obs_date date, asset string, value double, quantity double, trades long, month date, {BATCH} long"
PANEL = "obs_date date, asset string, close double, volume double, month date"
MOMENTS = "asset_1 string, asset_2 string, n long, mean_1 double, mean_2 double, m2_1 double, m2_2 double, co double, month date"
RESULT = "window_id int, window_end date, asset_1 string, asset_2 string, observations long, rho double, distance double, window_start date"


def sums_of(trades: DataFrame, assets: DataFrame, asset_column: str, frequency: str) -> DataFrame:
    """Value, quantity and number of trades by period and asset: sums, so batches add up. Trades without a known asset or date are left out."""
    named = assets.select("p_partkey", F.col(asset_column).alias("asset")).filter("asset is not null")
    rows = trades.join(named, F.col("l_partkey") == F.col("p_partkey")).filter("l_shipdate is not null")
    sums = rows.groupBy(F.date_trunc(frequency, "l_shipdate").cast("date").alias("obs_date"), "asset").agg(
        F.sum("l_extendedprice").alias("value"), F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("trades")
    )
    return sums.withColumn("month", F.trunc("obs_date", "MM"))


def _first_changed(sums: DataFrame, mark: int):
    return sums.filter(F.col(BATCH) > mark).agg(F.min("month")).first()[0]


def update(spark: SparkSession, output: str, months: int, frequency: str) -> int:
    """Bring panel, moments and correlations up to the batches that ``sums`` holds; the number of windows that were written."""
    sums = read_table(spark, f"{output}/sums", SUMS)
    mark = read_table(spark, f"{output}/mark", f"{BATCH} long").agg(F.max(BATCH)).first()[0]
    last = sums.agg(F.max(BATCH)).first()[0]
    first = _first_changed(sums, -1 if mark is None else mark)
    if first is None:
        logger.info("nothing new since batch %s", mark)
        return 0
    logger.info("batches after %s up to %s change the months from %s on", mark, last, first)

    changed = F.col("month") >= F.lit(first)
    rows = sums.filter(changed).groupBy("month", "obs_date", "asset").agg((F.sum("value") / F.sum("quantity")).alias("close"), F.sum("value").alias("volume"))
    overwrite_partitions(rows.repartition("month"), f"{output}/panel", "month")

    # The first return of a changed month follows from the asset's last close before it.
    panel = read_table(spark, f"{output}/panel", PANEL)
    before = panel.filter(~changed).groupBy("asset").agg(F.max("obs_date").alias("obs_date"), F.max_by("close", "obs_date").alias("close"))
    span = panel.filter(changed).select("obs_date", "asset", "close").unionByName(before.select("obs_date", "asset", "close"))
    returns = cleaning.log_returns(span, price="close", asset="asset", zero_missing=False).filter(F.col("obs_date") >= F.lit(first))
    overwrite_partitions(correlation.month_moments(returns).repartition("month"), f"{output}/moments", "month")

    windows = calendar.month_windows(panel.select("obs_date"), months).filter(F.col("window_end") >= F.lit(first))
    moments = read_table(spark, f"{output}/moments", MOMENTS).filter(F.col("month") >= F.add_months(F.lit(first), 1 - months))
    pairs = correlation.distances(correlation.merge_moments(moments, windows, months))
    result = pairs.join(F.broadcast(windows), "window_id")
    overwrite_partitions(result.repartition("window_start"), f"{output}/correlations", "window_start")
    written = windows.count()
    spark.range(1).select(F.lit(last).cast("long").alias(BATCH)).coalesce(1).write.mode("overwrite").parquet(f"{output}/mark")
    logger.info("wrote %d windows; the mark is batch %s", written, last)
    return written


def run(spark: SparkSession, trades: str, assets: str, output: str, checkpoint: str, asset_column: str = "p_brand", frequency: str = "week", months: int = 12, files_per_batch: int = 1000) -> DataFrame:
    """Take new trades, update what they change, and return the whole table of correlations.

    Reruns without new files change nothing. Trades may come late: their month
    and all behind it are computed anew. A period belongs to the month in
    which it begins.
    """
    names = spark.read.parquet(assets)
    batches = ingest_files(
        spark, trades, checkpoint, f"{output}/sums", f"{output}/log", lambda b: sums_of(b, names, asset_column, frequency), "month", "l_shipdate", files_per_batch=files_per_batch
    )
    for r in read_table(spark, f"{output}/log", f"rows long, first_day date, last_day date, {BATCH} long").orderBy(F.desc(BATCH)).limit(batches).collect():
        logger.info("read batch %d: %d trades from %s to %s", r[BATCH], r["rows"], r["first_day"], r["last_day"])
    update(spark, output, months, frequency)
    return read_table(spark, f"{output}/correlations", RESULT)


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("trades", "assets", "output", "checkpoint"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config", default=str(Path(__file__).with_suffix(".json")))
    args = parser.parse_args()
    spark = SparkSession.builder.appName("rolling correlations").getOrCreate()
    try:
        config = spark.read.option("multiLine", True).json(args.config).first().asDict()
        logging.basicConfig(level=config.pop("log_level", "INFO"), format="%(asctime)s %(name)s %(message)s")
        result = run(spark, args.trades, args.assets, args.output, args.checkpoint, **config)
        logger.info("the table has %d rows", result.count())
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
