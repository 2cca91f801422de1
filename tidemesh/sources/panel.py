"""Adapters: the star-schema tables as panels of dated observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Weeks are numbered from this Monday.
FIRST_WEEK = "1995-01-02"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel(spark: SparkSession, sf_dir: str, asset: str = "p_brand", freq: str = "week") -> DataFrame:
    """(obs_date, asset, close, volume): one row per period and asset that traded."""
    lines = read(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice", "l_quantity")
    parts = read(spark, sf_dir, "part").select("p_partkey", F.col(asset).alias("asset"))
    return (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.date_trunc(freq, "l_shipdate").cast("date").alias("obs_date"), "asset")
        .agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"), F.sum("l_extendedprice").alias("volume"))
    )


def dates(spark: SparkSession, sf_dir: str, freq: str = "week") -> DataFrame:
    """(obs_date) of every row that a panel aggregates: enough for its first and last day, and nothing else is read."""
    lines = read(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate")
    parts = read(spark, sf_dir, "part").select("p_partkey")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left_semi").select(F.date_trunc(freq, "l_shipdate").cast("date").alias("obs_date"))


def raw_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(obs_date, ticker, company, price, volume): one row per line item, several to a week and ticker.

    A ticker is a four-letter company code and a share-class suffix.
    """
    lines = read(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice", "l_quantity")
    brand = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int")
    code = F.concat(F.lit("BR"), F.char(F.lit(65) + F.floor(brand / 5)), F.char(F.lit(65) + brand % 5))
    suffix = F.element_at(F.array(F.lit("3"), F.lit("4"), F.lit("11")), F.col("p_size") % 3 + 1)
    parts = read(spark, sf_dir, "part").select("p_partkey", code.alias("company"), suffix.alias("suffix"))
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.date_trunc("week", "l_shipdate").cast("date").alias("obs_date"),
        F.concat("company", "suffix").alias("ticker"),
        "company",
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_extendedprice").alias("volume"),
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(obs_date, ticker, company, open, high, low, close, volume) by week, with gaps put in.

    Closes are on a coarse grid, so some don't change; every 17th week the
    class "4" tickers have no close, and every 23rd week nothing has volume.
    """
    week = F.floor(F.datediff("obs_date", F.lit(FIRST_WEEK)) / 7)
    rows = raw_quotes(spark, sf_dir).groupBy("obs_date", "ticker", "company").agg(
        F.avg("price").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), (F.floor(F.max("price") / 200) * 200).cast("double").alias("close"), F.sum("volume").alias("volume")
    )
    gap = (F.pmod(week, F.lit(17)) == 3) & F.col("ticker").endswith("4")
    return rows.withColumn("close", F.when(~gap, F.col("close"))).withColumn("volume", F.when(F.pmod(week, F.lit(23)) == 5, 0.0).otherwise(F.col("volume")))


#: The same as DuckDB common table expressions.
PANEL_SQL = """
panel AS (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS obs_date, p_brand AS asset,
                 sum(l_extendedprice) / sum(l_quantity) AS close, sum(l_extendedprice) AS volume
          FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
RAW_SQL = """
raw AS (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS obs_date, c || ['3', '4', '11'][p_size % 3 + 1] AS ticker, c AS company,
               l_extendedprice / l_quantity AS price, l_extendedprice AS volume
        FROM lineitem JOIN (SELECT *, 'BR' || chr(CAST(65 + b // 5 AS INT)) || chr(CAST(65 + b % 5 AS INT)) AS c
                            FROM (SELECT *, CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INT) AS b FROM part)) ON l_partkey = p_partkey)"""
QUOTES_SQL = RAW_SQL + """,
quotes AS (SELECT obs_date, ticker, company, open, high, low,
                  CASE WHEN NOT (w % 17 = 3 AND ticker LIKE '%4') THEN close END AS close,
                  CASE WHEN w % 23 = 5 THEN 0.0 ELSE volume END AS volume
           FROM (SELECT obs_date, ticker, company, avg(price) AS open, max(price) AS high, min(price) AS low,
                        CAST(floor(max(price) / 200) * 200 AS DOUBLE) AS close, sum(volume) AS volume, (obs_date - DATE '1995-01-02') // 7 AS w
                 FROM raw GROUP BY obs_date, ticker, company))"""
