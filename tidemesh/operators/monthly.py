"""Sums by calendar month that merge into windows of whole months: a row is aggregated once, not in each of its windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .correlation import DEFAULT_OBSERVATIONS


def asset_months(df: DataFrame, asset: str = "asset", value: str = "log_return", volume: str = "volume", date_col: str = "obs_date") -> DataFrame:
    """(month, asset, rows, n, mean, m2, volume): rows, known values with their mean and squared deviations from it, volume."""
    n = F.count(value)
    return df.groupBy(F.trunc(date_col, "MM").alias("month"), F.col(asset).alias("asset")).agg(
        F.count(F.lit(1)).alias("rows"), n.alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * n).alias("m2"), F.sum(volume).alias("volume")
    )


def day_months(df: DataFrame, date_col: str = "obs_date") -> DataFrame:
    """(month, days): distinct dates, which add up, as a date lies in one month."""
    return df.groupBy(F.trunc(date_col, "MM").alias("month")).agg(F.countDistinct(date_col).alias("days"))


def in_windows(sums: DataFrame, windows: DataFrame, months: int = 12) -> DataFrame:
    """Each month's row once per window that holds the month; the windows are one a month and go by a broadcast."""
    start = F.explode(F.expr(f"sequence(add_months(month, {1 - months}), month, interval 1 month)"))
    return sums.withColumn("window_start", start).join(F.broadcast(windows.select("window_id", "window_start")), "window_start").drop("window_start")


def window_totals(df: DataFrame, windows: DataFrame, months: int = 12, asset: str = "asset") -> DataFrame:
    """(window_id, n, days, volume) of each window that has rows."""
    rows = in_windows(asset_months(df, asset), windows, months).groupBy("window_id").agg(F.sum("rows").alias("n"), F.sum("volume").alias("volume"))
    return rows.join(in_windows(day_months(df), windows, months).groupBy("window_id").agg(F.sum("days").alias("days")), "window_id")


def window_stats(df: DataFrame, windows: DataFrame, months: int = 12, asset: str = "asset") -> DataFrame:
    """Per window: assets, days, mean and sample deviation of the values, and whether it is complete or problematic beside the fullest.

    The deviation's square is (sum of m2 + sum of n (mean - MEAN)^2) / (N - 1);
    it is null for less than two values, the mean for none. Assets are counted
    by name, as one may trade in several months.
    """
    rows = in_windows(asset_months(df, asset), windows, months)
    whole = rows.groupBy("window_id").agg(F.countDistinct("asset").alias("assets"), F.sum("n").alias("_n"), F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n")).alias("mean_return"))
    apart = F.col("n") * F.pow(F.col("mean") - F.col("mean_return"), F.lit(2.0))
    spread = rows.join(whole.select("window_id", "mean_return"), "window_id").groupBy("window_id").agg((F.sum("m2") + F.sum(apart)).alias("_m2"))
    days = in_windows(day_months(df), windows, months).groupBy("window_id").agg(F.sum("days").alias("days"))
    out = whole.join(spread, "window_id").join(days, "window_id")
    out = out.withColumn("volatility", F.sqrt(F.try_divide(F.col("_m2"), F.nullif(F.greatest(F.col("_n") - 1, F.lit(0)).cast("double"), F.lit(0.0)))))
    most = out.agg(F.max("assets").alias("_most"))  # one row
    out = out.crossJoin(F.broadcast(most))
    return out.select("window_id", "assets", "days", "mean_return", "volatility", (F.col("assets") >= 0.9 * F.col("_most")).alias("complete"), (F.col("assets") < 0.5 * F.col("_most")).alias("problematic"))


def window_observations(df: DataFrame, windows: DataFrame, months: int = 12, asset: str = "asset", value: str = "log_return") -> DataFrame:
    """(window_id, n_obs) of every window: the values of its longest series, or the default where it has none."""
    counts = df.groupBy(F.trunc("obs_date", "MM").alias("month"), F.col(asset).alias("asset")).agg(F.count(value).alias("n"))
    most = in_windows(counts, windows, months).groupBy("window_id", "asset").agg(F.sum("n").alias("n")).groupBy("window_id").agg(F.max("n").alias("n"))
    return windows.select("window_id").join(most, "window_id", "left").select("window_id", F.coalesce("n", F.lit(DEFAULT_OBSERVATIONS)).alias("n_obs"))
