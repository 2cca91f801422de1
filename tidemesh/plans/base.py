"""Shared inputs of the registered queries, and the same as DuckDB expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calendar, cleaning, correlation
from ..sources import panel as panels

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name, with SQL where that can express it."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, as engines differ in the last digits; -0 is 0."""
    return df.select(*[(F.round(F.col(c), places) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def returns(spark: SparkSession, sf_dir: str, asset: str = "p_brand") -> DataFrame:
    """The weekly panel with log returns, null for the first week."""
    return cleaning.log_returns(panels.panel(spark, sf_dir, asset), price="close", asset="asset", zero_missing=False)


def windowed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The panel's rows in their windows, and the windows, whose bounds come from the dates alone."""
    windows = calendar.month_windows(panels.dates(spark, sf_dir))
    return calendar.assign_windows(returns(spark, sf_dir), windows), windows


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations and distances of each window: (window_id, asset_1, asset_2, observations, rho, distance)."""
    windows = calendar.month_windows(panels.dates(spark, sf_dir))
    return correlation.distances(correlation.merge_moments(correlation.month_moments(returns(spark, sf_dir)), windows))


WINDOWS = """
windows AS (SELECT CAST(row_number() OVER (ORDER BY s) AS INT) AS window_id, s AS window_start, CAST(last_day(s + INTERVAL 11 MONTH) AS DATE) AS window_end
            FROM (SELECT CAST(unnest(generate_series(date_trunc('month', min(obs_date)), max(obs_date), INTERVAL 1 MONTH)) AS DATE) AS s, max(obs_date) AS hi FROM panel)
            WHERE last_day(s + INTERVAL 11 MONTH) <= hi)"""
RETURNS = panels.PANEL_SQL + """,
ret AS (SELECT *, CASE WHEN close > 0 AND p > 0 THEN ln(close / p) END AS log_return
        FROM (SELECT *, lag(close) OVER (PARTITION BY asset ORDER BY obs_date) AS p FROM panel))"""
WINDOWED = RETURNS + "," + WINDOWS + """,
win AS (SELECT ret.*, window_id, window_start, window_end FROM ret JOIN windows ON obs_date BETWEEN window_start AND window_end)"""
PAIRS = WINDOWED + """,
pairs AS (SELECT *, sqrt(greatest(2 * (1 - rho), 0)) AS distance FROM (
  SELECT a.window_id, a.asset AS asset_1, b.asset AS asset_2, count(*) AS observations, round(covar_pop(a.log_return, b.log_return) / nullif(stddev_pop(a.log_return) * stddev_pop(b.log_return), 0), 12) AS rho
  FROM win a JOIN win b ON a.window_id = b.window_id AND a.obs_date = b.obs_date AND a.asset < b.asset
  WHERE a.log_return IS NOT NULL AND b.log_return IS NOT NULL GROUP BY 1, 2, 3) WHERE rho IS NOT NULL AND sqrt(greatest(2 * (1 - rho), 0)) > 0)"""
#: The graph of each node's 5 nearest, as used by the graph metrics.
KNN = PAIRS + """,
mir AS (SELECT window_id, asset_1 AS node, asset_2 AS other, distance FROM pairs UNION ALL SELECT window_id, asset_2, asset_1, distance FROM pairs),
edges AS (SELECT DISTINCT window_id, least(node, other) AS u, greatest(node, other) AS v, distance, distance AS weight
          FROM (SELECT *, row_number() OVER (PARTITION BY window_id, node ORDER BY round(distance, 9), other) AS rn FROM mir) WHERE rn <= 5),
me AS (SELECT window_id, u AS node, v AS other, distance, weight FROM edges UNION ALL SELECT window_id, v, u, distance, weight FROM edges),
deg AS (SELECT window_id, node, count(*) AS degree FROM me GROUP BY 1, 2)"""
