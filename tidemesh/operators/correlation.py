"""Rolling pair correlations, their distances and significance."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Returns a window's p-values assume where it has none.
DEFAULT_OBSERVATIONS = 252


def pearson(x: str, y: str) -> Column:
    """Pearson correlation over rows where both are known; null without variance.

    The built-in ``corr`` raises under ANSI mode when a series is constant.
    """
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def pair_correlations(df: DataFrame, keys: list[str], asset: str = "asset", date_col: str = "obs_date", value: str = "log_return") -> DataFrame:
    """Correlation of each pair of assets in each group: keys, asset_1 < asset_2, observations, rho.

    Duplicates of a date are averaged. The self-join is on group and date, so
    its size is dates times pairs; the sums are combined before the shuffle.
    """
    rows = df.groupBy(*keys, date_col, asset).agg(F.avg(value).alias("_v"))
    a = rows.select(*keys, date_col, F.col(asset).alias("asset_1"), F.col("_v").alias("_x"))
    b = rows.select(*keys, date_col, F.col(asset).alias("asset_2"), F.col("_v").alias("_y"))
    pairs = a.join(b, [*keys, date_col]).filter("asset_1 < asset_2")
    both = F.col("_x").isNotNull() & F.col("_y").isNotNull()
    return pairs.groupBy(*keys, "asset_1", "asset_2").agg(F.count(F.when(both, 1)).alias("observations"), pearson("_x", "_y").alias("rho"))


def month_moments(df: DataFrame, asset: str = "asset", date_col: str = "obs_date", value: str = "log_return") -> DataFrame:
    """Co-moments of each pair of assets and calendar month: month, asset_1 < asset_2, n, mean_1, mean_2, m2_1, m2_2, co.

    Duplicates of a date are averaged; a date counts where both values are
    known, and a pair that has rows of a month but no such date has n = 0. The
    self-join is on the date and gets each (date, asset) once, in however many
    windows the month lies. m2 and co are sums of squared and multiplied
    deviations from the month's means, so they merge (``merge_moments``).
    """
    rows = df.groupBy(date_col, asset).agg(F.avg(value).alias("_v"))
    a = rows.select(date_col, F.col(asset).alias("asset_1"), F.col("_v").alias("_x"))
    b = rows.select(date_col, F.col(asset).alias("asset_2"), F.col("_v").alias("_y"))
    both = F.col("_x").isNotNull() & F.col("_y").isNotNull()
    x, y = F.when(both, F.col("_x")), F.when(both, F.col("_y"))
    n = F.count(F.when(both, 1))
    return (
        a.join(b, date_col).filter("asset_1 < asset_2").groupBy(F.trunc(date_col, "MM").alias("month"), "asset_1", "asset_2")
        .agg(n.alias("n"), F.avg(x).alias("mean_1"), F.avg(y).alias("mean_2"), (F.var_pop(x) * n).alias("m2_1"), (F.var_pop(y) * n).alias("m2_2"), (F.covar_pop(x, y) * n).alias("co"))
    )


def merge_moments(moments: DataFrame, windows: DataFrame, months: int = 12) -> DataFrame:
    """Correlation of each pair in each calendar window, from the co-moments of its months: window_id, asset_1, asset_2, observations, rho.

    Moments of parts add up, each with its mean's distance from the whole's:
    M2 = sum m2 + sum n mean^2 - (sum n mean)^2 / N, and alike for the
    co-moment; means are counted from the pair's average, so large ones don't
    cancel. Rows are exchanged once a pair and month, before they are copied
    to their windows: what is dealt by pair needs no other exchange to be
    summed by pair and window.
    """
    pair = ["asset_1", "asset_2"]
    whole = Window.partitionBy(*pair)
    rows = moments.select("month", *pair, "n", "m2_1", "m2_2", "co", *[(F.col(c) - F.avg(c).over(whole)).alias(c) for c in ("mean_1", "mean_2")])
    start = F.explode(F.expr(f"sequence(add_months(month, {1 - months}), month, interval 1 month)"))
    rows = rows.withColumn("window_start", start).join(F.broadcast(windows.select("window_id", "window_start")), "window_start")
    n, x, y = F.col("n"), F.coalesce("mean_1", F.lit(0.0)), F.coalesce("mean_2", F.lit(0.0))
    sums = {"observations": n, "m2_1": "m2_1", "m2_2": "m2_2", "co": "co", "x": n * x, "y": n * y, "xx": n * x * x, "yy": n * y * y, "xy": n * x * y}
    parts = rows.groupBy(*pair, "window_id").agg(*[F.sum(c).alias(k) for k, c in sums.items()])

    def total(own: str, a: str, b: str) -> Column:
        return F.col(own) + F.col(a + b) - F.try_divide(F.col(a) * F.col(b), F.col("observations"))

    first, second = F.greatest(total("m2_1", "x", "x"), F.lit(0.0)), F.greatest(total("m2_2", "y", "y"), F.lit(0.0))
    rho = F.try_divide(total("co", "x", "y"), F.sqrt(first) * F.sqrt(second))
    return parts.select("window_id", *pair, "observations", rho.alias("rho"))


def correlation_stats(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: assets, pairs, and mean, median, population deviation, extremes and quartiles of rho."""
    names = pairs.select(*keys, F.explode(F.array("asset_1", "asset_2")).alias("_a")).groupBy(*keys).agg(F.countDistinct("_a").alias("assets"))
    stats = pairs.groupBy(*keys).agg(
        F.count("rho").alias("pairs"),
        F.avg("rho").alias("rho_mean"),
        F.percentile("rho", F.lit(0.5)).alias("rho_median"),
        F.stddev_pop("rho").alias("rho_std"),
        F.min("rho").alias("rho_min"),
        F.max("rho").alias("rho_max"),
        F.percentile("rho", F.lit(0.25)).alias("rho_q25"),
        F.percentile("rho", F.lit(0.75)).alias("rho_q75"),
    )
    return names.join(stats, keys)


def distance(rho: Column) -> Column:
    """sqrt(2 (1 - rho)), clamped where rho exceeds 1 by rounding."""
    return F.sqrt(F.greatest(2 * (1 - rho), F.lit(0.0)))


def distances(pairs: DataFrame, undefined: str = "drop") -> DataFrame:
    """Adds distance; undefined correlations are dropped or taken as uncorrelated.

    rho is rounded to 12 places first: the order of a sum decides digits
    beyond, and near 1 the root would make 1e-8 of 1e-16, so that a pair's
    place among those of distance 0, which go, would depend on partitioning.
    """
    if undefined not in ("drop", "uncorrelated"):
        raise ValueError("undefined: drop or uncorrelated")
    out = pairs.withColumn("rho", F.round("rho", 12))
    out = out.filter("rho is not null") if undefined == "drop" else out.fillna({"rho": 0.0})
    return out.withColumn("distance", distance(F.col("rho"))).filter("distance > 0")


def student_t_sf2(t: Column, df: Column) -> Column:
    """Two-sided tail of Student's t for whole degrees of freedom, by the finite trigonometric series.

    With a = atan(t / sqrt(n)) the inner probability is, for odd n,
    2/pi (a + sin a (cos a + 2/3 cos^3 a + ...)), and for even n
    sin a (1 + 1/2 cos^2 a + 1*3/(2*4) cos^4 a + ...). The series are summed
    on the JVM by a fold over the number of terms.
    """
    a = F.atan(t / F.sqrt(df))
    cos, sin = F.cos(a), F.sin(a)
    odd = df % 2 == 1
    terms = F.when(odd, (df - 1) / 2).otherwise(df / 2).cast("int")
    first = F.when(odd, cos).otherwise(F.lit(1.0))
    zero = F.struct(first.alias("term"), F.lit(0.0).alias("sum"))

    def step(acc: Column, k: Column) -> Column:
        # Odd: ratios 2k/(2k+1); even: (2k-1)/2k; each with cos^2.
        ratio = F.when(odd, 2.0 * k / (2.0 * k + 1.0)).otherwise((2.0 * k - 1.0) / (2.0 * k))
        return F.struct((acc["term"] * ratio * cos * cos).alias("term"), (acc["sum"] + acc["term"]).alias("sum"))

    total = F.when(terms > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(terms, F.lit(1))), zero, step)["sum"]).otherwise(0.0)
    inner = F.when(odd, (a + sin * total) * (2 / math.pi)).otherwise(sin * total)
    return F.greatest(1 - F.abs(inner), F.lit(0.0))


def with_pvalues(pairs: DataFrame, n: Column) -> DataFrame:
    """Adds pvalue of rho under no correlation, with n observations: df = max(n - 2, 1), 1 - rho^2 at least 1e-12."""
    df = F.greatest(n - 2, F.lit(1))
    t = F.abs("rho") * F.sqrt(df / F.greatest(1 - F.col("rho") * F.col("rho"), F.lit(1e-12)))
    return pairs.withColumn("_t", t).withColumn("_df", df.cast("int")).withColumn("pvalue", student_t_sf2(F.col("_t"), F.col("_df"))).drop("_t", "_df")


def significant(pairs: DataFrame, level: float = 0.05) -> DataFrame:
    return pairs.filter((F.col("pvalue") < level) & (F.col("asset_1") != F.col("asset_2")))


def symmetric(pairs: DataFrame, columns: list[str], diagonal: dict[str, float] | None = None) -> DataFrame:
    """Both orientations of each pair, and on demand the diagonal with fixed values."""
    keep = [c for c in pairs.columns if c not in ("asset_1", "asset_2", *columns)]
    there = pairs.select(*keep, "asset_1", "asset_2", *columns)
    back = pairs.select(*keep, F.col("asset_2").alias("asset_1"), F.col("asset_1").alias("asset_2"), *columns)
    out = there.unionByName(back)
    if diagonal is not None:
        own = out.select(*keep, "asset_1").distinct().withColumn("asset_2", F.col("asset_1"))
        out = out.unionByName(own.select(*keep, "asset_1", "asset_2", *[F.lit(diagonal[c]).alias(c) for c in columns]))
    return out


def lookup_pvalues(edges: DataFrame, pvalues: DataFrame) -> DataFrame:
    """Edges (window_id, u, v, ...) with the p-value of their pair, whichever way round it is stored; null if it isn't."""
    p = pvalues.select("window_id", F.least("asset_1", "asset_2").alias("_a"), F.greatest("asset_1", "asset_2").alias("_b"), "pvalue")
    keyed = edges.withColumn("_a", F.least("u", "v")).withColumn("_b", F.greatest("u", "v"))
    return keyed.join(p, ["window_id", "_a", "_b"], "left").drop("_a", "_b")
