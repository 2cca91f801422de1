"""Moments, quantiles, size-adjusted residuals, ECDF and density estimates."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .correlation import pearson


def sample_skewness(x: str) -> Column:
    """Bias-corrected skewness G1; null for fewer than 3 values or without variance."""
    n = F.count(x).cast("double")
    return F.when((n >= 3) & (F.var_pop(x) > 0), F.skewness(x) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def sample_kurtosis(x: str) -> Column:
    """Bias-corrected excess kurtosis G2; null for fewer than 4 values or without variance."""
    n = F.count(x).cast("double")
    down = F.nullif((n - 2) * (n - 3), F.lit(0.0))
    return F.when((n >= 4) & (F.var_pop(x) > 0), ((n + 1) * F.kurtosis(x) + 6) * (n - 1) / down)


def moments(x: str, prefix: str) -> list[Column]:
    return [
        F.avg(x).alias(f"{prefix}_mean"),
        F.var_samp(x).alias(f"{prefix}_var"),
        F.stddev_samp(x).alias(f"{prefix}_std"),
        sample_skewness(x).alias(f"{prefix}_skew"),
        sample_kurtosis(x).alias(f"{prefix}_kurt"),
    ]


def spread(x: str, prefix: str) -> list[Column]:
    """The 10, 50 and 90 percent quantiles, interquartile range and extremes."""
    q = {p: F.percentile(x, F.lit(p / 100)) for p in (10, 25, 50, 75, 90)}
    return [q[10].alias(f"{prefix}_q10"), q[50].alias(f"{prefix}_q50"), q[90].alias(f"{prefix}_q90"), (q[75] - q[25]).alias(f"{prefix}_iqr"), F.min(x).alias(f"{prefix}_min"), F.max(x).alias(f"{prefix}_max")]


def distance_statistics(df: DataFrame, keys: list[str], x: str = "distance", bins: int = 20) -> DataFrame:
    """Per group: moments (population), quartiles, biased skewness and excess kurtosis, histogram entropy in bits, variation."""
    stats = df.groupBy(*keys).agg(
        F.avg(x).alias("mean"), F.percentile(x, F.lit(0.5)).alias("median"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.percentile(x, F.lit(0.25)).alias("q25"), F.percentile(x, F.lit(0.75)).alias("q75"), F.skewness(x).alias("skewness"), F.kurtosis(x).alias("kurtosis"),
    )
    span = stats.select(*keys, "min", "max")
    width = F.nullif((F.col("max") - F.col("min")) / bins, F.lit(0.0))
    bin_ = F.least(F.coalesce(F.floor((F.col(x) - F.col("min")) / width), F.lit(0)), F.lit(bins - 1))
    counts = df.join(span, keys).groupBy(*keys, bin_.alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))
    share = F.col("_n") / F.sum("_n").over(Window.partitionBy(*keys))
    entropy = counts.withColumn("_p", share).groupBy(*keys).agg((-F.sum(F.col("_p") * F.log2("_p"))).alias("entropy"))
    out = stats.join(entropy, keys).withColumn("iqr", F.col("q75") - F.col("q25"))
    return out.withColumn("cv", F.try_divide(F.col("std"), F.col("mean")))


def histogram(df: DataFrame, keys: list[str], x: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Counts of equal bins on [lo, hi], the last one closed."""
    k = F.least(F.floor((F.col(x) - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("int")
    return df.filter(F.col(x).between(lo, hi)).groupBy(*keys, k.alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def selected_quantiles(df: DataFrame, keys: list[str], x: str, probabilities: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 0.9), bins: int = 512, checkpoint: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Exact quantiles per group, by selection in bounded memory: keys, q10, q25, ... and values, the number of values.

    An order statistic is bracketed by its group's least and largest value.
    Each round counts the rows between the brackets by ``bins`` even steps,
    keeps the step that holds the rank, and takes that step's least and
    largest value as the new bracket, until both are equal. No buffer or group
    holds more than a count a step, however many values a group has or however
    they are spread; two to three rounds suffice for usual data, as each
    divides the bracket by ``bins``. Only a count of open brackets reaches the
    driver. Between neighbouring ranks the quantile is interpolated. Values
    that are null, NaN or infinite are left out; a group without others is
    absent, and so is one whose key is null. ``checkpoint`` cuts the lineage of the brackets, a row a group and
    rank.
    """
    held = checkpoint or (lambda d: d)
    rows = df.select(*keys, F.col(x).cast("double").alias("_v")).filter("_v is not null and not isnan(_v) and abs(_v) < double('infinity')")
    per = held(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("values"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
    place = {p: (F.col("values") - 1) * F.lit(float(p)) for p in probabilities}
    ranks = F.array_distinct(F.array(*[f(at).cast("long") for at in place.values() for f in (F.floor, F.ceil)]))
    open_ = held(per.select(*keys, F.explode(ranks).alias("_rank"), F.lit(0).cast("long").alias("_before"), "_lo", "_hi"))
    found = open_.filter("_lo = _hi").select(*keys, "_rank", F.col("_lo").alias("_value"))
    open_ = open_.filter("_lo < _hi")
    order = Window.partitionBy(*keys, "_rank").orderBy("_bin")
    while open_.limit(1).count():
        span = F.col("_hi") - F.col("_lo")
        share = F.when(span < F.lit(float("inf")), (F.col("_v") - F.col("_lo")) / span).otherwise((F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2))
        within = rows.join(open_, keys).filter(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        steps = within.groupBy(*keys, "_rank", "_before", F.least(F.floor(share * bins), F.lit(bins - 1)).alias("_bin")).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        upto = F.col("_before") + F.sum("_n").over(order)
        chosen = steps.withColumn("_upto", upto).filter((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_n")))
        now = held(chosen.select(*keys, "_rank", (F.col("_upto") - F.col("_n")).alias("_before"), "_lo", "_hi"))
        found = found.unionByName(now.filter("_lo = _hi").select(*keys, "_rank", F.col("_lo").alias("_value")))
        open_ = now.filter("_lo < _hi")
    values = per.join(found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_value"))).alias("_at")), keys)

    def quantile(at: Column) -> Column:
        low = F.element_at("_at", F.floor(at).cast("long"))
        return low + (at - F.floor(at)) * (F.element_at("_at", F.ceil(at).cast("long")) - low)

    return values.select(*keys, "values", *[quantile(at).alias(f"q{100 * p:02.0f}") for p, at in place.items()])


def size_adjusted(df: DataFrame, value: str, size: str = "n_nodes") -> DataFrame:
    """Adds expected (a regression of ``value`` on ln(1 + size) over all rows), residual, and z of the residual."""
    x = F.ln(1 + F.col(size))
    whole = Window.partitionBy()
    known = df.filter(F.col(value).isNotNull()).withColumn("_x", x)
    fit = known.agg(F.regr_slope(value, "_x").alias("_b"), F.regr_intercept(value, "_x").alias("_a"), F.avg(value).alias("_m"))
    out = known.crossJoin(F.broadcast(fit)).withColumn("expected", F.coalesce(F.col("_a") + F.col("_b") * F.col("_x"), F.col("_m")))
    out = out.withColumn("residual", F.col(value) - F.col("expected"))
    return out.withColumn("zscore", F.try_divide(F.col("residual"), F.stddev_samp("residual").over(whole))).drop("_x", "_a", "_b", "_m")


def planar_degree_residual(df: DataFrame, value: str = "mean_degree", size: str = "n_nodes") -> DataFrame:
    """A maximal planar graph's mean degree is 6 - 12 / n: adds expected and residual."""
    return df.withColumn("expected", 6 - 12.0 / F.col(size)).withColumn("residual", F.col(value) - F.col("expected"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Spearman's rank correlation over all rows, ties by their mean rank: one row, rho."""

    def mean_rank(c: str) -> Column:
        return F.rank().over(Window.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(c)) - 1) / 2

    known = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    return known.select(mean_rank(x).alias("_x"), mean_rank(y).alias("_y")).agg(pearson("_x", "_y").alias("rho"))


def ecdf(df: DataFrame, keys: list[str], x: str, lo: float, hi: float, points: int = 100) -> DataFrame:
    """Per group the share of values at or below each of ``points`` grid values.

    A value counts at the first grid point that it doesn't exceed, found by
    arithmetic and put right against the grid; the shares are running sums
    over one row per group and point. Unknown values count for no point.
    """
    step = (hi - lo) / (points - 1)
    grid = lambda k: F.lit(lo) + k * step
    near = F.ceil((F.col(x) - lo) / step).cast("bigint")
    # Rounding may put the guess one off.
    first = F.when(F.col(x) <= grid(near - 1), near - 1).when(F.col(x) <= grid(near), near).otherwise(near + 1)
    place = F.when(F.col(x) <= lo, F.lit(0).cast("bigint")).otherwise(F.least(F.greatest(first, F.lit(0)), F.lit(points)))
    counts = df.groupBy(*keys, place.alias("_at")).agg(F.count(x).alias("_n"))
    per = counts.groupBy(*keys).agg(F.collect_list(F.struct("_at", "_n")).alias("_c"), F.sum("_n").alias("_all"))
    below = lambda k: F.aggregate("_c", F.lit(0).cast("bigint"), lambda n, c: n + F.when(c["_at"] <= k, c["_n"]).otherwise(F.lit(0)))
    each = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(points - 1).cast("bigint")), lambda k: F.struct((k + 1).cast("int").alias("point"), grid(k).alias("grid"), F.try_divide(below(k).cast("double"), F.col("_all")).alias("ecdf")))
    return per.select(*keys, F.explode(each).alias("_p")).select(*keys, "_p.*")


def kernel_density(df: DataFrame, keys: list[str], x: str, factor: float = 1.6, points: int = 320) -> DataFrame:
    """Gaussian density per group on ``points`` values from 0 to min(2, max(largest value, 1.8)); bandwidth is Scott's times ``factor``.

    The grid is generated within a value's row and summed up before the
    shuffle, so one row per group and point leaves each task.
    """
    group = df.groupBy(*keys).agg(F.count(x).alias("_n"), (F.stddev_samp(x) * F.pow(F.count(x).cast("double"), -0.2) * factor).alias("_h"))
    top = df.agg(F.least(F.lit(2.0), F.greatest(F.max(x), F.lit(1.8))).alias("_top"))
    group = group.filter("_h > 0").crossJoin(F.broadcast(top))
    rows = df.select(*keys, F.col(x).alias("_x")).filter("_x is not null").join(group, keys).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    grid = F.col("_k") * F.col("_top") / (points - 1)
    z = (grid - F.col("_x")) / F.col("_h")
    out = rows.groupBy(*keys, "_k").agg(F.sum(F.exp(-z * z / 2)).alias("_s"), F.max("_n").alias("_n"), F.max("_h").alias("_h"), F.max("_top").alias("_top"))
    return out.select(*keys, (F.col("_k") + 1).alias("point"), grid.alias("grid"), (F.col("_s") / (F.col("_n") * F.col("_h") * math.sqrt(2 * math.pi))).alias("density"))


def smooth(df: DataFrame, keys: list[str], x: str, order: str, sigma: float = 1.2, truncate: float = 4.0) -> DataFrame:
    """A Gaussian filter along ``order``, edges reflected: adds smoothed."""
    radius = int(truncate * sigma + 0.5)
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    total = sum(weights)
    arr = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, x))).alias("_s"))
    n = F.size("_s")

    def at(i: Column) -> Column:
        j = F.pmod(i, 2 * n)
        return F.element_at("_s", (F.when(j < n, j).otherwise(2 * n - 1 - j) + 1).cast("int"))[x]

    def value(k: Column) -> Column:
        out = F.lit(0.0)
        for d, w in zip(range(-radius, radius + 1), weights, strict=True):
            out = out + at(k + d) * (w / total)
        return out

    rows = arr.select(*keys, F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(F.element_at("_s", k + 1)[order].alias(order), value(k).alias("smoothed")))).alias("_r"))
    return df.join(rows.select(*keys, f"_r.{order}", "_r.smoothed"), [*keys, order])


def network_workload(pairs: DataFrame, level: float = 0.05, moderate: int = 2_000, heavy: int = 10_000) -> DataFrame:
    """Of the significant pairs: windows, mean and most edges, most nodes, largest nodes * edges, and advice."""
    sig = pairs.filter(F.col("pvalue") < level)
    nodes = sig.select("window_id", F.explode(F.array("asset_1", "asset_2")).alias("a")).groupBy("window_id").agg(F.countDistinct("a").alias("nodes"))
    per = sig.groupBy("window_id").agg(F.count(F.lit(1)).alias("edges")).join(nodes, "window_id")
    out = per.agg(F.count(F.lit(1)).alias("windows"), F.avg("edges").alias("mean_edges"), F.max("edges").alias("max_edges"), F.max("nodes").alias("max_nodes"), F.max(F.col("edges") * F.col("nodes")).alias("max_cost"))
    return out.withColumn("advice", F.when(F.col("max_edges") > heavy, "skip").when(F.col("max_edges") > moderate, "sample").otherwise("full"))


def validation_summary(ks: DataFrame, adf: DataFrame, cross: DataFrame) -> DataFrame:
    """One row of means over the three validation tables."""
    a = ks.agg(F.avg("ks_stat").alias("ks_mean"), F.avg((F.col("ks_pvalue") < 0.05).cast("double")).alias("ks_reject_share"))
    b = adf.agg(F.avg("adf_stat").alias("adf_mean"), F.avg(F.col("adf_stationary").cast("double")).alias("adf_stationary_share"))
    c = cross.filter("method = 'ward'").agg(F.avg("best_k").alias("ward_k_mean"), F.avg("silhouette").alias("ward_silhouette_mean"), F.avg("modularity").alias("ward_modularity_mean"))
    return a.crossJoin(b).crossJoin(c)


def latex_table(df: DataFrame, columns: list[str], order: list[str], caption: str, label: str) -> DataFrame:
    """The rows of ``df``, few by nature, as one LaTeX table: null is --, numbers have 4 decimals."""
    from ..functions.scalars import latex_escape

    def cell(c: str) -> Column:
        kind = dict(df.dtypes)[c]
        text = F.when(F.col(c).isNotNull(), F.format_string("%.4f", F.col(c))) if kind in ("double", "float") else latex_escape(F.col(c).cast("string"))
        return F.coalesce(text, F.lit("--"))

    row = F.concat(F.concat_ws(" & ", *[cell(c) for c in columns]), F.lit(r" \\"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, row.alias("_line")))), lambda x: x["_line"]), "\n")
    head = "\\begin{table}[htbp]\n\\centering\n\\caption{" + caption + "}\n\\label{" + label + "}\n\\begin{tabular}{" + "l" * len(columns) + "}\n\\hline\n" + " & ".join(c.replace("_", "\\_") for c in columns) + " \\\\\n\\hline\n"
    return df.agg(F.concat(F.lit(head), body, F.lit("\n\\hline\n\\end{tabular}\n\\end{table}\n")).alias("latex"))
