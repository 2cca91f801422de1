"""Filters, assemblies and lookups that the pipelines share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DATE_NAMES = ("date", "data")


def standard_date(df: DataFrame, name: str = "obs_date") -> DataFrame:
    """The date column, whatever the case of its name, under a standard name and as a date; an error if there is none."""
    found = [c for c in df.columns if c.lower() in DATE_NAMES]
    if not found:
        raise ValueError(f"no date column among {df.columns}")
    return df.withColumnRenamed(found[0], name).withColumn(name, F.col(name).cast("date"))


def until(df: DataFrame, end: str, date_col: str = "obs_date") -> DataFrame:
    return df.filter(F.col(date_col) <= F.lit(end).cast("date"))


def members(df: DataFrame, key: str, allowed: Sequence | DataFrame) -> DataFrame:
    """Rows whose key is in a list, or in a table's only column."""
    if isinstance(allowed, DataFrame):
        return df.join(allowed.toDF(key).distinct(), key, "left_semi")
    return df.filter(F.col(key).isin(list(allowed)))


def membership_report(wanted: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """Each wanted key and whether ``df`` has it."""
    have = df.select(key).distinct().withColumn("found", F.lit(True))
    return wanted.select(key).distinct().join(have, key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def non_empty(df: DataFrame, key: str) -> DataFrame:
    return df.filter(F.coalesce(F.trim(key), F.lit("")) != "")


def known_numbers(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Rows with all keys and finite values; NaN counts as missing."""
    ok = F.lit(True)
    for k in keys:
        ok = ok & F.col(k).isNotNull()
    for v in values:
        ok = ok & F.col(v).isNotNull() & ~F.isnan(F.col(v).cast("double"))
    return df.filter(ok)


def one_window(df: DataFrame, window: int) -> DataFrame:
    return df.filter(F.col("window_id") == window)


def masked_distance(distance: Column) -> Column:
    """Distances above 0 as they are, others 0."""
    return F.when(distance > 0, distance).otherwise(0.0)


def metric_columns(df: DataFrame, parts: Sequence[str]) -> list[str]:
    """Columns whose name holds one of the parts."""
    return [c for c in df.columns if any(p in c for p in parts)]


def assemble(base: DataFrame, tables: Sequence[DataFrame], key: str = "window_id") -> DataFrame:
    """Left joins one after the other; a table that repeats a key is an error when the plan runs, not a blow-up.

    The check is part of the join's input: one aggregation by the join's key,
    which leaves the table partitioned for it, so nothing is computed twice.
    """
    out = base
    for t in tables:
        values = [c for c in t.columns if c != key]
        message = F.lit(f"{key} isn't unique in a table with {', '.join(t.columns)}")
        one = t.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *[F.any_value(F.col(f"`{c}`")).alias(c) for c in values])
        checked = one.filter(F.when(F.col("_n") > 1, F.raise_error(message).cast("boolean")).otherwise(True)).drop("_n")
        out = out.join(checked, key, "left")
    return out


def keep_and_remap(df: DataFrame, choice: DataFrame, keys: Sequence[str], column: str, into: str) -> DataFrame:
    """The rows whose keys ``choice`` has, with ``column`` replaced by its ``into``: an inner join that filters and remaps at once."""
    picked = choice.select(*keys, F.col(into).alias("_into")).distinct()
    return df.join(picked, list(keys)).withColumn(column, F.coalesce("_into", column)).drop("_into")


def replace_columns(df: DataFrame, new: DataFrame, key: str = "window_id") -> DataFrame:
    """Columns that ``new`` has come from there, the others stay; keys that it lacks get nulls."""
    return df.drop(*[c for c in new.columns if c != key]).join(new, key, "left")


def semi_or_null(df: DataFrame, keep: DataFrame, keys: Sequence[str], null_key: str) -> DataFrame:
    """Rows whose keys are to be kept, and those that have no value of ``null_key``."""
    kept = df.join(keep.select(*keys).distinct(), list(keys), "left_semi")
    return kept.unionByName(df.filter(F.col(null_key).isNull()))


def modeled(universe: DataFrame, stats: DataFrame, columns: Sequence[str], key: str = "window_id", least: int = 2) -> DataFrame:
    """The universe with statistics, 0 where there are none; modeled if the first of them reaches ``least``, with the reason if not."""
    out = universe.join(stats, key, "left").fillna(0, list(columns))
    enough = F.col(columns[0]) >= least
    return out.withColumn("modeled", enough.cast("int")).withColumn("model_reason", F.when(enough, "ok").when(F.col(columns[0]) == 0, "no data").otherwise("too few"))


def pivot_means(long: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Metrics (keys, metric, value) to one column each, in one aggregation."""
    return long.groupBy(*keys).agg(*[F.avg(F.when(F.col("metric") == n, F.col("value"))).alias(n) for n in names])


def mean_numeric(text: Column) -> Column:
    """Mean of what can be read as a number; words and NaN don't count."""
    d = text.try_cast("double")
    return F.avg(F.when(~F.isnan(d), d))


def window_context(rows: DataFrame, dimension: DataFrame, office: DataFrame) -> DataFrame:
    """Distinct (window_id, window_end, ticker) with the ticker's names, its alias count and who held office at the window's end."""
    keys = rows.select("window_id", "window_end", F.upper(F.trim("ticker")).alias("ticker")).filter("ticker <> ''").distinct()
    who = office.select(F.col("ticker").alias("_t"), F.col("day").alias("_d"), F.col("name").alias("in_office"))
    out = keys.join(dimension.withColumn("aliases_count", F.size("aliases")).drop("aliases"), "ticker")
    return out.join(who, (F.col("ticker") == F.col("_t")) & (F.col("window_end") == F.col("_d")), "left").drop("_t", "_d")


def figure_block(path: Column, caption: Column, label: Column) -> Column:
    """A LaTeX figure environment."""
    return F.concat(F.lit("\\begin{figure}[htbp]\n\\centering\n\\includegraphics[width=\\linewidth]{"), path, F.lit("}\n\\caption{"), caption, F.lit("}\n\\label{"), label, F.lit("}\n\\end{figure}\n"))
