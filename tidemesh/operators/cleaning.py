"""Cleaning a quote panel and electing the universe of each window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Least share of traded days, least mean volume.
COMPLETENESS, VOLUME = 0.80, 1_000_000.0


def mean_of_duplicates(df: DataFrame, keys: list[str], means: list[str], firsts: list[str]) -> DataFrame:
    """One row per key: mean of the numbers, least of the rest (any one of them, made definite)."""
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in means], *[F.min(c).alias(c) for c in firsts])


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row of each key that comes last in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def keep_largest(df: DataFrame, keys: list[str], value: str, tie: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col(value).desc_nulls_last(), F.col(tie))
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def traded_days(df: DataFrame, asset: str = "ticker", date_col: str = "obs_date") -> DataFrame:
    """Adds filled_close and traded.

    A day counts as traded if its close is given, the filled close and the
    volume are above 0, and the close differs from the last one, or is the first.
    """
    order = Window.partitionBy(asset).orderBy(date_col)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    filled = df.withColumn("filled_close", F.last("close", ignorenulls=True).over(upto))
    changed = ~F.col("filled_close").eqNullSafe(F.lag("filled_close").over(order))
    flag = F.col("close").isNotNull() & (F.col("filled_close") > 0) & (F.col("volume") > 0) & changed
    return filled.withColumn("traded", F.coalesce(flag, F.lit(False)))


def log_returns(df: DataFrame, price: str = "filled_close", asset: str = "ticker", date_col: str = "obs_date", zero_missing: bool = True) -> DataFrame:
    """Adds log_return; where a price is missing or not above 0 it is 0, or null if ``zero_missing`` is off."""
    before = F.lag(price).over(Window.partitionBy(asset).orderBy(date_col))
    value = F.when((F.col(price) > 0) & (before > 0), F.ln(F.col(price) / before))
    return df.withColumn("log_return", F.coalesce(value, F.lit(0.0)) if zero_missing else value)


def fill_constant(df: DataFrame, columns: list[str], value: float = 0.0) -> DataFrame:
    return df.fillna(value, columns)


def missing_report(df: DataFrame, asset: str = "ticker", value: str = "close", date_col: str = "obs_date") -> DataFrame:
    """Per asset: rows, valid, missing, share missing in percent, first and last valid date."""
    has = F.col(value).isNotNull()
    return df.groupBy(asset).agg(
        F.count(F.lit(1)).alias("total"),
        F.count(value).alias("valid"),
        (F.count(F.lit(1)) - F.count(value)).alias("missing"),
        (100.0 * (F.count(F.lit(1)) - F.count(value)) / F.count(F.lit(1))).alias("missing_pct"),
        F.min(F.when(has, F.col(date_col))).alias("first_valid"),
        F.max(F.when(has, F.col(date_col))).alias("last_valid"),
    )


def life_completeness(df: DataFrame, asset: str = "ticker", date_col: str = "obs_date") -> DataFrame:
    """Per asset with a traded day: traded days over its life span on the market's own calendar, and mean volume."""
    days = df.filter("traded").select(date_col).distinct().withColumn("_day", F.row_number().over(Window.orderBy(date_col)))
    rows = df.filter("traded").join(days, date_col)
    out = rows.groupBy(asset).agg(F.min("company").alias("company"), F.countDistinct(date_col).alias("traded_days"), (F.max("_day") - F.min("_day") + 1).cast("bigint").alias("life_days"), F.avg("volume").alias("mean_volume"))
    return out.withColumn("completeness", F.col("traded_days") / F.col("life_days"))


def eligible(stats: DataFrame, completeness: float = COMPLETENESS, volume: float = VOLUME) -> DataFrame:
    return stats.filter((F.col("completeness") >= completeness) & (F.col("mean_volume") >= volume))


def class_of_ticker(ticker: str, other: str = "OUTRO") -> Column:
    t = F.col(ticker)
    return F.when(t.endswith("11"), "UNIT").when(t.endswith("4"), "PN").when(t.endswith("3"), "ON").otherwise(other)


def class_of_suffix(ticker: str) -> Column:
    n = F.regexp_extract(ticker, r"(\d+)$", 1)
    return F.when(n == "11", "UNIT").when(n.isin("4", "6", "8"), "PN").when(n.isin("3", "5", "7"), "ON").otherwise("OUTRO")


def class_of_text(text: str) -> Column:
    """Share class from a free-text field."""
    t = F.upper(text)
    return F.when(t.rlike("UNIT|UNT"), "UNIT").when(t.rlike(r"\bPN[A-Z]*\b"), "PN").when(t.rlike(r"\bON\b"), "ON").otherwise("")


def class_order(kind: Column) -> Column:
    return F.when(kind == "PN", 0).when(kind == "ON", 1).when(kind == "UNIT", 2).otherwise(3)


def company_of_ticker(ticker: str) -> Column:
    return F.regexp_replace(ticker, "[^A-Za-z]", "")


def one_per_company(stats: DataFrame, value: str = "mean_volume") -> DataFrame:
    """The security that stands for each company: best class, then most of ``value``, then name."""
    w = Window.partitionBy("company").orderBy(class_order(class_of_ticker("ticker")), F.col(value).desc(), "ticker")
    return stats.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def window_completeness(df: DataFrame, keys: list[str], date_col: str = "obs_date", clip: bool = False) -> DataFrame:
    """Per window and key: distinct traded days over those of the whole window."""
    traded = df.filter("traded")
    total = traded.groupBy("window_id").agg(F.countDistinct(date_col).alias("window_days"))
    out = traded.groupBy("window_id", *keys).agg(F.countDistinct(date_col).alias("days")).join(total, "window_id", "left")
    ratio = F.col("days") / F.col("window_days")
    return out.withColumn("ratio", F.least(ratio, F.lit(1.0)) if clip else ratio)


def choose_class(coverage: DataFrame, completeness: float = COMPLETENESS) -> DataFrame:
    """Of each window and company the class to use, of those complete enough: best class, then most days."""
    w = Window.partitionBy("window_id", "company").orderBy(class_order(F.col("kind")), F.col("days").desc(), "kind")
    return coverage.filter(F.col("ratio") >= completeness).withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def canonical_ticker(df: DataFrame, keys: list[str], date_col: str = "obs_date") -> DataFrame:
    """The ticker that stands for each key over all time: best class, then most traded days, then name."""
    days = df.filter("traded").groupBy(*keys, "ticker").agg(F.countDistinct(date_col).alias("days"))
    w = Window.partitionBy(*keys).orderBy(class_order(class_of_suffix("ticker")), F.col("days").desc(), "ticker")
    return days.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").select(*keys, F.col("ticker").alias("canonical"), "days")


def unify_aliases(canonical: DataFrame) -> DataFrame:
    """Companies that share a canonical ticker become the one with most days: company, unified."""
    best = canonical.groupBy("canonical").agg(F.max_by("company", F.struct("days", "company")).alias("unified"), F.count(F.lit(1)).alias("aliases"))
    return canonical.join(best, "canonical").select("company", "canonical", "unified", "aliases")


def monthly_coverage(df: DataFrame, calendar: DataFrame, date_col: str = "obs_date") -> DataFrame:
    """Per month of the calendar: expected, present and missing days, coverage in percent."""
    days = df.select(F.col(date_col).alias("day")).distinct().withColumn("_has", F.lit(1))
    out = calendar.join(days, "day", "left").groupBy(F.date_format("day", "yyyy-MM").alias("year_month")).agg(F.count(F.lit(1)).alias("expected_days"), F.count("_has").alias("present_days"))
    return out.withColumn("missing_days", F.col("expected_days") - F.col("present_days")).withColumn("coverage_pct", 100.0 * F.col("present_days") / F.col("expected_days"))


def whitelist(bases: DataFrame, suffixes: tuple[int, ...] = (3, 4, 5, 6, 7, 8, 11)) -> DataFrame:
    """Tickers allowed: four-letter base codes with every share suffix."""
    codes = bases.filter(F.col("base").rlike("^[A-Z]{4}$")).select("base").distinct()
    return codes.select(F.explode(F.array(*[F.concat("base", F.lit(str(s))) for s in suffixes])).alias("ticker"))


def outside(df: DataFrame, allowed: DataFrame, key: str = "ticker") -> DataFrame:
    """Keys of ``df`` that ``allowed`` lacks."""
    return df.select(key).distinct().join(allowed.select(key), key, "left_anti")


def append_batch(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows and a later batch; of a key that both have, the batch's row."""
    both = existing.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    return keep_last(both, keys, [F.col("_batch")]).drop("_batch")


def every_nth(windows: DataFrame, n: int) -> DataFrame:
    """First, last and every n-th window."""
    w = Window.orderBy("window_id")
    k = windows.withColumn("_k", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy()))
    return k.filter((F.col("_k") % n == 0) | (F.col("_k") == F.col("_n") - 1)).drop("_k", "_n")


def densify(df: DataFrame, calendar: DataFrame, asset: str = "ticker", date_col: str = "obs_date") -> DataFrame:
    """A row for each calendar day and asset, null where nothing was observed."""
    grid = df.select(asset).distinct().crossJoin(calendar.select(F.col("day").alias(date_col)))
    return grid.join(df, [asset, date_col], "left")


def consolidate(windowed: DataFrame, completeness: float = COMPLETENESS, date_col: str = "obs_date") -> DataFrame:
    """The universe of each window: one class per company, under its canonical ticker, one row per day.

    ``windowed`` has window_id, ticker, company, volume, traded and what else is
    to be kept. Steps: coverage by company and class, choice of class,
    canonical ticker by company and class over all time, remap, and of rows
    that then coincide the one of largest volume.
    """
    rows = windowed.withColumn("kind", class_of_suffix("ticker"))
    chosen = choose_class(window_completeness(rows, ["company", "kind"], date_col, clip=True), completeness).select("window_id", "company", "kind")
    names = canonical_ticker(rows, ["company", "kind"], date_col).select("company", "kind", "canonical")
    kept = rows.join(chosen, ["window_id", "company", "kind"]).join(names, ["company", "kind"], "left")
    kept = kept.withColumnRenamed("ticker", "_from").withColumn("ticker", F.coalesce("canonical", "_from")).drop("canonical")
    return keep_largest(kept, ["window_id", "ticker", date_col], "volume", "_from").drop("_from")
