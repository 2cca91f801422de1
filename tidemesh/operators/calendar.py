"""Calendar windows and their assignment to observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONTHS = 12


def month_windows(df: DataFrame, months: int = MONTHS, step: int = 1, date_col: str = "obs_date") -> DataFrame:
    """Windows of whole calendar months from the first observation's month, while they end by the last observation."""
    span = df.agg(F.min(date_col).alias("lo"), F.max(date_col).alias("hi")).filter("lo is not null")
    starts = span.select("hi", F.posexplode(F.expr(f"sequence(trunc(lo, 'MM'), hi, interval {step} month)")).alias("k", "window_start"))
    ends = starts.withColumn("window_end", F.last_day(F.add_months("window_start", months - 1))).filter("window_end <= hi")
    return ends.select((F.col("k") + 1).cast("int").alias("window_id"), "window_start", "window_end")


def offset_windows(df: DataFrame, months: int = MONTHS, step: int = 1, date_col: str = "obs_date") -> DataFrame:
    """Half-open windows [start, end) counted from the first observation itself; the first that would end past the last one stops."""
    span = df.agg(F.min(date_col).alias("lo"), F.max(date_col).alias("hi")).filter("lo is not null")
    rows = span.select("lo", "hi", F.explode(F.expr(f"sequence(0, cast(months_between(hi, lo) as int), {step})")).alias("k"))
    rows = rows.select((F.col("k") / step + 1).cast("int").alias("window_id"), F.add_months("lo", F.col("k")).alias("window_start"), F.add_months("lo", F.col("k") + months).alias("window_end"), "hi")
    label = F.concat(F.date_format("window_start", "yyyy-MM"), F.lit(" a "), F.date_format("window_end", "yyyy-MM"))
    return rows.filter("window_end <= hi").select("window_id", "window_start", "window_end", label.alias("label"))


def assign_windows(df: DataFrame, windows: DataFrame, months: int = MONTHS, date_col: str = "obs_date") -> DataFrame:
    """Each row once per calendar window that holds it.

    A row of month m lies in the windows that start in m - months + 1 .. m, so
    an equi-join on the start replaces a range join; the windows, one a month,
    go by a broadcast if Spark finds them small.
    """
    start = F.explode(F.expr(f"sequence(add_months(trunc({date_col}, 'MM'), {1 - months}), trunc({date_col}, 'MM'), interval 1 month)"))
    return df.withColumn("window_start", start).join(windows, "window_start")


def in_half_open(df: DataFrame, windows: DataFrame, months: int = MONTHS, date_col: str = "obs_date") -> DataFrame:
    """Rows of half-open windows whose starts are a month apart; candidates come from month buckets, so it's an equi-join too."""
    keyed = windows.withColumn("_m", F.explode(F.expr("sequence(trunc(window_start, 'MM'), trunc(window_end, 'MM'), interval 1 month)")))
    rows = df.withColumn("_m", F.trunc(date_col, "MM")).join(keyed, "_m")
    return rows.filter((F.col(date_col) >= F.col("window_start")) & (F.col(date_col) < F.col("window_end"))).drop("_m")


def validate_windows(windows: DataFrame, months: int = MONTHS) -> DataFrame:
    """Per window: months covered, months since the last one began, and whether both are as they should be."""
    order = Window.orderBy("window_id")
    covered = F.months_between(F.date_add("window_end", 1), "window_start").cast("int")
    lag = F.months_between("window_start", F.lag("window_start").over(order)).cast("int")
    out = windows.select("window_id", covered.alias("months_covered"), lag.alias("months_lag"))
    return out.withColumn("valid", (F.col("months_covered") == months) & F.coalesce(F.col("months_lag") == 1, F.lit(True)))


def summarise_windows(windows: DataFrame) -> DataFrame:
    return windows.agg(
        F.count(F.lit(1)).alias("windows"), F.min("window_start").alias("first_start"), F.min("window_end").alias("first_end"), F.max("window_start").alias("last_start"), F.max("window_end").alias("last_end")
    )


def windows_json(windows: DataFrame) -> DataFrame:
    """Each window as a JSON object {id, start, end}."""
    item = F.struct(F.col("window_id").alias("id"), F.col("window_start").cast("string").alias("start"), F.col("window_end").cast("string").alias("end"))
    return windows.select("window_id", F.to_json(item).alias("json"))


def business_days(df: DataFrame, date_col: str = "obs_date") -> DataFrame:
    """Monday to Friday from the first to the last observation."""
    days = df.agg(F.min(date_col).alias("lo"), F.max(date_col).alias("hi")).filter("lo is not null").select(F.explode(F.expr("sequence(lo, hi, interval 1 day)")).alias("day"))
    return days.filter(F.weekday("day") < 5)


def trading_days(df: DataFrame, holidays: DataFrame, date_col: str = "obs_date") -> DataFrame:
    """Business days that aren't in ``holidays`` (column day)."""
    return business_days(df, date_col).join(holidays.select("day"), "day", "left_anti")


def window_label(window_id: Column, start: Column, end: Column) -> Column:
    """A range if both ends are known, else what is."""
    day = "yyyy-MM-dd"
    return (
        F.when(start.isNotNull() & end.isNotNull(), F.concat(F.date_format(start, day), F.lit(" a "), F.date_format(end, day)))
        .when(end.isNotNull(), F.concat(F.lit("ate "), F.date_format(end, day)))
        .when(start.isNotNull(), F.concat(F.lit("desde "), F.date_format(start, day)))
        .when(window_id.isNotNull(), F.concat(F.lit("Janela "), window_id.cast("string")))
        .otherwise(F.lit(""))
    )


def with_placeholders(windows: DataFrame, stats: DataFrame, columns: list[str], reason: str = "no data") -> DataFrame:
    """Every window; those without statistics get zeros, modeled 0 and the reason."""
    out = windows.join(stats.withColumn("_has", F.lit(True)), "window_id", "left")
    has = F.coalesce(F.col("_has"), F.lit(False))
    zeros = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in columns]
    return out.select(*windows.columns, *zeros, has.cast("int").alias("modeled"), F.when(has, "ok").otherwise(reason).alias("model_reason"))
