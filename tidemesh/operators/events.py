"""Event studies: shocks, phases around dates, trajectories before them."""

from __future__ import annotations

import functools
import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PHASES = ("tranquil", "pre", "during", "post")


def shocks(index: DataFrame, anchors: DataFrame, radius_days: int = 60, date_col: str = "obs_date", value: str = "log_return") -> DataFrame:
    """For each anchor date the sharpest fall near it.

    z uses one mean and deviation over the whole series. Of the days within the
    radius the first with z <= -3 is the shock, else the one of least return;
    the level before it is the recovery level, the bottom is the lowest level
    until that is reached again, and the drawdown is against it.
    """
    fit = index.agg(F.avg(value).alias("_mu"), F.stddev_samp(value).alias("_sd"))
    before = F.lag("level").over(Window.orderBy(date_col))
    rows = index.withColumn("_before", before).crossJoin(F.broadcast(fit)).withColumn("z", F.try_divide(F.col(value) - F.col("_mu"), F.col("_sd")))
    near = within_days(rows, anchors, radius_days, date_col)
    first = Window.partitionBy("anchor").orderBy((F.coalesce(F.col("z"), F.lit(0.0)) > -3).cast("int"), F.when(F.col("z") <= -3, F.datediff(date_col, "anchor")), F.col(value).asc_nulls_last(), date_col)
    shock = near.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1")
    shock = shock.select("anchor", F.when(F.col("z") <= -3, "trigger_-3sigma").otherwise("largest_drop").alias("status"), F.col(date_col).alias("shock_start"), F.col(value).alias("shock_return"), F.col("z").alias("shock_z"), F.coalesce("_before", "level").alias("recovery_level"))
    after = rows.select(date_col, "level").join(shock, F.col(date_col) >= F.col("shock_start"))
    end = after.groupBy("anchor").agg(F.min(F.when((F.col("level") >= F.col("recovery_level")) & (F.col(date_col) > F.col("shock_start")), F.col(date_col))).alias("recovery_end"))
    low = after.join(end, "anchor").filter(F.col("recovery_end").isNull() | (F.col(date_col) <= F.col("recovery_end")))
    low = low.groupBy("anchor").agg(F.min_by(date_col, F.struct("level", date_col)).alias("bottom_date"), F.min("level").alias("_low"))
    out = shock.join(end, "anchor").join(low, "anchor")
    return out.withColumn("max_drawdown", F.col("_low") / F.col("recovery_level") - 1).withColumn("duration_days", F.datediff("recovery_end", "shock_start")).withColumn("recovered", F.col("recovery_end").isNotNull()).drop("_low")


def within_days(rows: DataFrame, anchors: DataFrame, radius: int, date_col: str = "obs_date") -> DataFrame:
    """Rows beside each anchor date at most ``radius`` days away: an equi-join on spans of that many days, an anchor's own and those beside it."""
    width = max(radius, 1)
    span = lambda c: F.floor(F.unix_date(c) / width)
    beside = anchors.withColumn("_span", F.explode(F.sequence(span("anchor") - 1, span("anchor") + 1)))
    return rows.withColumn("_span", span(date_col)).join(beside, "_span").filter(F.abs(F.datediff(date_col, "anchor")) <= radius).drop("_span")


def phase(event: Column, start: Column, end: Column, months: int = 6, otherwise: str | None = "tranquil") -> Column:
    """A window's phase beside an event: during if it holds the date, pre or post if it ends or starts within ``months``."""
    return (
        F.when((start <= event) & (event <= end), "during")
        .when((end < event) & (end >= F.add_months(event, -months)), "pre")
        .when((start > event) & (start <= F.add_months(event, months)), "post")
        .otherwise(otherwise)
    )


def unpivot(metrics: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    """One row per id and metric: (ids, metric, value)."""
    items = F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values])
    return metrics.select(*ids, F.explode(items).alias("_m")).select(*ids, "_m.metric", "_m.value")


def beside_events(metrics: DataFrame, events: DataFrame, months: int = 6) -> DataFrame:
    """Windows with each event that they are pre, during or post of, and that phase: the columns of both, and phase.

    An equi-join by month: a window's last month is one of the event's
    ``months`` before it, its first month one of those after, or the event's
    own month is one of the window's. Each kind is a key of its own, so a
    window meets an event once, and no other window meets it at all.
    """
    span = lambda c, k: F.sequence(F.add_months(F.trunc(c, "MM"), min(k, 0)), F.add_months(F.trunc(c, "MM"), max(k, 0)), F.expr("interval 1 month"))

    def keyed(df: DataFrame, pre: Column, during: Column, post: Column) -> DataFrame:
        def kind(p: str, ms: Column) -> Column:
            return F.transform(ms, lambda m: F.struct(F.lit(p).alias("phase"), m.alias("month")))

        kinds = F.concat(kind("pre", pre), kind("during", during), kind("post", post))
        return df.withColumn("_key", F.explode(kinds)).withColumns({"_phase": F.col("_key.phase"), "_month": F.col("_key.month")}).drop("_key")

    months_of = F.sequence(F.trunc("window_start", "MM"), F.trunc("window_end", "MM"), F.expr("interval 1 month"))
    windows = keyed(metrics.filter("window_start <= window_end"), F.array(F.trunc("window_end", "MM")), months_of, F.array(F.trunc("window_start", "MM")))
    near = keyed(events.filter("event_date is not null"), span("event_date", -months), F.array(F.trunc("event_date", "MM")), span("event_date", months))
    rows = windows.join(near, ["_phase", "_month"]).withColumn("phase", phase(F.col("event_date"), F.col("window_start"), F.col("window_end"), months, None))
    return rows.filter(F.col("phase") == F.col("_phase")).drop("_phase", "_month")


_EVENT = ["event_set", "event_date", "status"]


def phase_summary(events: DataFrame, metrics: DataFrame, values: list[str], months: int = 6) -> DataFrame:
    """Per event, metric and phase: windows, mean, and change from the pre phase; phases without windows have null means.

    ``events``: event_set, event_date, status. ``metrics``: window_id,
    window_start, window_end and the values; it is read twice. Only windows
    beside an event are joined with it; its tranquil ones are all the others,
    whose count and sum are what the total has beyond these.
    """
    keys = [*_EVENT, "metric"]
    near = unpivot(beside_events(metrics, events, months), [*_EVENT, "phase"], values)
    of = lambda p: F.when(F.col("phase") == p, F.col("value"))
    near = near.groupBy(*keys).agg(*[x for p in PHASES[1:] for x in (F.count(of(p)).alias(f"{p}_n"), F.sum(of(p)).alias(f"{p}_sum"))])
    total = unpivot(metrics, [], values).groupBy("metric").agg(F.count("value").alias("_n"), F.sum("value").alias("_sum"))
    every = events.select(*_EVENT, F.explode(F.array(*[F.lit(v) for v in values])).alias("metric"))
    sums = every.join(near, keys, "left").join(total, "metric")
    zero = {f"{p}_{x}": F.coalesce(F.col(f"{p}_{x}"), F.lit(0 if x == "n" else 0.0)) for p in PHASES[1:] for x in ("n", "sum")}
    rest = lambda whole, x: F.coalesce(F.col(whole), F.lit(0 if x == "n" else 0.0)) - sum(zero[f"{p}_{x}"] for p in PHASES[1:])
    count = {p: zero[f"{p}_n"] for p in PHASES[1:]} | {"tranquil": rest("_n", "n")}
    mean = {p: F.try_divide(F.col(f"{p}_sum"), F.col(f"{p}_n")) for p in PHASES[1:]} | {"tranquil": F.try_divide(rest("_sum", "sum"), rest("_n", "n"))}
    items = F.array(*[F.struct(F.lit(p).alias("phase"), count[p].alias("windows"), mean[p].alias("mean"), (mean[p] - mean["pre"]).alias("change_from_pre")) for p in PHASES])
    return sums.select(*keys, F.explode(items).alias("_p")).select(*keys, "_p.*")


def concordance(detail: DataFrame) -> DataFrame:
    """Per set, status, metric and phase (during, post): signs of the changes, median and mean, dominant direction and its share."""
    d = detail.filter(F.col("phase").isin("during", "post") & F.col("change_from_pre").isNotNull())
    c = F.col("change_from_pre")
    out = d.groupBy("event_set", "status", "metric", "phase").agg(
        F.count(F.lit(1)).alias("events"), F.sum((c > 0).cast("int")).alias("positive"), F.sum((c < 0).cast("int")).alias("negative"), F.percentile("change_from_pre", F.lit(0.5)).alias("median_change"), F.avg(c).alias("mean_change")
    )
    out = out.withColumn("dominant_direction", F.when(F.col("positive") >= F.col("negative"), "positive").otherwise("negative"))
    return out.withColumn("concordance_share", F.greatest("positive", "negative") / F.col("events"))


def trajectories(events: DataFrame, metrics: DataFrame, values: list[str], length: int = 6, months: int = 6) -> DataFrame:
    """The windows of an event's pre phase, in order, with z by population deviation; events without exactly ``length`` are left out."""
    beside = beside_events(metrics, events, months).filter("phase = 'pre'")
    pre = unpivot(beside, ["window_id", "window_start", "window_end", *_EVENT], values)
    keys = [*_EVENT, "metric"]
    whole, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("window_end")
    rows = pre.withColumn("position", F.row_number().over(order)).withColumn("_n", F.count(F.lit(1)).over(whole)).filter(F.col("_n") == length)
    z = F.coalesce(F.try_divide(F.col("value") - F.avg("value").over(whole), F.stddev_pop("value").over(whole)), F.lit(0.0))
    return rows.withColumn("z", z).drop("_n")


def trajectory_summary(paths: DataFrame) -> DataFrame:
    """Per event and metric: latest step, change from first to last, turning points, and range over the mean's size."""
    keys = ["event_set", "event_date", "status", "metric"]
    order = Window.partitionBy(*keys).orderBy("position")
    steps = paths.withColumn("_d", F.col("value") - F.lag("value").over(order))
    moving = steps.filter("_d <> 0").withColumn("_turn", (F.signum("_d") != F.signum(F.lag("_d").over(order))).cast("int"))
    turns = moving.groupBy(*keys).agg(F.coalesce(F.sum("_turn"), F.lit(0)).alias("turning_points"))
    out = steps.groupBy(*keys).agg(
        F.max_by("_d", "position").alias("latest_step"), (F.max_by("value", "position") - F.min_by("value", "position")).alias("endpoint_change"), F.try_divide(F.max("value") - F.min("value"), F.abs(F.avg("value"))).alias("relative_range")
    )
    return out.join(turns, keys, "left").withColumn("turning_points", F.coalesce("turning_points", F.lit(0)))


def recurrence(summary: DataFrame) -> DataFrame:
    """Per metric: events whose latest step went up, down or nowhere, of all and of the triggered ones, and medians."""
    s = F.col("latest_step")
    on = F.col("status").startswith("trigger")
    count = lambda c: F.sum(F.coalesce(c.cast("int"), F.lit(0)))
    return summary.groupBy("metric").agg(
        count(s < 0).alias("down"), count(s == 0).alias("flat"), count(s > 0).alias("up"), count(on & (s > 0)).alias("trigger_up"), count(on & (s < 0)).alias("trigger_down"), count(on & (s == 0)).alias("trigger_flat"),
        F.percentile("turning_points", F.lit(0.5)).alias("median_turning_points"), F.percentile("relative_range", F.lit(0.5)).alias("median_relative_range"),
    )


def min_max_scaled(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds scaled: the value on [0, 1] within its group; a group of one value is not stretched."""
    w = Window.partitionBy(*keys)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn("scaled", (F.col(value) - lo) / F.when(hi > lo, hi - lo).otherwise(1.0))


#: (ticker, period, at, name): from ``at`` on, within the period, ``name`` holds the office (null: nobody).
_SEGMENTS = "ticker string, period int, at date, name string"


def office_segments(terms: DataFrame, periods: DataFrame) -> DataFrame:
    """Terms (ticker, name, start, end) as segments of one holder: of the open terms, the one that started last (of equals, the greatest name).

    A term is dealt to each calendar year that it touches, from ``periods``
    (first, last: one row), so a ticker of many terms is swept year by year:
    starts in order, open terms on a heap, those that ended taken off when
    they come to its top.
    """

    def sweep(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ends_at = [None if pd.isna(x) else x for x in rows["to"]]
        starts = sorted(zip(rows["from"], [-s.toordinal() for s in rows["start"]], rows["name"], ends_at, strict=True), key=lambda r: r[0])
        heap: list = []
        out: list[tuple] = []
        k = 0
        for at in sorted({x for x in ends_at if x is not None} | {r[0] for r in starts}):
            while k < len(starts) and starts[k][0] <= at:
                _, late, name, to = starts[k]
                heapq.heappush(heap, (late, _Greater(name), k, to))
                k += 1
            while heap and heap[0][3] is not None and heap[0][3] <= at:
                heapq.heappop(heap)
            out.append((at, heap[0][1].value if heap else None))
        return pd.DataFrame({"ticker": key[0], "period": key[1], "at": [x for x, _ in out], "name": [x for _, x in out]})

    years = terms.filter("ticker is not null and start is not null and (end is null or end > start)").crossJoin(F.broadcast(periods))
    first, last = F.greatest(F.year("start"), F.col("first")), F.least(F.coalesce(F.year(F.date_sub("end", 1)), F.col("last")), F.col("last"))
    dealt = years.filter(first <= last).withColumn("period", F.explode(F.sequence(first, last)))
    opens = F.make_date("period", F.lit(1), F.lit(1))
    dealt = dealt.select("ticker", "period", "name", F.col("start").cast("date").alias("start"), F.greatest(F.col("start").cast("date"), opens).alias("from"), F.col("end").cast("date").alias("to"))
    return dealt.groupBy("ticker", "period").applyInPandas(sweep, _SEGMENTS)


@functools.total_ordering
class _Greater:
    """A name that sorts before lesser ones."""

    def __init__(self, value: str | None):
        self.value = value

    def __eq__(self, other: _Greater) -> bool:
        return self.value == other.value

    def __lt__(self, other: _Greater) -> bool:
        return self.value is not None and (other.value is None or self.value > other.value)


def in_office(dates: DataFrame, timeline: DataFrame, siblings: DataFrame | None = None) -> DataFrame:
    """Who held an office on a date: (ticker, day) with timeline (ticker, name, start, end), end null while in office.

    The latest start wins. Where a ticker has nobody, one of the same code
    does, if ``siblings`` (ticker, sigla) is given. Days and segments of one
    holder (``office_segments``) lie in one order by ticker and year, in which
    each day takes the last segment before it: no day meets a ticker's whole
    timeline, and a ticker with many days is split by year. A day or ticker
    that is null has nobody.
    """
    own = dates.select("ticker", F.col("day").cast("date").alias("day")).distinct()
    periods = own.agg(F.min(F.year("day")).alias("first"), F.max(F.year("day")).alias("last")).filter("first is not null")
    terms = timeline.select("ticker", "name", "start", "end")

    def holders(terms: DataFrame, name: str) -> DataFrame:
        marks = office_segments(terms, periods).select("ticker", "period", "at", F.struct("name").alias("_holder"))
        days = own.select("ticker", F.year("day").alias("period"), F.col("day").alias("at"), F.lit(None).cast("struct<name:string>").alias("_holder"))
        order = Window.partitionBy("ticker", "period").orderBy("at", F.col("_holder").isNull())
        both = marks.withColumn("_day", F.lit(False)).unionByName(days.withColumn("_day", F.lit(True)))
        return both.withColumn("_last", F.last("_holder", ignorenulls=True).over(order)).filter("_day").select("ticker", F.col("at").alias("day"), F.col("_last.name").alias(name))

    out = holders(terms, "name")
    if siblings is None:
        return out
    s = siblings.select("ticker", "sigla").distinct()
    kin = s.join(s.withColumnRenamed("ticker", "_kin"), "sigla").filter("_kin <> ticker").select("ticker", "_kin").distinct()
    kin = kin.join(terms.withColumnRenamed("ticker", "_kin"), "_kin").select("ticker", "name", "start", "end")
    both = out.join(holders(kin, "_name"), ["ticker", "day"], "left")
    return both.select("ticker", "day", F.coalesce("name", "_name").alias("name"))
