"""Sums by month against the same over the rows of each window, under several partitionings."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemesh.operators import calendar, correlation, monthly


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(3)
    first = datetime.date(2001, 1, 15)
    out = []
    for k in range(500):
        day = first + datetime.timedelta(days=k)
        for a in "abcdef":
            if a == "f" and day.month % 2:  # no row for whole months
                continue
            if rnd.random() < 0.6:
                value = None if rnd.random() < 0.1 or (a == "e" and day.month == 5) else 5000 + rnd.gauss(0, 1) + (k % 31 if a in "ab" else 0)
                out.append((day, a, value, rnd.random()))
    out += out[:5]  # repeated rows
    out += [(first, "flat", 1.0, 1.0), (first + datetime.timedelta(days=1), "flat", 1.0, 1.0)]
    return spark.createDataFrame(out, "obs_date date, asset string, log_return double, volume double")


def windowed(rows):
    windows = calendar.month_windows(rows)
    return calendar.assign_windows(rows, windows).cache(), windows


def test_pairs_merge(spark, rows):
    wide, windows = windowed(rows)
    want = {r[:3]: (r.observations, r.rho) for r in correlation.pair_correlations(wide, ["window_id"]).collect()}
    for parts in (1, 7):
        got = {r[:3]: (r.observations, r.rho) for r in correlation.merge_moments(correlation.month_moments(rows.repartition(parts)), windows).collect()}
        assert got.keys() == want.keys()
        for k, (n, rho) in want.items():
            assert got[k][0] == n and (got[k][1] == pytest.approx(rho, abs=1e-9) if rho is not None else got[k][1] is None)


def test_the_join_has_each_date_once(spark, rows):
    plan = correlation.merge_moments(correlation.month_moments(rows), calendar.month_windows(rows))._jdf.queryExecution().optimizedPlan().toString()
    deal = plan.index("Generate explode(sequence(add_months(month")
    assert deal < plan.index("Join Inner, ((")  # windows are dealt above the join of dates, not below


def test_totals_and_statistics_merge(spark, rows):
    wide, windows = windowed(rows)
    want = wide.groupBy("window_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("obs_date").alias("days"), F.sum("volume").alias("volume"), F.countDistinct("asset").alias("assets"), F.avg("log_return").alias("mean"), F.stddev_samp("log_return").alias("sd"))
    want = {r.window_id: r for r in want.collect()}
    longest = {r.window_id: r.n for r in wide.groupBy("window_id", "asset").agg(F.count("log_return").alias("n")).groupBy("window_id").agg(F.max("n").alias("n")).collect()}
    for parts in (1, 7):
        dealt = rows.repartition(parts)
        totals = {r.window_id: r for r in monthly.window_totals(dealt, windows).collect()}
        stats = {r.window_id: r for r in monthly.window_stats(dealt, windows).collect()}
        most = max(r.assets for r in want.values())
        assert totals.keys() == stats.keys() == want.keys()
        for w, r in want.items():
            assert (totals[w].n, totals[w].days) == (r.n, r.days) and totals[w].volume == pytest.approx(r.volume)
            s = stats[w]
            assert (s.assets, s.days) == (r.assets, r.days) and np.allclose([s.mean_return, s.volatility], [r.mean, r.sd], rtol=1e-9)
            assert (s.complete, s.problematic) == (r.assets >= 0.9 * most, r.assets < 0.5 * most)
        assert {r.window_id: r.n_obs for r in monthly.window_observations(dealt, windows).collect()} == longest


def test_no_rows_and_unknown_values(spark, rows):
    none = rows.limit(0)
    windows = calendar.month_windows(none)
    assert monthly.window_totals(none, windows).count() == monthly.window_stats(none, windows).count() == 0
    assert correlation.merge_moments(correlation.month_moments(none), windows).count() == 0
    unknown = rows.withColumn("log_return", F.lit(None).cast("double"))
    stats = monthly.window_stats(unknown, calendar.month_windows(unknown)).collect()
    assert stats and all(r.mean_return is None and r.volatility is None for r in stats)
    assert {r.n_obs for r in monthly.window_observations(unknown, calendar.month_windows(unknown)).collect()} == {0}
    assert {r.observations for r in correlation.merge_moments(correlation.month_moments(unknown), calendar.month_windows(unknown)).collect()} == {0}
