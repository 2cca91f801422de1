"""As-of lookup by sweep against the definition; clustering by chains against merging the nearest pair."""

import datetime as dt
import random
import time

import numpy as np
import pytest

from tidemesh.operators import events, kernels


def brute(days, terms, kin):
    def holder(tickers, day):
        held = [(s, n is not None, n or "", n) for t, n, s, e in terms if t in tickers and t is not None and s is not None and day is not None and s <= day and (e is None or e > day)]
        return max(held, key=lambda h: h[:3])[3] if held else None

    return {(t, d): holder({t}, d) or holder({b for a, b in kin if a == t}, d) for t, d in set(days)}


@pytest.mark.parametrize("seed", range(4))
def test_in_office(spark, seed):
    rnd = random.Random(seed)
    day = lambda: dt.date(2000, 1, 1) + dt.timedelta(days=rnd.randint(0, 1200))
    tickers = ["A3", "A4", "B3", "C3"]
    terms = []
    for _ in range(60):
        a, b = sorted((day(), day()))
        terms.append((rnd.choice(tickers), rnd.choice(["x", "y", "z", "w", None]) if seed else rnd.choice("xyzw"), a, None if rnd.random() < 0.1 else b))
    terms += [("A3", "old", dt.date(1980, 5, 1), dt.date(2000, 2, 1)), ("B3", "never", dt.date(2001, 1, 1), dt.date(2001, 1, 1)), (None, "ghost", dt.date(1999, 1, 1), None), ("B3", "no start", None, None), terms[0]]
    days = [(rnd.choice(tickers), day()) for _ in range(150)] + [("D3", day()), (None, day()), ("A3", None), ("A3", terms[0][2]), (terms[1][0], terms[1][3] or day())] * 2
    codes = [("A3", "A"), ("A4", "A"), ("B3", "B"), ("D3", "B"), ("D3", "B")]
    kin = {(a, b) for a, x in codes for b, y in codes if x == y and a != b}
    frames = (spark.createDataFrame(days, "ticker string, day date"), spark.createDataFrame(terms, "ticker string, name string, start date, end date"), spark.createDataFrame(codes, "ticker string, sigla string"))
    for got, want in ((events.in_office(*frames[:2]), brute(days, terms, set())), (events.in_office(*frames), brute(days, terms, kin))):
        rows = got.collect()
        assert len(rows) == len(want) and {(r.ticker, r.day): r.name for r in rows} == want


def test_no_days_and_no_terms(spark):
    days, terms = spark.createDataFrame([("a", dt.date(2000, 1, 1))], "ticker string, day date"), spark.createDataFrame([], "ticker string, name string, start date, end date")
    assert events.in_office(days, terms).collect()[0]["name"] is None
    assert events.in_office(days.limit(0), terms).count() == 0


def test_a_day_meets_no_timeline(spark):
    """The plan joins terms with one row only, the span of years; days and segments meet in a sort."""
    days = spark.createDataFrame([("a", dt.date(2000, 1, 1))], "ticker string, day date")
    terms = spark.createDataFrame([("a", "n", dt.date(1999, 1, 1), None)], "ticker string, name string, start date, end date")
    plan = events.in_office(days, terms)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == plan.count("BroadcastNestedLoopJoin") == 1 and "Union" in plan


def nearest_pairs(d, method):
    """Merge the two nearest clusters, again and again; distances from the definition."""
    d = d.copy()
    groups, heights = [[k] for k in range(len(d))], []
    x = d**2

    def apart(a, b):
        if method == "average":
            return d[np.ix_(a, b)].mean()
        if method == "complete":
            return d[np.ix_(a, b)].max()
        within = lambda g: x[np.ix_(g, g)].sum() / (2 * len(g))
        return np.sqrt(2 * (within(a + b) - within(a) - within(b)))

    while len(groups) > 1:
        h, i, j = min((apart(groups[i], groups[j]), i, j) for i in range(len(groups)) for j in range(i))
        heights.append((h, sorted(groups[i] + groups[j])))
        groups = [g for k, g in enumerate(groups) if k not in (i, j)] + [groups[i] + groups[j]]
    return heights


@pytest.mark.parametrize("method", ["average", "complete", "ward"])
@pytest.mark.parametrize("n", [1, 2, 3, 9, 24])
def test_linkage(method, n):
    points = np.random.default_rng(n).normal(size=(n, 3))
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    merges = kernels.linkage(d, method)
    sets = {k: [k] for k in range(n)}
    got = []
    for step, (a, b, h, size) in enumerate(merges):
        sets[n + step] = sorted(sets[int(a)] + sets[int(b)])
        assert a < b and size == len(sets[n + step])
        got.append((h, sets[n + step]))
    want = nearest_pairs(d, method)
    assert [g for _, g in got] == [g for _, g in want] and np.allclose([h for h, _ in got], [h for h, _ in want])


def test_linkage_of_ties_and_many():
    merges = kernels.linkage(np.ones((6, 6)) - np.eye(6), "average")
    assert np.allclose(merges[:, 2], 1) and merges[-1, 3] == 6
    points = np.random.default_rng(0).normal(size=(2000, 4))
    square = (points**2).sum(1)
    d = np.sqrt(np.maximum(square[:, None] + square[None] - 2 * points @ points.T, 0))
    began = time.process_time()
    merges = kernels.linkage(d, "ward")
    assert time.process_time() - began < 30 and (np.diff(merges[:, 2]) >= 0).all() and merges[-1, 3] == 2000


def test_windows_beside_events(spark):
    """The join by month finds what every pair of window and event would."""
    import itertools

    from pyspark.sql import functions as F

    rnd = random.Random(9)
    windows, events_ = [], []
    for k in range(60):
        start = dt.date(1999, 1, 1) + dt.timedelta(days=rnd.randint(0, 1500))
        windows.append((k, start, start + dt.timedelta(days=rnd.choice([0, 20, 364])), None if k % 7 == 0 else rnd.gauss(0, 1), float(k)))
    events_ = [("s", dt.date(1999, 6, 1) + dt.timedelta(days=rnd.randint(0, 900)), f"t{k}") for k in range(12)] + [("s", dt.date(1980, 1, 31), "far"), ("s", dt.date(2000, 8, 31), "end of month")]
    m = spark.createDataFrame(windows, "window_id int, window_start date, window_end date, a double, b double")
    e = spark.createDataFrame(events_, "event_set string, event_date date, status string")
    pairs = m.crossJoin(e).withColumn("phase", events.phase(F.col("event_date"), F.col("window_start"), F.col("window_end")))
    want = {(r.status, r.window_id): r.phase for r in pairs.collect()}
    near = events.beside_events(m, e).collect()
    assert len(near) == len({(r.status, r.window_id) for r in near}) > 40
    assert {(r.status, r.window_id): r.phase for r in near} == {k: p for k, p in want.items() if p != "tranquil"}
    got = {(r.status, r.metric, r.phase): r for r in events.phase_summary(e, m, ["a", "b"]).collect()}
    assert len(got) == 14 * 2 * 4
    for (_, _, status), (at, metric), p in itertools.product(events_, ((3, "a"), (4, "b")), events.PHASES):
        values = [w[at] for w in windows if want[status, w[0]] == p and w[at] is not None]
        r = got[status, metric, p]
        assert r.windows == len(values) and (r["mean"] is None if not values else r["mean"] == pytest.approx(sum(values) / len(values)))
    assert "NestedLoop" not in events.phase_summary(e, m, ["a"])._jdf.queryExecution().executedPlan().toString()
