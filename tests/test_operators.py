import datetime as dt
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemesh.functions import scalars
from tidemesh.operators import calendar, cleaning, correlation, events, statistics
from tidemesh.plans.base import rounded
from tidemesh.sources import config, quotes, sinks
from tidemesh.streaming import rolling


def day(s):
    return dt.date.fromisoformat(s)


def test_moments_of_five_values(spark):
    df = spark.createDataFrame([("a", x) for x in (1.0, 2.0, 4.0, 9.0, 20.0)] + [("b", 1.0), ("c", 3.0), ("c", 3.0), ("c", 3.0), ("c", 3.0)], "g string, x double")
    r = {x["g"]: x for x in df.groupBy("g").agg(*statistics.moments("x", "m")).collect()}
    assert r["a"]["m_skew"] == pytest.approx(1.4901199697) and r["a"]["m_kurt"] == pytest.approx(1.8954319322)
    assert r["b"]["m_skew"] is None and r["c"]["m_kurt"] is None and r["c"]["m_skew"] is None


def test_constant_series_has_no_correlation(spark):
    rows = [(1, day(f"2000-01-{d:02d}"), a, v) for d in range(1, 6) for a, v in (("flat", 1.0), ("up", float(d)), ("down", -float(d)))]
    p = {(r["asset_1"], r["asset_2"]): r["rho"] for r in correlation.pair_correlations(spark.createDataFrame(rows, "w int, obs_date date, asset string, log_return double"), ["w"]).collect()}
    assert p["flat", "up"] is None and p["down", "up"] == pytest.approx(-1)
    d = correlation.distances(correlation.pair_correlations(spark.createDataFrame(rows, "w int, obs_date date, asset string, log_return double"), ["w"]), "uncorrelated")
    assert d.filter("asset_1 = 'flat' or asset_2 = 'flat'").filter("abs(distance - sqrt(2)) < 1e-12").count() == 2
    with pytest.raises(ValueError):
        correlation.distances(d, "other")


@pytest.mark.parametrize(("n", "t"), [(1, 12.706), (5, 2.5706), (10, 2.2281), (49, 2.0096), (50, 2.0086)])
def test_student_tail_at_published_points(spark, n, t):
    p = spark.range(1).select(correlation.student_t_sf2(F.lit(t), F.lit(n)).alias("p")).first()["p"]
    assert p == pytest.approx(0.05, abs=2e-5)


GAPPY = [
    ("2000-01-03", "A", 10.0, 5.0), ("2000-01-04", "A", 10.0, 5.0), ("2000-01-05", "A", None, 5.0), ("2000-01-06", "A", 11.0, 0.0), ("2000-01-07", "A", 12.0, 5.0),
    ("2000-01-03", "B", None, 5.0), ("2000-01-04", "B", 0.0, 5.0), ("2000-01-05", "B", 7.0, None),
]


def test_traded_days_and_returns(spark):
    df = spark.createDataFrame([(day(d), t, c, v) for d, t, c, v in GAPPY], "obs_date date, ticker string, close double, volume double")
    out = cleaning.log_returns(cleaning.traded_days(df)).orderBy("ticker", "obs_date").collect()
    assert [r["traded"] for r in out] == [True, False, False, False, True, False, False, False]
    assert [r["filled_close"] for r in out] == [10, 10, 10, 11, 12, None, 0, 7]
    assert out[4]["log_return"] == pytest.approx(math.log(12 / 11)) and out[0]["log_return"] == 0 == out[7]["log_return"]


def test_windows_of_short_and_empty_panels(spark):
    schema = "obs_date date"
    assert calendar.month_windows(spark.createDataFrame([], schema)).count() == 0
    assert calendar.month_windows(spark.createDataFrame([(day("2000-01-05"),), (day("2000-12-30"),)], schema)).count() == 0
    w = calendar.month_windows(spark.createDataFrame([(day("2000-01-05"),), (day("2000-12-31"),)], schema)).collect()
    assert [(r["window_id"], r["window_start"], r["window_end"]) for r in w] == [(1, day("2000-01-01"), day("2000-12-31"))]


def test_assignment_equals_a_range_join(spark):
    rows = spark.createDataFrame([(day("2000-01-05") + dt.timedelta(days=9 * k), k) for k in range(120)], "obs_date date, k int")
    w = calendar.month_windows(rows)
    fast = calendar.assign_windows(rows, w).select("window_id", "k")
    slow = rows.join(w, (F.col("obs_date") >= F.col("window_start")) & (F.col("obs_date") <= F.col("window_end"))).select("window_id", "k")
    assert fast.exceptAll(slow).count() == 0 == slow.exceptAll(fast).count() and fast.count() > 0
    assert "NestedLoop" not in calendar.assign_windows(rows, w)._jdf.queryExecution().executedPlan().toString()
    o = calendar.offset_windows(rows)
    half = calendar.in_half_open(rows, o).select("window_id", "k")
    want = rows.join(o, (F.col("obs_date") >= F.col("window_start")) & (F.col("obs_date") < F.col("window_end"))).select("window_id", "k")
    assert half.exceptAll(want).count() == 0 == want.exceptAll(half).count()


def test_phases(spark):
    rows = [(k, day(f"{2000 + (k - 1) // 12}-{(k - 1) % 12 + 1:02d}-01")) for k in range(1, 49)]
    w = spark.createDataFrame(rows, "window_id int, window_start date").withColumn("window_end", F.last_day(F.add_months("window_start", 11))).withColumn("m", F.col("window_id").cast("double"))
    ev = spark.createDataFrame([("s", day("2002-06-15"), "trigger")], "event_set string, event_date date, status string")
    d = {r["phase"]: r for r in events.phase_summary(ev, w, ["m"]).collect()}
    assert (d["pre"]["windows"], d["during"]["windows"], d["post"]["windows"]) == (6, 12, 6)
    assert d["during"]["change_from_pre"] == pytest.approx(9) and d["pre"]["change_from_pre"] == 0
    t = events.trajectories(ev, w, ["m"])
    assert [r["position"] for r in t.orderBy("position").collect()] == [1, 2, 3, 4, 5, 6]
    s = events.trajectory_summary(t).first()
    assert (s["latest_step"], s["endpoint_change"], s["turning_points"]) == (1.0, 5.0, 0)
    c = events.concordance(events.phase_summary(ev, w, ["m"])).collect()
    assert all(r["dominant_direction"] == "positive" and r["concordance_share"] == 1 for r in c)


def test_shock_and_recovery(spark):
    levels = [100.0] * 30 + [60.0, 55.0, 70.0, 101.0] + [101.0] * 10
    rows = [(day("2000-01-01") + dt.timedelta(days=k), math.log(x / levels[max(k - 1, 0)]), x) for k, x in enumerate(levels)]
    out = events.shocks(spark.createDataFrame(rows, "obs_date date, log_return double, level double"), spark.createDataFrame([(day("2000-02-01"),)], "anchor date")).first()
    assert out["status"] == "trigger_-3sigma" and out["shock_start"] == day("2000-01-31") and out["bottom_date"] == day("2000-02-01")
    assert out["max_drawdown"] == pytest.approx(-0.45) and out["duration_days"] == 3 and out["recovered"]


def test_scalars(spark):
    df = spark.createDataFrame([(" petr4.sa ", "Açúcar S.A. ON N1"), ("vale3Ã©", None)], "s string, c string")
    out = df.select(scalars.normalize_symbol(F.col("s")).alias("a"), scalars.normalize_company(F.col("c")).alias("b")).collect()
    assert out[0]["a"] == "PETR4SA" and out[1]["a"] == "VALE3" and out[0]["b"] == "ACUCAR S A N1"
    sim = spark.createDataFrame([("abc", "abc"), ("abc", "abcd"), ("abcd", "abc"), ("abcx", "abcy"), ("", "a")], "a string, b string")
    assert [r[0] for r in sim.select(scalars.company_similarity(F.col("a"), F.col("b"))).collect()] == [1.0, 0.95, 0.9, 0.75, 0.0]
    p = spark.createDataFrame([("Não", "12.7", "x"), ("sim", "NaN", "-3"), ("?", "1e3", "")], "b string, f string, i string")
    rows = p.select(scalars.safe_bool(F.col("b")), scalars.safe_float(F.col("f")), scalars.safe_int(F.col("i"))).collect()
    assert [tuple(r) for r in rows] == [(False, 12.7, None), (True, None, -3), (None, 1000.0, None)]


def test_flatten_tree_and_json(spark, tmp_path):
    tree = spark.createDataFrame([({"a": {"b": ["X3", "Y4"]}},)], "tree map<string, map<string, array<string>>>")
    assert sorted(r["ticker"] for r in scalars.flatten_tree(tree).collect()) == ["X3", "Y4"]
    (tmp_path / "w.json").write_text('{"windows": [{"id": 1, "start": "2000-01-01", "end": "2000-12-31"}]}')
    assert quotes.read_windows(spark, str(tmp_path / "w.json")).first()["window_end"] == day("2000-12-31")


def record(ticker="ABCD4", close="0000000001234", date="20000103", kind="01"):
    return f"{kind}{date}02{ticker:<12}010{'COMPANY':<12}{'PN':<10}{' ' * 7}{'0000000001000' * 3}{'0000000001100'}{close}{'0' * 26}00007{'0' * 18}{'000000000000050000'}"


def test_record_files_and_archives(spark, tmp_path):
    text = "\n".join([record(kind="00"), record(), record("EFGH11", "bad          "), record(date="20001399"), record("ÇÃO3"), record(kind="99")])
    (tmp_path / "q.txt").write_bytes(text.encode("latin-1"))
    rows = quotes.read_records(spark, str(tmp_path / "q.txt")).orderBy("ticker").collect()
    assert [r["ticker"] for r in rows] == ["ABCD4", "ÇÃO3"] and rows[0]["close"] == 12.34 and rows[0]["volume"] == 50000
    with zipfile.ZipFile(tmp_path / "q.zip", "w") as z:
        z.write(tmp_path / "q.txt", "q.txt")
    ext = quotes.read_archives(spark, str(tmp_path / "q.zip"), quotes.EXTENDED)
    assert quotes.spot_market(ext).count() == 2 and ext.first()["trades"] == 7 and ext.first()["volume"] == 500


def test_sinks(spark, tmp_path):
    e = spark.createDataFrame([(1, "a", "b<", 0.5), (2, "c", "d", 0.25)], "window_id int, u string, v string, distance double")
    sinks.write_by_window(e, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).filter("window_id = 2").count() == 1
    sinks.write_csv(e, str(tmp_path / "c"))
    assert quotes.read_delimited(spark, str(tmp_path / "c"), "window_id int, u string, v string, distance double").count() == 2
    lines = [r["line"] for r in sinks.graphml(e, 1).orderBy("part", "line").collect()]
    assert lines[0].startswith("<?xml") and '<node id="b&lt;"/>' in lines and lines[-1] == "</graph></graphml>"
    assert sinks.union_rows([e, e.select("window_id")]).count() == 4
    (tmp_path / "edges_007.csv").write_text("source,target,weight,distance\na,b,1,2\n")
    assert quotes.read_edge_lists(spark, str(tmp_path / "edges_*.csv")).first()["window_id"] == 7
    path = str(tmp_path / "ingest")
    first = e.select(F.lit(day("2000-01-01")).alias("obs_date"), F.col("u").alias("ticker"), "distance")
    assert quotes.ingest(spark, path, first).count() == 2
    first.write.parquet(path)
    assert quotes.ingest(spark, path, first.limit(1).withColumn("distance", F.lit(9.0))).filter("distance = 9").count() == 1


def test_latex_and_rounding(spark):
    df = spark.createDataFrame([("b_1", 0.123456), ("a", None)], "name string, v double")
    text = statistics.latex_table(df, ["name", "v"], ["name"], "C", "l").first()["latex"]
    assert "a & -- \\\\\nb\\_1 & 0.1235 \\\\" in text
    assert rounded(spark.createDataFrame([(-1e-9,)], "x double")).first()["x"] == 0.0


def test_same_result_for_any_partitioning(spark):
    from tidemesh.plans import network_queries

    got = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(sorted(map(tuple, network_queries.g4_planar_graphs(spark, "/root/testdata/sf0.001").collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1] and got[0]


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
@pytest.mark.parametrize("name", ["r1_rolling_correlation", "g3_nearest_neighbours", "g2_minimum_spanning_trees"])
def test_rows_for_any_partitioning(spark, name, sf):
    from tidemesh.plans.base import QUERIES

    got = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(sorted(map(tuple, QUERIES[name](spark, f"/root/testdata/sf{sf}").collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1] and got[0]


def test_stream_agrees_with_batch(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(src)
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = rolling.read_events(spark, str(tmp_path / "in"), batch.schema)
    query = rolling.rolling_counts(stream, "10 minutes", "7 days", "1 day").writeStream.format("memory").queryName("rolled").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted(map(tuple, spark.table("rolled").select("start", "event_type", "events").collect()))
    want = sorted(map(tuple, rolling.rolling_counts(batch.withColumn("ts", F.col("ts").cast("timestamp")), None, "7 days", "1 day").select("start", "event_type", "events").collect()))
    assert got == want and got


def test_config_dimensions_and_log(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"a": {"b": {"c": 3}}, "tickers": {"x": ["A3", "B4"], "y": ["B4", "C11"]}}')
    c = config.load(str(tmp_path / "c.json"))
    assert config.get(c, "a.b.c") == 3 and config.get(c, "a.x.c", 0) == 0
    assert config.tickers(c, "todos") == ["A3", "B4", "C11"] and config.tickers(c, "none") == []
    dim = config.ticker_dimension(spark, {"A3": {"sigla": "A", "nome_pt": "Alfa", "aliases": ["AA"], "ceo_timeline": [{"nome": "P", "data_inicio": "2000-01-01"}, {"nome": "Q", "data_inicio": "1990-01-01", "data_fim": "2000-01-01"}]}, "A4": {"sigla": "A"}})
    timeline = dim.select("ticker", F.explode("timeline").alias("t")).select("ticker", "t.*")
    days = spark.createDataFrame([("A3", day("1999-12-31")), ("A3", day("2000-01-01")), ("A4", day("2005-01-01")), ("A4", day("1980-01-01"))], "ticker string, day date")
    got = {(r["ticker"], r["day"]): r["name"] for r in events.in_office(days, timeline, dim).collect()}
    assert got == {("A3", day("1999-12-31")): "Q", ("A3", day("2000-01-01")): "P", ("A4", day("2005-01-01")): "P", ("A4", day("1980-01-01")): None}
    assert scalars.search_dimension(dim, "aa").count() == 1 and scalars.search_dimension(dim, "a", "sigla").count() == 2
    assert config.legacy_map(spark, {"X": "Y"}).first()["present"] == "Y"
    assert config.event_calendar(spark, [{"shock_start": "2008-09-15"}], "s").first()["status"] == "configured"
    sinks.append_log(spark, str(tmp_path / "log"), "f", "success", 3)
    sinks.append_log(spark, str(tmp_path / "log"), "g", "failed", 0)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    assert sinks.zip_files(str(tmp_path), "*.json", str(tmp_path / "z.zip")) == 1
