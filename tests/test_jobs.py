"""The jobs: first runs, reruns, growing input, runs that are lost halfway."""

import datetime
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import rolling_correlations, vocabulary_network
from tidemesh.operators import calendar, correlation
from tidemesh.plans import base
from tidemesh.streaming import ingest

D = "/root/testdata/sf0.01"
ROOT = Path(__file__).resolve().parents[1]


def table(df):
    return sorted((r.window_id, r.window_start, r.window_end, r.asset_1, r.asset_2, r.observations, round(r.rho, 9), round(r.distance, 9)) for r in df.collect())


def expected(spark, trades):
    """The same from all trades at once, by the library's batch operators."""
    sums = rolling_correlations.sums_of(trades, spark.read.parquet(f"{D}/part.parquet"), "p_brand", "week")
    panel = sums.select("obs_date", "asset", (F.col("value") / F.col("quantity")).alias("close"))
    rows = base.cleaning.log_returns(panel, price="close", asset="asset", zero_missing=False)
    windows = calendar.month_windows(rows)
    pairs = correlation.distances(correlation.pair_correlations(calendar.assign_windows(rows, windows), ["window_id"]))
    return table(pairs.join(windows, "window_id"))


def files(folder):
    return {p.relative_to(folder): p.stat().st_mtime_ns for p in Path(folder).rglob("*.parquet")}


@pytest.fixture(scope="module")
def trades(spark):
    """Trades of two years and a half, in four parts: two years, the next quarter, the last one, and late ones of a month before."""
    rows = spark.read.parquet(f"{D}/lineitem.parquet").select("l_partkey", "l_shipdate", "l_extendedprice", "l_quantity").filter("l_shipdate < '1997-07-01'")
    late = (F.col("l_shipdate") >= "1996-11-01") & (F.col("l_shipdate") < "1996-12-01") & (F.col("l_partkey") % 3 == 0)
    early, mid = F.col("l_shipdate") < "1997-01-01", F.col("l_shipdate") < "1997-04-01"
    return [rows.filter(early & ~late), rows.filter(~early & mid), rows.filter(~mid), rows.filter(late)]


def run(spark, folder, **more):
    return rolling_correlations.run(spark, f"{folder}/in", f"{D}/part.parquet", f"{folder}/out", f"{folder}/checkpoint", **more)


def test_growing_input(spark, trades, tmp_path):
    trades[0].coalesce(2).write.parquet(f"{tmp_path}/in")
    first = table(run(spark, tmp_path))
    assert first == expected(spark, trades[0]) and len({r[0] for r in first}) == 12
    before = files(tmp_path / "out")
    assert table(run(spark, tmp_path)) == first and files(tmp_path / "out") == before

    trades[1].coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    both = trades[0].union(trades[1])
    assert table(run(spark, tmp_path)) == expected(spark, both)
    log = {r.batch_id: r.rows for r in spark.read.parquet(f"{tmp_path}/out/log").collect()}
    assert log == {0: trades[0].count(), 1: trades[1].count()}
    after = files(tmp_path / "out")
    kept = [p for p in before if p in after]
    # Windows that end before the new trades stay as they were; the panel of old months too.
    assert {str(p.parent) for p in kept if p.parts[0] == "correlations"} == {f"correlations/window_start={r[1]}" for r in first}
    assert all(after[p] == before[p] for p in kept)

    trades[3].coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    trades[2].coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    everything = both.union(trades[2]).union(trades[3])
    assert table(run(spark, tmp_path, files_per_batch=1)) == expected(spark, everything)
    assert spark.read.parquet(f"{tmp_path}/out/log").agg(F.sum("rows"), F.max("batch_id")).first()[:] == (everything.count(), 3)


@pytest.mark.parametrize("stage", ["log", "panel", "moments", "correlations", "mark"])
def test_a_lost_run_is_made_good(spark, trades, tmp_path, monkeypatch, stage):
    trades[0].coalesce(1).write.parquet(f"{tmp_path}/in")
    if stage == "panel":
        run(spark, tmp_path)
        trades[1].coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    real = ingest.overwrite_partitions
    seen = []

    def lost(df, path, *columns):
        real(df, path, *columns)
        seen.append(path.rpartition("/")[2])
        if {"log": "sums", "panel": "panel", "moments": "moments", "correlations": "correlations", "mark": "correlations"}[stage] == seen[-1]:
            raise RuntimeError("lost")

    for module in (ingest, rolling_correlations):
        monkeypatch.setattr(module, "overwrite_partitions", lost)
    with pytest.raises(Exception, match="lost"):
        run(spark, tmp_path)
    monkeypatch.undo()
    rows = trades[0].union(trades[1]) if stage == "panel" else trades[0]
    assert table(run(spark, tmp_path)) == expected(spark, rows)
    assert spark.read.parquet(f"{tmp_path}/out/log").agg(F.sum("rows")).first()[0] == rows.count()


def test_odd_trades(spark, tmp_path):
    day = datetime.datetime(1999, 1, 4)
    rows = [(1, day, 10.0, 1.0), (None, day, 1.0, 1.0), (2, None, 1.0, 1.0), (10**9, day, 1.0, 1.0), (1, day, None, None)]
    spark.createDataFrame(rows, "l_partkey long, l_shipdate timestamp_ntz, l_extendedprice double, l_quantity double").write.parquet(f"{tmp_path}/in")
    assert run(spark, tmp_path).count() == 0
    assert spark.read.parquet(f"{tmp_path}/out/panel").count() == 1
    assert run(spark, tmp_path).count() == 0


def test_a_missing_table_is_empty_but_a_broken_one_is_not(spark, tmp_path):
    assert ingest.read_table(spark, f"{tmp_path}/none", "a int").count() == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_text("no table")
    with pytest.raises(Exception, match="(?i)parquet"):
        ingest.read_table(spark, f"{tmp_path}/bad", "a int").count()


DOCS = [
    ("a", "x", "one one two two three three, THREE four"), ("a", "y", "One one two two two three three"), ("a", "z", "one one one two two three three five five"), ("a", "w", None),
    ("b", "x", "eins eins zwei zwei"), ("b", "y", ""), (None, "x", "lost"), ("c", None, "lost too"), ("b", "x", "éé ÉÉ ü ü 12 12"),
]


def test_vocabulary_network(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "lang string, source string, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(0))
    docs.write.parquet(f"{tmp_path}/in")
    out = vocabulary_network.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", neighbours=1)
    rows = {(r.lang, r.node, r.neighbour): r for r in out.collect()}
    assert {k[:2] for k in rows} == {("a", s) for s in "wxyz"} | {("b", "x"), ("b", "y")}
    assert rows["a", "w", None].vocabulary == 0 and rows["a", "w", None].degree == 0
    assert (rows["b", "x", None].documents, rows["b", "x", None].vocabulary, rows["b", "x", None].words) == (2, 4, 8)
    # x and z share three words, used 2:2:3 and 3:2:2.
    import numpy as np

    x, y, z = (np.log(np.array(v) * 1e6 / n) for v, n in (((2, 2, 3), 8), ((2, 3, 2), 7), ((3, 2, 2), 9)))
    rho = {("x", "y"): np.corrcoef(x, y)[0, 1], ("x", "z"): np.corrcoef(x, z)[0, 1], ("y", "z"): np.corrcoef(y, z)[0, 1]}
    for (lang, node, other), r in rows.items():
        if lang == "a" and other:
            assert r.shared_words == 3 and r.rho == pytest.approx(rho[min(node, other), max(node, other)])
    assert sum(1 for k in rows if k[0] == "a" and k[2]) in (4, 6)
    before = sorted(map(repr, rows.values()))
    again = vocabulary_network.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", neighbours=1)
    assert sorted(map(repr, again.collect())) == before


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], "lang string, source string, text string").write.parquet(f"{tmp_path}/in")
    assert vocabulary_network.run(spark, f"{tmp_path}/in", f"{tmp_path}/out").count() == 0


@pytest.mark.parametrize("job", ["rolling_correlations", "vocabulary_network"])
def test_command_lines(tmp_path, job):
    inputs = {"rolling_correlations": ["--trades", f"{D}/lineitem.parquet*", "--assets", f"{D}/part.parquet", "--checkpoint", f"{tmp_path}/c"], "vocabulary_network": ["--documents", f"{D}/documents.parquet"]}
    done = subprocess.run([sys.executable, "-m", f"jobs.{job}", *inputs[job], "--output", f"{tmp_path}/out"], cwd=ROOT, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    assert {"rolling_correlations": "the table has", "vocabulary_network": "wrote 80 sources"}[job] in done.stderr


def test_words_are_counted_once(spark, tmp_path):
    """The words of the texts are written, and the network is made of what was written; one plan reads the texts once."""
    from jobs import vocabulary_network

    rows = [("en", s, t) for s, t in (("a", "x x y y y z z"), ("b", "x x x y y z z z q"), ("c", None))] + [("it", "a", "u u")]
    spark.createDataFrame(rows, "lang string, source string, text string").write.parquet(f"{tmp_path}/in")
    plan = vocabulary_network.word_shares(spark.read.parquet(f"{tmp_path}/in"), 2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1
    vocabulary_network.run(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    words = spark.read.schema(vocabulary_network.WORDS).parquet(f"{tmp_path}/out/words").collect()
    assert sorted((r["lang"], r["asset"], r["word"], r["n"]) for r in words) == [("en", "a", "x", 2), ("en", "a", "y", 3), ("en", "a", "z", 2), ("en", "b", "x", 3), ("en", "b", "y", 2), ("en", "b", "z", 3), ("it", "a", "u", 2)]
