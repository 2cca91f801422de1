"""Exact laws, surfaces, bundles, sources and sinks, each against brute force or a written-out case."""

import datetime as dt
import itertools
import math
import zipfile

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemesh.functions import scalars
from tidemesh.operators import correlation, graphs, kernels, relational, statistics
from tidemesh.sources import config, quotes, scratch, sinks


def test_exact_law_of_the_gap():
    for m, n in ((3, 3), (4, 5), (2, 6)):
        for h in range(1, m * n + 1):
            hit = 0
            for chosen in itertools.combinations(range(m + n), m):
                i = j = most = 0
                for s in range(m + n):
                    i, j = (i + 1, j) if s in chosen else (i, j + 1)
                    most = max(most, abs(i * n - j * m))
                hit += most >= h
            assert kernels.gap_sf(m, n, h) == pytest.approx(hit / math.comb(m + n, m))
    d, p = kernels.ks_two_sample(np.array([1.0, 2, 3]), np.array([4.0, 5, 6]))
    assert d == 1 and p == pytest.approx(0.1)
    big = kernels.gap_sf(400, 400, 40 * 400)
    assert big == pytest.approx(kernels.kolmogorov_sf(0.1 * math.sqrt(200)), rel=0.1)


def test_student_tail_in_both_forms(spark):
    t = [0.0, 0.3, 1.0, 2.5, 9.0]
    for df in (1, 2, 7, 50, 51):
        rows = spark.createDataFrame([(x,) for x in t], "t double").select("t", correlation.student_t_sf2(F.col("t"), F.lit(df)).alias("p")).collect()
        assert np.allclose([r["p"] for r in rows], kernels.student_sf2(np.array([r["t"] for r in rows]), df))


def test_splines_and_filters():
    x = np.random.default_rng(1).normal(size=(9, 4))
    fine = kernels._spline(x, 25)
    assert np.allclose(fine[::3], x)  # goes through the rows
    line = np.arange(9.0)[:, None]
    assert np.allclose(kernels._spline(np.ones((9, 1)), 30), 1) and np.allclose(kernels._spline(line, 9), line)
    z = kernels._reflected(x, 2.2)
    radius = 9
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / 2.2) ** 2)
    pad = np.pad(x, ((radius, radius), (0, 0)), mode="symmetric")
    want = [sum(w[k] * pad[i + k] for k in range(2 * radius + 1)) / w.sum() for i in range(9)]
    assert np.allclose(z, want)


def test_surface(spark):
    rows = [(r, c, float((r * 7 + c * 3) % 5)) for r in range(1, 8) for c in range(1, 6)]
    df = spark.createDataFrame(rows, "window_id int, point int, density double")
    out = kernels.smoothed_surface(df, "window_id", "point", "density").toPandas()
    assert out.window_id.max() == 21 and out.point.max() == 10 and len(out) == 210 and out.density.between(0, 5).all()
    flat = kernels.smoothed_surface(df.withColumn("density", F.lit(9.0)), "window_id", "point", "density").toPandas()
    assert np.allclose(flat.density, 5)


def corr_pairs(spark, n=7, seed=2):
    rho = np.corrcoef(np.random.default_rng(seed).normal(size=(n, 30)))
    return spark.createDataFrame([(1, f"A{i}", f"A{j}", float(rho[i, j]), float(math.sqrt(2 - 2 * rho[i, j]))) for i in range(n) for j in range(i + 1, n)], "window_id int, asset_1 string, asset_2 string, rho double, distance double"), rho


def test_dendrogram_groups(spark):
    p, rho = corr_pairs(spark)
    g = kernels.dendrogram_groups(p).toPandas().sort_values("node")
    assert sorted(g.place) == list(range(1, 8)) and g.community.nunique() == g.best_k.iloc[0]
    # Groups are contiguous along the leaves, and the cut is the best by silhouette.
    by_place = g.sort_values("place").community.tolist()
    assert sum(a != b for a, b in zip(by_place, by_place[1:])) == g.best_k.iloc[0] - 1
    d = kernels._euclid(rho)
    tree = kernels.linkage(d, "ward")
    assert g.silhouette.iloc[0] == pytest.approx(max(kernels.silhouette(d, kernels.cut_tree(tree, 7, k)) for k in range(2, 7)))
    two = kernels.dendrogram_groups(p.filter("asset_1 = 'A0' and asset_2 = 'A1'")).toPandas()
    assert two.best_k.tolist() == [2, 2] and two.silhouette.isna().all() and two.community.nunique() == 1


def test_window_bundle_agrees_with_its_parts(spark):
    p, _ = corr_pairs(spark, 5)
    rng = np.random.default_rng(4)
    day = dt.date(2000, 1, 3)
    rows = [(1, f"A{i}", day + dt.timedelta(days=k), float(x)) for i in range(5) for k, x in enumerate(rng.normal(size=30))] + [(2, "A0", day, 0.5)]
    returns = spark.createDataFrame(rows, "window_id int, asset string, obs_date date, log_return double")
    done = spark.createDataFrame([(1, "A0"), (1, "A3")], "window_id int, asset string")
    b = kernels.window_bundle(p, returns, done).toPandas()
    assert set(b.window_id) == {1}  # a window without pairs has no rows
    assert set(b[b.part == "adf"].name_1) == {"A1", "A2", "A4"}
    got = {(r.part, r.name_1, r.metric): r.value for r in b.itertuples()}
    obs = spark.createDataFrame([(1, 30)], "window_id int, n_obs int")
    mp = kernels.marchenko_pastur(p, obs).first()
    assert got["mp", None, "lambda_max"] == pytest.approx(mp["lambda_max"]) and got["mp", None, "n_signal"] == mp["n_signal"]
    ks = kernels.ks_against_noise(p, obs).first()
    assert got["ks", None, "ks_stat"] == pytest.approx(ks["ks_stat"]) and got["ks", None, "ks_pvalue"] == pytest.approx(ks["ks_pvalue"])
    for r in kernels.cross_method(p).collect():
        row = b[(b.part == "cross") & (b.name_1 == r["method"])].set_index("metric").value
        assert row["best_k"] == r["best_k"] and row["modularity"] == pytest.approx(r["modularity"])
    want = {(r["asset_1"], r["asset_2"]): r["pvalue"] for r in correlation.with_pvalues(p, F.lit(30)).collect()}
    pv = b[b.metric.eq("pvalue") & b.part.eq("pvalue")]
    assert len(pv) == 10 and all(want[r.name_1, r.name_2] == pytest.approx(r.value) for r in pv.itertuples())
    none = kernels.window_bundle(p, returns.filter("window_id = 9")).toPandas()
    assert none[(none.part == "mp") & (none.metric == "n_obs")].value.iloc[0] == 252


def test_short_windows_get_no_noise_band(spark):
    p, _ = corr_pairs(spark, 6)
    r = kernels.marchenko_pastur(p, spark.createDataFrame([(1, 4)], "window_id int, n_obs int")).first()
    assert r["lambda_plus"] is None and (r["n_signal"], r["n_noise"], r["signal_share"]) == (0, 6, 0.0)


def test_null_graphs_of_a_star(spark):
    star = spark.createDataFrame([(1, "a", x) for x in "bcdef"], "window_id int, u string, v string")
    g = kernels.null_graphs(star).toPandas()
    assert len(g[g.model == "random"]) == 5 and (g.u < g.v).all()
    assert set(map(tuple, g[g.model == "swapped"][["u", "v"]].to_numpy())) == {("a", x) for x in "bcdef"}  # no swap keeps a star simple


def test_densities_and_shares_by_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = [(k % 3, float(x)) for k, x in enumerate(np.r_[rng.uniform(0.3, 2.2, 400), 0.5, 2.0, 0.5 + 7 * (1.5 / 99)])] + [(0, None)]
    df = spark.createDataFrame(rows, "g int, x double")
    grid = [0.5 + k * (1.5 / 99) for k in range(100)]
    got = {(r["g"], r["point"]): r["ecdf"] for r in statistics.ecdf(df, ["g"], "x", 0.5, 2.0).collect()}
    for g in range(3):
        v = np.array([x for k, x in rows if k == g and x is not None])
        assert all(got[g, k + 1] == pytest.approx((v <= grid[k]).mean()) for k in range(100))
    d = {(r["g"], r["point"]): (r["grid"], r["density"]) for r in statistics.kernel_density(df, ["g"], "x").collect()}
    for g in range(3):
        v = np.array([x for k, x in rows if k == g and x is not None])
        h = v.std(ddof=1) * len(v) ** -0.2 * 1.6
        for k in (1, 100, 320):
            at, got_density = d[g, k]
            assert at == pytest.approx((k - 1) * 2 / 319)
            assert got_density == pytest.approx(np.exp(-(((at - v) / h) ** 2) / 2).sum() / (len(v) * h * math.sqrt(2 * math.pi)))


def test_plans_without_products_of_rows(spark):
    df = spark.createDataFrame([(1, 0.7)], "g int, x double")
    for out in (statistics.ecdf(df, ["g"], "x", 0.5, 2.0),):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_assemble_checks_keys_when_it_runs(spark):
    base = spark.createDataFrame([(1,), (2,)], "window_id int")
    good = spark.createDataFrame([(1, 5)], "window_id int, a int")
    assert sorted(map(tuple, relational.assemble(base, [good]).collect())) == [(1, 5), (2, None)]
    with pytest.raises(PySparkException):
        relational.assemble(base, [good.union(good)]).collect()


def test_guard_keeps_windows(spark):
    e = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (2, "a", "b")], "window_id int, u string, v string")
    m = spark.createDataFrame([(1, 0.5), (2, 0.25)], "window_id int, costly double")
    assert sorted(map(tuple, graphs.guarded(e, m, 1).collect())) == [(1, 2, None), (2, 1, 0.25)]


def test_names_searches_and_directions(spark):
    s = spark.createDataFrame([("Açúcar ñ PNC (N1) S/A",), ("ＡＢ Šḱoda unt",), (None,)], "c string").select(scalars.normalize_company(F.col("c"))).collect()
    assert [r[0] for r in s][0] == "ACUCAR N N1 S A" and s[2][0] == "" and "SKODA" in s[1][0]
    d = spark.createDataFrame([(1.0,), (-1.0,), (0.0,), (None,), (math.nan,)], "x double").select(scalars.direction(F.col("x"))).collect()
    assert [r[0] for r in d] == ["up", "down", "flat", "flat", "flat"]
    t = spark.createDataFrame([(r"a\b_{~}",)], "t string").select(scalars.latex_escape(F.col("t"))).first()[0]
    assert t == r"a\textbackslash{}b\_\{\textasciitilde{}\}"
    dim = config.ticker_dimension(spark, {"A3": {"sigla": "A", "nome_pt": "Alfa", "nome_en": "Alpha", "aliases": ["zeta"], "tipo": "principal", "ceo_timeline": [{"nome": "P", "data_inicio": "2000-01-01"}]}, "A4": {"sigla": "a", "tipo": "legacy", "aliases": ["alfa"]}})
    found = lambda *a: [r["ticker"] for r in scalars.search_dimension(dim, *a).orderBy("ticker").collect()]
    assert found("alfa") == ["A4"] and found("ALF", "name") == ["A3"] and found("alp", "name_en") == ["A3"] and found("a", "sigla") == ["A3", "A4"] and found("al", "sigla") == []
    with pytest.raises(ValueError):
        scalars.search_dimension(dim, "x", "other")
    assert [r["ticker"] for r in scalars.of_type(dim, "legacy").collect()] == ["A4"]
    assert {r["ticker"]: r["aliases"] for r in scalars.aliases_of(dim, False).collect()} == {"A3": ["zeta"], "A4": []}
    assert {r["ticker"]: len(r["timeline"]) for r in scalars.timelines(dim).collect()} == {"A3": 1, "A4": 1}


def test_resolution_by_brute_force(spark):
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("ABCDE"), rng.integers(2, 9)))
    cat = list({(f"{word()}{k}", word(), "PN") for k in range(25)})
    raw = [(f"zz{k}", x, "PN") for k, x in enumerate([word() for _ in range(60)] + [c[1][:-1] + "E" for c in cat if len(c[1]) > 3])]
    schema = "ticker string, company string, kind string"
    got = {r["ticker"]: r["resolved"] for r in scalars.resolve_ticker(spark.createDataFrame(raw, schema), spark.createDataFrame(cat, schema)).collect()}
    from difflib import SequenceMatcher

    def like(a, b):
        return 1.0 if a == b else 0.95 if b.startswith(a) else 0.9 if a.startswith(b) else SequenceMatcher(None, a, b).ratio()

    for ticker, company, _ in raw:
        same = [t for t, c, _ in cat if c == company]
        if len(same) == 1:
            want = same[0]
        else:
            scores = sorted(((like(company, c), t) for t, c, _ in cat), key=lambda x: (-x[0], x[1]))
            want = scores[0][1] if scores[0][0] >= 0.78 and scores[0][0] - scores[1][0] >= 0.12 else ticker
        assert got[ticker] == want or scores_near(scores, 0.75)


def scores_near(scores, least):
    """A next-best likeness under the threshold need not be found: pairs that share no two letters aren't compared."""
    return scores[0][0] >= 0.78 and scores[1][0] < least


def test_archives_and_years(spark, tmp_path):
    for name in ("COTAHIST_A1999.ZIP", "COTAHIST_A2000.ZIP", "COTAHIST_M012000.ZIP", "other.zip"):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("COTAHIST.A1999" if "1999" in name else "COTAHIST_A2000.TXT", "x")
            z.writestr("readme", "y")
    listed = quotes.list_archives(spark, str(tmp_path))
    assert listed.count() == 4 and sorted(r["year"] for r in quotes.cached_years(listed).collect()) == [1999, 2000]
    assert sorted(r["year"] for r in quotes.years_to_fetch(quotes.cached_years(listed), 1998, 2000).collect()) == [1998, 2000]
    assert quotes.record_members(["a.txt", "COTAHIST.A1999"]) == ["a.txt"] and quotes.record_members(["x", "COTAHIST.A1999"]) == ["COTAHIST.A1999"] and quotes.record_members(["q"]) == ["q"]
    with zipfile.ZipFile(tmp_path / "dfp.zip", "w") as z:
        z.writestr("dfp_con_2020.csv", "CNPJ;NOME;V\n1;AÇÚCAR;\n2;B;7\n".encode("latin-1"))
        z.writestr("dfp_ind_2020.csv", "CNPJ;NOME\n9;no\n")
    rows = quotes.read_zipped_delimited(spark, str(tmp_path / "dfp.zip"), "con", ["CNPJ", "NOME", "W"]).orderBy("CNPJ").collect()
    assert [tuple(r) for r in rows] == [("1", "AÇÚCAR", None), ("2", "B", None)]


def test_files_and_logs(spark, tmp_path):
    df = spark.createDataFrame([(k % 3, k) for k in range(40)], "window_id int, k int")
    assert sinks.write_csv_by_window(df, str(tmp_path / "p"), parts=2, max_records=5) == 5
    assert all(len(f.read_text().splitlines()) <= 6 for f in (tmp_path / "p").glob("*.csv"))
    sinks.merge_to_one(spark, str(tmp_path / "p"), str(tmp_path / "one"))
    files = list((tmp_path / "one").glob("*.csv"))
    assert len(files) == 1 and len(files[0].read_text().splitlines()) == 41
    with pytest.raises(ValueError):
        sinks.write_csv_by_window(df, str(tmp_path / "p"), attempts=0)
    assert sinks.fields_of([df, df.withColumn("z", F.lit(1))], ["k"]) == ["k", "window_id", "z"]
    typed = quotes.read_returns(spark, str(tmp_path / "one"), {"k": "int", "window_id": "double"})
    assert dict(typed.dtypes) == {"k": "int", "window_id": "double"} and typed.count() == 40
    sinks.append_log(spark, str(tmp_path / "log"), "a", "success", 3, "2000-01-01", "2000-02-01")
    sinks.append_log(spark, str(tmp_path / "log"), "b", "failed", 9)
    r = sinks.log_summary(spark.read.parquet(str(tmp_path / "log"))).first()
    assert (r["fetches"], r["failed"], r["total_rows"], r["last_day"]) == (2, 1, 3, dt.date(2000, 2, 1))
    assert scratch.folder(spark) != scratch.folder(spark)


def test_archives_are_packed_line_by_line(spark):
    """No task holds an archive's lines: they are sorted by Spark and written as they come."""
    import io
    import zipfile

    from pyspark.sql import functions as F
    from tidemesh.plans.panel_queries import _zipped

    rows = spark.range(25000).select((F.col("id") % 3).cast("int").alias("year"), F.when(F.col("id") % 2 == 0, F.lit(None)).otherwise(F.lit(7)).alias("month"), F.concat(F.lit("ção "), "id").alias("value"))
    made = _zipped(rows, ["year", "month"], "A.TXT")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
    found = {(r["year"], r["month"]): zipfile.ZipFile(io.BytesIO(r["content"])).read("A.TXT").decode("latin-1").split("\n") for r in made.collect()}
    want = {(y, m): sorted(f"ção {k}" for k in range(25000) if k % 3 == y and (k % 2 == 0) == (m is None)) for y in range(3) for m in (None, 7)}
    assert found == want
