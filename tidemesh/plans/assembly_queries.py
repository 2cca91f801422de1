"""Queries of filters, lookups, assemblies and the drivers that combine operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import calendar, cleaning, correlation, events, graphs, kernels, layout, relational, statistics
from ..sources import panel as panels
from ..sources import quotes as files
from ..sources import scratch, sinks
from .base import KNN, PAIRS, RETURNS, WINDOWED, pairs, query, returns, rounded, windowed
from .network_queries import PVALS, RICCI, TRI, knn, metrics, observations, pvalues
from .panel_queries import COVER, MORE_WINDOWS, OFFICE, QUOTES, RAW, and_three_more, traded_windows


@query("SELECT CAST(o_orderdate AS DATE) AS obs_date, o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '1998-06-30'")
def p1_p2_date_column_and_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = panels.read(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("Data"), "o_orderkey")
    return relational.until(relational.standard_date(df), "1998-06-30")


@query(f"WITH {QUOTES} SELECT obs_date, ticker, close FROM quotes WHERE ticker IN ('BRAA3', 'BRAB4', 'BRZZ3') AND trim(ticker) <> ''")
def p3_p5_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = relational.non_empty(panels.quotes(spark, sf_dir), "ticker")
    return relational.members(q, "ticker", ["BRAA3", "BRAB4", "BRZZ3"]).select("obs_date", "ticker", "close")


@query("SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS found FROM customer")
def p4_found_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = panels.read(spark, sf_dir, "customer").select("c_custkey")
    return relational.membership_report(wanted, panels.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query(f"WITH {WINDOWED} SELECT obs_date, asset, round(log_return, 6) + 0.0 AS log_return FROM win WHERE window_id = 12 AND log_return IS NOT NULL")
def p6_p8_p9_one_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = windowed(spark, sf_dir)
    return rounded(relational.known_numbers(relational.one_window(rows, 12), ["asset"], ["log_return"]).select("obs_date", "asset", "log_return"))


@query(f"WITH {PAIRS} SELECT window_id, asset_1, asset_2, round(CASE WHEN distance > 1.4 THEN distance ELSE 0 END, 6) AS masked FROM pairs")
def p10_masked_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.when(F.col("distance") > 1.4, F.col("distance")).otherwise(-1.0)
    return rounded(pairs(spark, sf_dir).select("window_id", "asset_1", "asset_2", relational.masked_distance(d).alias("masked")))


@query(f"WITH {KNN} SELECT window_id, round(avg(distance), 5) + 0.0 AS dist_mean, round(stddev_samp(distance), 5) AS dist_std FROM edges GROUP BY 1")
def p11_metric_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = graphs.distance_moments(knn(spark, sf_dir))
    return rounded(m.select("window_id", *relational.metric_columns(m, ["_mean", "_std"])), 5)


@query(f"WITH {COVER} SELECT window_id, round(avg(c / d), 6) AS mean_cover FROM (SELECT tw.window_id, ticker, count(DISTINCT obs_date) AS c, any_value(window_days) AS d FROM tw JOIN wd USING (window_id) WHERE traded GROUP BY 1, 2) GROUP BY 1")
def j3_coverage_by_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    cover = cleaning.window_completeness(traded_windows(spark, sf_dir), ["ticker"])
    return rounded(cover.groupBy("window_id").agg(F.avg("ratio").alias("mean_cover")))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey % 2 = 0 UNION ALL SELECT o_orderkey, -1 FROM orders WHERE o_orderkey % 10 = 1 AND o_custkey % 2 = 1")
def j6_semi_or_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = panels.read(spark, sf_dir, "orders").select("o_orderkey", F.when(~((F.col("o_orderkey") % 10 == 1) & (F.col("o_custkey") % 2 == 1)), F.col("o_custkey")).alias("o_custkey"))
    keep = panels.read(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return relational.semi_or_null(o, keep, ["o_custkey"], "o_custkey").fillna({"o_custkey": -1})


@query(f"""WITH {WINDOWED}, {MORE_WINDOWS}, s AS (SELECT window_id, count(DISTINCT asset) AS assets FROM win GROUP BY 1 UNION ALL SELECT max(window_id) + 1, 1 FROM windows)
SELECT window_id, coalesce(assets, 0) AS assets, CASE WHEN coalesce(assets, 0) >= 2 THEN 1 ELSE 0 END AS modeled, CASE WHEN coalesce(assets, 0) >= 2 THEN 'ok' WHEN coalesce(assets, 0) = 0 THEN 'no data' ELSE 'too few' END AS model_reason FROM more LEFT JOIN s USING (window_id)""")
def j7_modeled_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All windows, and three that follow: the first of them is given one asset, the others have none."""
    rows, w = windowed(spark, sf_dir)
    stats = rows.groupBy("window_id").agg(F.countDistinct("asset").alias("assets")).unionByName(w.agg((F.max("window_id") + 1).alias("window_id"), F.lit(1).cast("long").alias("assets")))
    return relational.modeled(and_three_more(w).select("window_id"), stats, ["assets"])


@query(f"""WITH {KNN}{TRI} SELECT w.window_id, window_start, window_end, n_nodes, round(mean_degree, 6) AS mean_degree, round(dist_mean, 5) AS dist_mean, round(transitivity, 6) AS transitivity FROM windows w
LEFT JOIN (SELECT window_id, count(*) AS n_nodes, avg(degree) AS mean_degree FROM deg GROUP BY 1) USING (window_id) LEFT JOIN (SELECT window_id, avg(distance) AS dist_mean FROM edges GROUP BY 1) USING (window_id) LEFT JOIN (SELECT window_id, sum(t) / sum(k * (k - 1) / 2.0) AS transitivity FROM lc GROUP BY 1) USING (window_id)""")
def j10_e6_metric_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = knn(spark, sf_dir)
    w = calendar.month_windows(panels.dates(spark, sf_dir))
    out = relational.assemble(w, [graphs.basics(e).select("window_id", "n_nodes", "mean_degree"), graphs.distance_moments(e).select("window_id", "dist_mean"), graphs.clustering(e).select("window_id", "transitivity")])
    return out.select("window_id", "window_start", "window_end", "n_nodes", F.round("mean_degree", 6).alias("mean_degree"), F.round("dist_mean", 5).alias("dist_mean"), F.round("transitivity", 6).alias("transitivity"))


@query(f"""WITH {KNN}{RICCI}, r AS (SELECT window_id, avg(ricci) AS ricci_mean FROM ric GROUP BY 1), m AS (SELECT window_id, count(*) AS n_edges FROM edges GROUP BY 1)
SELECT window_id, n_edges, CASE WHEN window_id % 2 = 0 THEN round(ricci_mean, 5) + 0.0 END AS ricci_mean FROM m LEFT JOIN r USING (window_id)""")
def j11_g29_ricci_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old curvature columns give way to those computed from the stored edges, here of even windows."""
    e = knn(spark, sf_dir)
    old = e.groupBy("window_id").agg(F.count(F.lit(1)).alias("n_edges")).withColumn("ricci_mean", F.lit(-1.0))
    new = graphs.ricci_statistics(e.filter("window_id % 2 = 0")).select("window_id", "ricci_mean")
    return rounded(relational.replace_columns(old, new), 5)


@query(f"WITH {KNN} SELECT window_id, round(avg(degree), 6) AS mean_degree, CAST(max(degree) AS DOUBLE) AS max_degree FROM deg GROUP BY 1")
def j12_wide_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = graphs.degrees(knn(spark, sf_dir)).groupBy("window_id").agg(F.avg("degree").alias("mean_degree"), F.max("degree").alias("max_degree"))
    return rounded(relational.pivot_means(events.unpivot(d, ["window_id"], ["mean_degree", "max_degree"]), ["window_id"], ["mean_degree", "max_degree"]))


@query(f"WITH {KNN.replace(PAIRS, PVALS)} SELECT edges.window_id, u, v, CASE WHEN pvalue < 0.5 THEN round(pvalue, 6) + 0.0 END AS pvalue FROM edges JOIN pv ON pv.window_id = edges.window_id AND pv.asset_1 = u AND pv.asset_2 = v")
def j14_edge_pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored side has the pairs the other way round, and p-values over one half unknown."""
    p = pvalues(spark, sf_dir).select("window_id", F.col("asset_2").alias("asset_1"), F.col("asset_1").alias("asset_2"), F.when(F.col("pvalue") < 0.5, F.col("pvalue")).alias("pvalue"))
    return rounded(correlation.lookup_pvalues(knn(spark, sf_dir).select("window_id", "u", "v"), p))


@query(f"""WITH {WINDOWED}, {OFFICE}, tk AS (SELECT DISTINCT window_id, window_end, 'N' || regexp_extract(asset, '(\\d+)$', 1) AS ticker FROM win),
o AS (SELECT tk.ticker, window_end AS day, max_by(name, (start, name)) AS name FROM (SELECT DISTINCT ticker, window_end FROM tk) tk JOIN tl ON tk.ticker = tl.ticker AND start <= window_end AND ("end" IS NULL OR "end" > window_end) GROUP BY 1, 2)
SELECT window_id, window_end, tk.ticker, n_name AS full_name, CAST(2 AS INT) AS aliases_count, o.name AS in_office FROM tk JOIN nation ON tk.ticker = 'N' || n_nationkey LEFT JOIN o ON o.ticker = tk.ticker AND o.day = window_end""")
def j16_x12_window_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = windowed(spark, sf_dir)
    keys = rows.select("window_id", "window_end", F.concat(F.lit("N"), F.regexp_extract("asset", r"(\d+)$", 1)).alias("ticker"))
    c = panels.read(spark, sf_dir, "customer")
    start = F.date_add(F.lit("1995-01-01").cast("date"), (F.col("c_custkey") % 2000).cast("int"))
    tl = c.select(F.concat(F.lit("N"), "c_nationkey").alias("ticker"), F.col("c_name").alias("name"), start.alias("start"), F.when(F.col("c_custkey") % 3 != 0, F.date_add(start, 300)).alias("end"))
    dim = panels.read(spark, sf_dir, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("ticker"), F.col("n_name").alias("full_name"), F.array("n_name", F.lower("n_name")).alias("aliases"))
    who = events.in_office(keys.select("ticker", F.col("window_end").alias("day")), tl)
    return relational.window_context(keys, dim, who)


@query(f"""WITH {QUOTES}, b AS (SELECT min(obs_date) AS lo, max(obs_date) AS hi FROM quotes), k AS (SELECT CAST(unnest(generate_series(0, 400)) AS INT) AS k),
ow AS (SELECT k + 1 AS window_id, CAST(lo + to_months(k) AS DATE) AS s, CAST(lo + to_months(k + 12) AS DATE) AS e FROM b, k WHERE CAST(lo + to_months(k + 12) AS DATE) <= hi)
SELECT window_id, count(*) AS n, count(DISTINCT obs_date) AS days, count(DISTINCT ticker) AS tickers FROM quotes JOIN ow ON obs_date >= s AND obs_date < e GROUP BY 1""")
def a21_half_open_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = panels.quotes(spark, sf_dir)
    rows = calendar.in_half_open(q, calendar.offset_windows(q))
    return rows.groupBy("window_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("obs_date").alias("days"), F.countDistinct("ticker").alias("tickers"))


@query(f"WITH {RAW} SELECT obs_date, ticker, max(volume) AS volume FROM raw GROUP BY 1, 2")
def a19_keep_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.keep_largest(panels.raw_quotes(spark, sf_dir), ["obs_date", "ticker"], "volume", "price").select("obs_date", "ticker", "volume")


@query(f"WITH {QUOTES} SELECT obs_date, ticker, last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY obs_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled_close FROM quotes")
def a2_forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.traded_days(panels.quotes(spark, sf_dir)).select("obs_date", "ticker", "filled_close")


@query("SELECT p_partkey, regexp_replace(p_brand, '\\.SA$', '') AS symbol, greatest(coalesce(NULLIF(p_size, 1), 2), 1e-9) AS strength, ['Forman–Ricci geometric diagnostic', 'raw PMFG distance context', 'mesoscopic structural diagnostic', 'size-conditioned centrality residual', 'correlation-matrix validation diagnostic', 'correlation-matrix spectral diagnostic'][p_partkey % 6 + 1] AS kind FROM part")
def x7_x16_x17_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panels.read(spark, sf_dir, "part")
    name = F.element_at(F.array(*map(F.lit, ("ricci_fr_mean", "dist_std", "num_communities", "planar_degree_residual", "ks_stat", "lambda_max"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    s = scalars.plot_strength(F.nullif(F.col("p_size"), F.lit(1)).cast("double"), F.lit(2.0))
    return p.select("p_partkey", scalars.display_symbol(F.concat("p_brand", F.lit(".SA"))).alias("symbol"), s.alias("strength"), scalars.metric_kind(name).alias("kind"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS year_month, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start, CAST(CAST(o_orderdate AS DATE) - INTERVAL 6 MONTH AS DATE) AS half_year_before FROM orders")
def x19_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, d = panels.read(spark, sf_dir, "orders"), F.col("o_orderdate").cast("date")
    return o.select("o_orderkey", scalars.year_month(d).alias("year_month"), F.trunc(d, "MM").alias("month_start"), F.add_months(d, -6).alias("half_year_before"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(ln(l_quantity), 6) + 0.0 AS ln_q, round(ln(1 + l_tax), 6) + 0.0 AS log1p_tax, round(sqrt(abs(l_discount - l_tax)), 6) AS root, least(greatest(l_quantity, 10), 40) AS clipped, sign(l_discount - l_tax) + 0.0 AS sgn FROM lineitem")
def x14_x20_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("l_discount") - F.col("l_tax")
    out = panels.read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.ln("l_quantity").alias("ln_q"), F.log1p("l_tax").alias("log1p_tax"), F.sqrt(F.abs(d)).alias("root"), F.least(F.greatest("l_quantity", F.lit(10.0)), F.lit(40.0)).alias("clipped"), F.signum(d).alias("sgn")
    )
    return rounded(out)


@query("SELECT c_mktsegment, round(avg(CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END), 4) + 0.0 AS mean FROM customer GROUP BY 1")
def r13_mean_of_readable(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("c_custkey") % 10 == 0, "NaN").when(F.col("c_custkey") % 10 == 5, "n/a").otherwise(F.col("c_acctbal").cast("string"))
    return rounded(panels.read(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(relational.mean_numeric(text).alias("mean")), 4)


@query(f"WITH {RETURNS} SELECT asset, count(*) AS n, count(log_return) AS known, round(sum(log_return), 5) + 0.0 AS total, round(stddev_samp(log_return), 6) AS std, min(obs_date) AS first_day, max(obs_date) AS last_day, round(median(log_return), 6) + 0.0 AS median FROM ret GROUP BY 1")
def r12_group_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = returns(spark, sf_dir).groupBy("asset").agg(F.count(F.lit(1)).alias("n"), F.count("log_return").alias("known"), F.sum("log_return").alias("total"), F.stddev_samp("log_return").alias("std"), F.min("obs_date").alias("first_day"), F.max("obs_date").alias("last_day"), F.median("log_return").alias("median"))
    return r.select("asset", "n", "known", (F.round("total", 5) + F.lit(0.0)).alias("total"), F.round("std", 6).alias("std"), "first_day", "last_day", (F.round("median", 6) + F.lit(0.0)).alias("median"))


@query(f"""WITH {PVALS}, g AS (SELECT window_id, asset_1 AS u, asset_2 AS v FROM pv WHERE pvalue < 0.05), a AS (SELECT DISTINCT window_id, asset FROM win)
SELECT a.window_id, a.asset AS node, (SELECT count(*) FROM g WHERE g.window_id = a.window_id AND (u = a.asset OR v = a.asset)) AS degree FROM a""")
def g6_filtered_graph_with_isolates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees in the significance-filtered graph; assets without an edge stay, with 0."""
    rows, _ = windowed(spark, sf_dir)
    d = graphs.degrees(graphs.threshold(pvalues(spark, sf_dir))).select("window_id", "node", "degree")
    return rows.select("window_id", F.col("asset").alias("node")).distinct().join(d, ["window_id", "node"], "left").fillna(0, ["degree"])


@query(f"WITH {PAIRS} SELECT count(*) AS n, round(avg(rho), 6) + 0.0 AS mean, round(avg(distance), 6) + 0.0 AS mean_distance FROM pairs")
def j19_s10_pair_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix written as delimited text; typed scan of the pairs, untyped scan and cast of the distances."""
    path = scratch.folder(spark)
    sinks.write_csv(pairs(spark, sf_dir).select("window_id", "asset_1", "asset_2", "rho", "distance"), path)
    typed = files.read_delimited(spark, path, "window_id int, asset_1 string, asset_2 string, rho double, distance double").agg(F.count(F.lit(1)).alias("n"), F.avg("rho").alias("mean"))
    cast = files.read_returns(spark, path, {"window_id": "int", "distance": "double"}).agg(F.avg("distance").alias("mean_distance"))
    return rounded(typed.crossJoin(cast))


@query(f"WITH {KNN} SELECT window_id, u AS source, v AS target, round(weight, 6) AS weight, round(distance, 6) AS distance FROM edges")
def s11_edge_list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge lists in one folder a window; the window comes from the path."""
    path = scratch.folder(spark)
    e = knn(spark, sf_dir).select("window_id", F.col("u").alias("source"), F.col("v").alias("target"), "weight", "distance")
    e.repartition("window_id").write.partitionBy("window_id").option("header", True).csv(path)
    return rounded(files.read_edge_lists(spark, f"{path}/window_id=*", r"window_id=(\d+)/"))


@query(f"WITH {PAIRS} SELECT window_id, count(*) AS pairs, round(sum(rho), 5) + 0.0 AS total FROM pairs GROUP BY 1")
def s23_files_of_bounded_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs written window by window in files of at most 5,000 rows, made one file, and read back."""
    parts, one = scratch.folder(spark), scratch.folder(spark)
    sinks.write_csv_by_window(pairs(spark, sf_dir).select("window_id", "asset_1", "asset_2", "rho"), parts, parts=8, max_records=5_000)
    sinks.merge_to_one(spark, parts, one)
    back = files.read_delimited(spark, one, "window_id int, asset_1 string, asset_2 string, rho double")
    return rounded(back.groupBy("window_id").agg(F.count(F.lit(1)).alias("pairs"), F.sum("rho").alias("total")), 5)


@query("SELECT o_orderkey, 'N' || c_nationkey AS ticker, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey < 12")
def j5_keep_and_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of the customers chosen, their customer's name replaced by the nation's code."""
    o = panels.read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("company"), F.concat(F.lit("C"), "o_custkey").alias("ticker"), "o_totalprice")
    choice = panels.read(spark, sf_dir, "customer").filter("c_nationkey < 12").select(F.col("c_custkey").alias("company"), F.concat(F.lit("N"), "c_nationkey").alias("canonical"))
    return relational.keep_and_remap(o, choice, ["company"], "ticker", "canonical").select("o_orderkey", "ticker", "o_totalprice")


@query(None)
def g23_g33_metric_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All structural metrics of each window's planar graph in one row."""
    e = scratch.checkpointed(kernels.planar_graphs(graphs.complete(pairs(spark, sf_dir))))
    labels = kernels.communities(e)
    tables = [graphs.component_sizes(graphs.components(e)), graphs.clustering(e), graphs.assortativity(e), kernels.path_lengths(e), graphs.ricci_statistics(e), graphs.distance_moments(e), graphs.modularity(e, labels)]
    return rounded(relational.assemble(graphs.basics(e), tables))


@query(None)
def g32_node_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node metrics, null in graphs that are too heavy, with size-adjusted means per window beside."""
    e = scratch.checkpointed(kernels.planar_graphs(graphs.complete(pairs(spark, sf_dir))))
    light = kernels.centralities(e.join(graphs.light_windows(e), "window_id"))
    costly = [x for x in light.columns if x not in ("window_id", "node", "degree", "degree_centrality")]
    c = graphs.degrees(e).join(light.select("window_id", "node", *costly), ["window_id", "node"], "left")
    per = c.groupBy("window_id").agg(F.count(F.lit(1)).alias("n_nodes"), F.avg("betweenness_centrality").alias("betweenness_mean"))
    return rounded(c.join(statistics.size_adjusted(per, "betweenness_mean").select("window_id", "residual"), "window_id"))


@query(None)
def c7_grouped_dendrogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each asset's place in the window's dendrogram and its group in the best cut."""
    return rounded(kernels.dendrogram_groups(pairs(spark, sf_dir)))


NODES = "nn AS (SELECT window_id, count(DISTINCT x) AS n FROM (SELECT window_id, asset_1 AS x FROM pairs UNION ALL SELECT window_id, asset_2 FROM pairs) GROUP BY 1)"


@query(f"WITH {PAIRS}, {NODES} SELECT window_id, n AS assets, n * (n + 1) // 2 AS places, true AS groups_as_cut, true AS k_in_range FROM nn")
def c7_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places are 1 to n, each once; there are as many groups as the cut says, 2 to 8."""
    g = kernels.dendrogram_groups(pairs(spark, sf_dir)).groupBy("window_id").agg(F.countDistinct("place").alias("assets"), F.sum("place").alias("places"), F.countDistinct("community").alias("_k"), F.max("best_k").alias("_best"))
    return g.select("window_id", "assets", "places", (F.col("_k") == F.col("_best")).alias("groups_as_cut"), F.col("_best").between(2, 8).alias("k_in_range"))


@query(f"WITH {PAIRS}, {NODES} SELECT window_id, CAST(n AS INT) AS node_rows, CAST(least(n, 5) AS INT) AS groups, CAST(n - 1 AS INT) AS merges, CAST(n AS INT) AS last_size, true AS heights_rise, 3 AS methods, true AS best_in_range FROM nn")
def c1_c2_c8_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average clusters hold every asset in five groups; Ward's merges end in one of all, at rising heights; each method's best cut is in range."""
    p = pairs(spark, sf_dir)
    a = kernels.clusters(p).groupBy("window_id").agg(F.countDistinct("node").cast("int").alias("node_rows"), F.countDistinct("community").cast("int").alias("groups"))
    step = Window.partitionBy("window_id").orderBy("step")
    b = kernels.ward_merges(p).withColumn("_up", F.coalesce(F.col("height") >= F.lag("height").over(step) - 1e-9, F.lit(True)))
    b = b.groupBy("window_id").agg(F.count(F.lit(1)).cast("int").alias("merges"), F.max_by("size", "step").cast("int").alias("last_size"), F.every("_up").alias("heights_rise"))
    c = kernels.cross_method(p).groupBy("window_id").agg(F.countDistinct("method").cast("int").alias("methods"), F.every(F.col("best_k").between(2, 10)).alias("best_in_range"))
    return a.join(b, "window_id").join(c, "window_id")


#: Both Gaussian filters over a grid of windows by points, edges reflected, written out as sums.
SURFACE = """,
grid AS (SELECT dense_rank() OVER (ORDER BY window_id) - 1 AS r, point - 1 AS c, density FROM kd),
sz AS (SELECT max(r) + 1 AS nr, max(c) + 1 AS nc FROM grid),
wr AS (SELECT d, exp(-0.5 * pow(d / 2.2, 2)) / sum(exp(-0.5 * pow(d / 2.2, 2))) OVER () AS w FROM (SELECT unnest(generate_series(-9, 9)) AS d)),
wc AS (SELECT d, exp(-0.5 * pow(d / 2.8, 2)) / sum(exp(-0.5 * pow(d / 2.8, 2))) OVER () AS w FROM (SELECT unnest(generate_series(-11, 11)) AS d)),
pr AS (SELECT r, d, w, CASE WHEN j < nr THEN j ELSE 2 * nr - 1 - j END AS j FROM (SELECT r, d, w, nr, ((r + d) % (2 * nr) + 2 * nr) % (2 * nr) AS j FROM (SELECT DISTINCT r FROM grid), wr, sz)),
s1 AS (SELECT pr.r, g.c, sum(w * density) AS z FROM pr JOIN grid g ON g.r = pr.j GROUP BY 1, 2),
pc AS (SELECT c, d, w, CASE WHEN j < nc THEN j ELSE 2 * nc - 1 - j END AS j FROM (SELECT c, d, w, nc, ((c + d) % (2 * nc) + 2 * nc) % (2 * nc) AS j FROM (SELECT DISTINCT c FROM grid), wc, sz)),
s2 AS (SELECT s1.r, pc.c, sum(w * z) AS z FROM pc JOIN s1 ON s1.c = pc.j GROUP BY 1, 2)"""


@query(f"""WITH {PAIRS}, t AS (SELECT least(2.0, greatest(max(distance), 1.8)) AS top FROM pairs), g AS (SELECT CAST(k + 1 AS INT) AS point, k * top / 319 AS grid FROM t, (SELECT unnest(generate_series(0, 319)) AS k)),
b AS (SELECT window_id, count(*) AS n, stddev_samp(distance) * pow(count(*), -0.2) * 1.6 AS h FROM pairs GROUP BY 1),
kd AS (SELECT window_id, point, sum(exp(-pow((grid - distance) / h, 2) / 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())) AS density FROM pairs JOIN b USING (window_id), g GROUP BY 1, 2){SURFACE}
SELECT CAST(r + 1 AS INT) AS window_id, CAST(c + 1 AS INT) AS point, round(least(greatest(z, 0), 5), 5) + 0.0 AS density FROM s2""")
def r29_smoothed_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The densities of all windows as one surface, smoothed along time and distance and clipped; not refined, which SQL can't check."""
    d = statistics.kernel_density(pairs(spark, sf_dir), ["window_id"], "distance")
    return rounded(kernels.smoothed_surface(d, "window_id", "point", "density", zoom=(1, 1)), 5)


@query(None)
def r29_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surface as the figure shows it, three by two times as fine."""
    return rounded(kernels.smoothed_surface(statistics.kernel_density(pairs(spark, sf_dir), ["window_id"], "distance"), "window_id", "point", "density"))


@query(f"WITH {PAIRS}, {NODES} SELECT window_id, n - 1 AS tree_edges, 3 * n - 6 AS planar_edges, round(2.0 * (n - 1) / n, 6) AS tree_degree, round(2.0 * (3 * n - 6) / n, 6) AS planar_degree, true AS tree_is_lighter, 0.0 AS tree_clustering FROM nn")
def g31_tree_and_planar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each window's tree beside its planar graph."""
    e = graphs.complete(pairs(spark, sf_dir))
    out = {}
    for name, g in (("tree", scratch.checkpointed(kernels.minimum_spanning_trees(e))), ("planar", scratch.checkpointed(kernels.planar_graphs(e)))):
        m = g.groupBy("window_id").agg(F.count(F.lit(1)).alias(f"{name}_edges"), F.avg("distance").alias(f"{name}_mean"))
        out[name] = m.join(graphs.basics(g).select("window_id", F.col("mean_degree").alias(f"{name}_degree")), "window_id").join(graphs.clustering(g).select("window_id", F.col("mean_clustering").alias(f"{name}_clustering")), "window_id")
    both = out["tree"].join(out["planar"], "window_id").withColumn("tree_is_lighter", F.col("tree_mean") <= F.col("planar_mean"))
    return rounded(both.select("window_id", "tree_edges", "planar_edges", "tree_degree", "planar_degree", "tree_is_lighter", "tree_clustering"))


@query("SELECT n_nationkey, '\\begin{figure}[htbp]' || chr(10) || '\\centering' || chr(10) || '\\includegraphics[width=\\linewidth]{f' || n_nationkey || '.png}' || chr(10) || '\\caption{' || n_name || '}' || chr(10) || '\\label{fig:' || n_nationkey || '}' || chr(10) || '\\end{figure}' || chr(10) AS block FROM nation")
def s27_figure_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = panels.read(spark, sf_dir, "nation")
    block = relational.figure_block(F.concat(F.lit("f"), "n_nationkey", F.lit(".png")), F.col("n_name"), F.concat(F.lit("fig:"), "n_nationkey"))
    return n.select("n_nationkey", block.alias("block"))


@query("SELECT c_custkey, c_name, c_nationkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def j4_j5_dimension_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left joins along a chain of dimensions; small ones are broadcast if their size allows."""
    c, n, r = (panels.read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    out = c.join(n, c["c_nationkey"] == n["n_nationkey"], "left").join(r, n["n_regionkey"] == r["r_regionkey"], "left")
    return out.select("c_custkey", "c_name", "c_nationkey", "n_name", "r_name")


@query(f"WITH {PVALS} SELECT window_id, CAST(floor(least(pvalue, 0.999999) * 20) AS INT) AS bin, count(*) AS count FROM pv GROUP BY 1, 2")
def f2_pvalue_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table behind the p-value figure."""
    p = pvalues(spark, sf_dir).withColumn("p", F.least("pvalue", F.lit(0.999999)))
    return p.groupBy("window_id", F.floor(F.col("p") * 20).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))


@query(None)
def f3_network_drawing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table behind network figures: nodes with position, size, community and curvature group."""
    e = scratch.checkpointed(kernels.planar_graphs(graphs.complete(pairs(spark, sf_dir))))
    keys = ["window_id", "node"]
    return rounded(layout.node_layout(e).join(kernels.communities(e), keys).join(graphs.ricci_groups(e).select(*keys, "group"), keys))


@query(f"""WITH {PVALS}{KNN[len(PAIRS):]}
SELECT e.window_id, u, v, round(e.distance, 6) AS distance, round(pvalue, 6) + 0.0 AS pvalue, round((0.8 + 2.6 * least(1 / e.distance, 1.8)) * 1.12, 6) AS width, CASE WHEN pvalue < 0.05 THEN 'solid' ELSE 'dashed' END AS style
FROM edges e LEFT JOIN pv ON pv.window_id = e.window_id AND pv.asset_1 = u AND pv.asset_2 = v""")
def f3_network_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of network figures, here of the graphs of nearest neighbours: width by distance, style by significance."""
    return rounded(layout.edge_lines(knn(spark, sf_dir), pvalues(spark, sf_dir)))


@query(f"""WITH {KNN}, n AS (SELECT window_id, count(*) AS nodes, CAST(max(degree) AS INT) AS max_degree FROM deg GROUP BY 1)
SELECT window_id, nodes, max_degree, 1.3 AS right, -1.3 AS "left", true AS apart, true AS hubs_are_large FROM n""")
def f3_layout_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawing fills its box, no two nodes are nearer than 0.08, and a node of the greatest degree has at least its share of size."""
    at = scratch.checkpointed(layout.node_layout(knn(spark, sf_dir)))
    a, b = at.select("window_id", "node", "x", "y"), at.select("window_id", F.col("node").alias("other"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    near = a.join(b, "window_id").filter("node < other").groupBy("window_id").agg((F.min(F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2"))) > 0.08).alias("apart"))
    hub = F.max_by("size", "degree") >= layout.SCALE * (layout.LEAST_SIZE + layout.SIZE_RANGE * layout.DEGREE_SHARE) - 1e-9
    out = at.groupBy("window_id").agg(F.count(F.lit(1)).alias("nodes"), F.max("degree").alias("max_degree"), F.max("x").alias("right"), F.min("x").alias("left"), hub.alias("hubs_are_large"))
    return rounded(out.join(near, "window_id"))
