"""Queries that hold kernels to values which SQL finds by other means: trees by minimax paths, betweenness by path counts, eigenvectors by squared matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import brandes, graphs, kernels, relational, statistics
from ..sources import scratch
from .base import KNN, PAIRS, SQL, WINDOWED, pairs, query, rounded, windowed
from .network_queries import COMPONENTS, HOPS, LABELS, MOMENTS_SQL, RICCI, SPREAD_SQL, TRI, _labels, _moments_rounded, knn

#: The least greatest distance on any path between two assets, over paths of up to 32 edges: five doublings.
MINIMAX = PAIRS + """,
x0 AS (SELECT window_id, asset_1 AS i, asset_2 AS j, distance AS d FROM pairs UNION ALL SELECT window_id, asset_2, asset_1, distance FROM pairs)""" + "".join(
    f""",
x{k} AS (SELECT window_id, i, j, min(d) AS d FROM (SELECT * FROM x{k - 1} UNION ALL SELECT a.window_id, a.i, b.j, greatest(a.d, b.d) FROM x{k - 1} a JOIN x{k - 1} b ON a.window_id = b.window_id AND a.j = b.i WHERE a.i <> b.j) GROUP BY 1, 2, 3)"""
    for k in range(1, 6)
)


@query(f"WITH {MINIMAX} SELECT pairs.window_id, asset_1 AS u, asset_2 AS v, round(distance, 6) AS distance FROM pairs JOIN x5 ON x5.window_id = pairs.window_id AND i = asset_1 AND j = asset_2 WHERE distance <= d")
def g2_trees_by_minimax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pair is an edge of the minimum spanning tree exactly if no path between its ends stays below its distance."""
    return rounded(kernels.minimum_spanning_trees(graphs.complete(pairs(spark, sf_dir))).select("window_id", "u", "v", "distance"))


#: The same holds the query of whole trees.
SQL["g2_minimum_spanning_trees"] = SQL["g2_trees_by_minimax"].replace("round(distance, 6) AS distance", "round(distance, 6) AS distance, round(distance, 6) AS weight")


#: Numbers of shortest paths between all nodes, hop by hop, and betweenness from them.
PATHS = KNN + HOPS + """,
p1 AS (SELECT window_id, s, t, h, 1.0 AS c FROM h8 WHERE h = 1)""" + "".join(
    f""",
p{k} AS (SELECT p.window_id, p.s, me.other AS t, {k} AS h, sum(c) AS c FROM p{k - 1} p JOIN me ON me.window_id = p.window_id AND me.node = p.t JOIN h8 ON h8.window_id = p.window_id AND h8.s = p.s AND h8.t = me.other AND h8.h = {k} GROUP BY 1, 2, 3)"""
    for k in range(2, 9)
) + ", paths AS (" + " UNION ALL ".join(f"SELECT * FROM p{k}" for k in range(1, 9)) + """),
nn AS (SELECT window_id, count(*) AS n FROM deg GROUP BY 1),
bt AS (SELECT a.window_id, a.t AS node, sum(a.c * b.c / w.c) AS b FROM paths a JOIN paths b ON a.window_id = b.window_id AND a.t = b.s JOIN paths w ON w.window_id = a.window_id AND w.s = a.s AND w.t = b.t AND w.h = a.h + b.h GROUP BY 1, 2),
cl AS (SELECT window_id, s AS node, count(*) / sum(h) * count(*) AS c FROM h8 GROUP BY 1, 2),
ce AS (SELECT deg.window_id, deg.node, CAST(degree AS INT) AS degree, degree / (n - 1) AS degree_centrality, coalesce(b, 0) / ((n - 1) * (n - 2)) AS betweenness_centrality, c / (n - 1) AS closeness_centrality
       FROM deg JOIN nn USING (window_id) JOIN cl ON cl.window_id = deg.window_id AND cl.node = deg.node LEFT JOIN bt ON bt.window_id = deg.window_id AND bt.node = deg.node)"""  # fmt: skip


@query(f"WITH {PATHS} SELECT window_id, node, degree, round(degree_centrality, 6) AS degree_centrality, round(betweenness_centrality, 6) AS betweenness_centrality, round(closeness_centrality, 6) AS closeness_centrality FROM ce")
def g10_g11_spread_centralities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path centralities by ranges of sources, eight to a row of work."""
    return rounded(brandes.centralities(knn(spark, sf_dir), sources=8))


#: A + I squared ten times, each time scaled by its window's greatest entry; its rows' sums point along the leading eigenvector.
POWERS = """,
q0 AS (SELECT window_id, node AS i, other AS j, 1.0 AS x FROM me UNION ALL SELECT window_id, node, node, 1.0 FROM deg)""" + "".join(
    f""",
q{k} AS (SELECT window_id, i, j, x / max(x) OVER (PARTITION BY window_id) AS x FROM (SELECT a.window_id, a.i, b.j, sum(a.x * b.x) AS x FROM q{k - 1} a JOIN q{k - 1} b ON a.window_id = b.window_id AND a.j = b.i GROUP BY 1, 2, 3))"""
    for k in range(1, 11)
) + """,
ev AS (SELECT window_id, i AS node, x / sqrt(sum(x * x) OVER (PARTITION BY window_id)) AS e FROM (SELECT window_id, i, sum(x) AS x FROM q10 GROUP BY 1, 2))"""  # fmt: skip


@query(f"""WITH {PATHS}{POWERS} SELECT ce.window_id, ce.node, degree, round(degree_centrality, 6) AS degree_centrality, round(betweenness_centrality, 6) AS betweenness_centrality, round(closeness_centrality, 6) AS closeness_centrality, round(e, 6) + 0.0 AS eigenvector_centrality
FROM ce JOIN ev ON ev.window_id = ce.window_id AND ev.node = ce.node""")
def g12_g32_node_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All node metrics of the graphs of nearest neighbours; the power iteration runs until it stands still."""
    return rounded(kernels.centralities(knn(spark, sf_dir), tolerance=1e-14, rounds=20_000))


@query(f"""WITH {KNN}{COMPONENTS}{TRI}{RICCI}{HOPS}{LABELS},
b AS (SELECT window_id, count(*) AS n_nodes, avg(degree) AS mean_degree, max(degree) AS max_degree FROM deg GROUP BY 1), mm AS (SELECT window_id, count(*) AS n_edges, sum(weight) AS w FROM edges GROUP BY 1),
ct AS (SELECT window_id, avg(CASE WHEN k > 1 THEN t / (k * (k - 1) / 2.0) ELSE 0 END) AS mean_clustering, sum(t) / sum(k * (k - 1) / 2.0) AS transitivity FROM lc GROUP BY 1),
asr AS (SELECT me.window_id, covar_pop(x.degree, y.degree) / nullif(stddev_pop(x.degree) * stddev_pop(y.degree), 0) AS assortativity FROM me JOIN deg x ON x.window_id = me.window_id AND x.node = me.node JOIN deg y ON y.window_id = me.window_id AND y.node = me.other GROUP BY 1),
pl AS (SELECT window_id, avg(h) AS mean_path, CAST(max(h) AS INT) AS diameter FROM h8 GROUP BY 1),
rs AS (SELECT window_id, {MOMENTS_SQL.format(x='ricci', p='ricci')}, {SPREAD_SQL.format(x='ricci', p='ricci')} FROM ric GROUP BY 1),
ds AS (SELECT window_id, {MOMENTS_SQL.format(x='distance', p='dist')} FROM edges GROUP BY 1),
le AS (SELECT edges.*, x.community AS cu, y.community AS cv FROM edges JOIN lab x ON x.window_id = edges.window_id AND x.node = u JOIN lab y ON y.window_id = edges.window_id AND y.node = v),
ld AS (SELECT window_id, c, sum(weight) AS d FROM (SELECT window_id, unnest([cu, cv]) AS c, weight FROM le) GROUP BY 1, 2), li AS (SELECT window_id, cu AS c, sum(weight) AS i FROM le WHERE cu = cv GROUP BY 1, 2),
md AS (SELECT window_id, sum(coalesce(i, 0) / w - pow(d / (2 * w), 2)) AS modularity, count(*) AS n_communities FROM ld JOIN mm USING (window_id) LEFT JOIN li USING (window_id, c) GROUP BY 1)
SELECT b.window_id, n_nodes, round(mean_degree, 5) AS mean_degree, max_degree, n_edges, round(2.0 * n_edges / (n_nodes * (n_nodes - 1)), 5) AS density, n_components, largest_component, round(mean_clustering, 5) AS mean_clustering, round(transitivity, 5) AS transitivity,
       round(assortativity, 5) + 0.0 AS assortativity, round(mean_path, 5) AS mean_path, diameter, rs.* EXCLUDE (window_id), ds.* EXCLUDE (window_id), round(modularity, 5) + 0.0 AS modularity, n_communities
FROM b JOIN mm USING (window_id) JOIN cs USING (window_id) JOIN ct USING (window_id) JOIN asr USING (window_id) JOIN pl USING (window_id) JOIN rs USING (window_id) JOIN ds USING (window_id) JOIN md USING (window_id)""")
def g23_g33_bundle_of_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bundle of structural metrics in one row a window, here of the graphs of nearest neighbours; groups are digits of the assets' names."""
    e = scratch.checkpointed(knn(spark, sf_dir))
    tables = [graphs.component_sizes(graphs.components(e)), graphs.clustering(e), graphs.assortativity(e), kernels.path_lengths(e), graphs.ricci_statistics(e), graphs.distance_moments(e), graphs.modularity(e, _labels(e, 4))]
    return _moments_rounded(relational.assemble(graphs.basics(e), tables))


@query(f"""WITH {WINDOWED}, x AS (SELECT window_id, asset, log_return AS v, lag(log_return) OVER (PARTITION BY window_id, asset ORDER BY obs_date) AS p FROM win WHERE log_return IS NOT NULL),
r AS (SELECT window_id, asset, count(*) AS n, covar_pop(v - p, p) / var_pop(p) AS b, var_pop(v - p) AS syy, var_pop(p) AS sxx FROM x WHERE p IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 9)
SELECT window_id, asset, round(b / sqrt((syy - b * b * sxx) * n / (n - 2) / (n * sxx)), 5) AS adf_stat FROM r""")
def r10_unit_root_without_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Dickey-Fuller statistic with no lags: the t-value of a regression on the last value and a constant."""
    rows, _ = windowed(spark, sf_dir)
    tested = kernels.stationarity(rows, ["window_id", "asset"], "obs_date", "log_return", "window_id int, asset string", lags=0)
    return rounded(tested.filter("adf_stat is not null").select("window_id", "asset", "adf_stat"), 5)


@query(f"WITH {KNN} SELECT window_id, count(*) AS nodes, CAST(0 AS BIGINT) AS against_their_neighbours FROM deg GROUP BY 1")
def g20_labels_follow_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where label propagation ends, every node has a label that none of its neighbours' is more frequent than."""
    e = scratch.checkpointed(knn(spark, sf_dir))
    label = scratch.checkpointed(kernels.communities(e, "propagation"))
    near = graphs.mirrored(e).select("window_id", "node", "other").join(label.select("window_id", F.col("node").alias("other"), "community"), ["window_id", "other"]).groupBy("window_id", "node", "community").agg(F.count(F.lit(1)).alias("n"))
    most = near.groupBy("window_id", "node").agg(F.max("n").alias("most"))
    own = label.join(near, ["window_id", "node", "community"], "left").join(most, ["window_id", "node"])
    return own.groupBy("window_id").agg(F.count(F.lit(1)).alias("nodes"), F.count(F.when(F.coalesce("n", F.lit(0)) < F.col("most"), 1)).alias("against_their_neighbours"))


@query(f"""WITH {PAIRS} SELECT window_id, count(*) AS "values", round(quantile_cont(distance, 0.1), 6) AS q10, round(quantile_cont(distance, 0.25), 6) AS q25, round(median(distance), 6) AS q50, round(quantile_cont(distance, 0.75), 6) AS q75, round(quantile_cont(distance, 0.9), 6) AS q90,
round(quantile_cont(distance, 0.75) - quantile_cont(distance, 0.25), 6) AS iqr FROM pairs GROUP BY 1""")
def r16_selected_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of each window's distances by selection, for windows of more pairs than a buffer should hold."""
    d = scratch.checkpointed(pairs(spark, sf_dir).select("window_id", "distance"))
    q = statistics.selected_quantiles(d, ["window_id"], "distance", checkpoint=scratch.checkpointed)
    return rounded(q.withColumn("iqr", F.col("q75") - F.col("q25")))
