"""Queries of correlations, statistics, graphs, clusters, null tests and event studies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calendar, correlation, events, graphs, kernels, monthly, statistics
from ..sources import panel as panels
from ..sources import scratch, sinks
from .base import KNN, PAIRS, WINDOWED, pairs, query, returns, rounded, windowed


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monthly.window_observations(returns(spark, sf_dir), calendar.month_windows(panels.dates(spark, sf_dir)))


def knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs of each node's 5 nearest."""
    return graphs.nearest_neighbours(graphs.complete(pairs(spark, sf_dir)))


# Correlations.


@query(f"WITH {PAIRS} SELECT window_id, asset_1, asset_2, observations, round(rho, 6) + 0.0 AS rho, round(distance, 6) AS distance FROM pairs")
def r1_rolling_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pairs(spark, sf_dir))


@query(f"""WITH {PAIRS}, a AS (SELECT window_id, count(DISTINCT x) AS assets FROM (SELECT window_id, asset_1 AS x FROM pairs UNION ALL SELECT window_id, asset_2 FROM pairs) GROUP BY 1)
SELECT window_id, any_value(assets) AS assets, count(rho) AS pairs, round(avg(rho), 6) + 0.0 AS rho_mean, round(median(rho), 6) + 0.0 AS rho_median, round(stddev_pop(rho), 6) AS rho_std, round(min(rho), 6) AS rho_min, round(max(rho), 6) AS rho_max,
       round(quantile_cont(rho, 0.25), 6) + 0.0 AS rho_q25, round(quantile_cont(rho, 0.75), 6) + 0.0 AS rho_q75 FROM pairs JOIN a USING (window_id) GROUP BY 1""")
def r4_correlation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(correlation.correlation_stats(pairs(spark, sf_dir), ["window_id"]))


def pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir).join(observations(spark, sf_dir), "window_id")
    return correlation.with_pvalues(p, F.col("n_obs"))


#: Student's tail for even degrees of freedom as a finite sum is checked by its own series in SQL: a list product per term.
PVALS = PAIRS + """,
nobs AS (SELECT window_id, max(n) AS n_obs FROM (SELECT window_id, asset, count(log_return) AS n FROM win GROUP BY 1, 2) GROUP BY 1),
tv AS (SELECT pairs.*, n_obs, CAST(greatest(n_obs - 2, 1) AS INT) AS df, atan(abs(rho) * sqrt(greatest(n_obs - 2, 1) / greatest(1 - rho * rho, 1e-12)) / sqrt(greatest(n_obs - 2, 1))) AS a FROM pairs JOIN nobs USING (window_id)),
ks AS (SELECT df, k, sum(ln(CASE WHEN df % 2 = 1 THEN 2.0 * j / (2 * j + 1) ELSE (2.0 * j - 1) / (2 * j) END)) AS lc
       FROM (SELECT DISTINCT df FROM tv) d, (SELECT unnest(generate_series(1, 200)) AS k) g, (SELECT unnest(generate_series(1, 200)) AS j) h WHERE j <= k GROUP BY 1, 2
       UNION ALL SELECT DISTINCT df, 0, 0.0 FROM tv),
pv AS (SELECT window_id, asset_1, asset_2, any_value(rho) AS rho, any_value(distance) AS distance,
              greatest(1 - abs(CASE WHEN any_value(tv.df) % 2 = 1 THEN 2 / pi() * (any_value(a) + sin(any_value(a)) * coalesce(sum(exp(lc) * pow(cos(a), 2 * k + 1)) FILTER (WHERE k < (tv.df - 1) // 2), 0))
                       ELSE sin(any_value(a)) * coalesce(sum(exp(lc) * pow(cos(a), 2 * k)) FILTER (WHERE k < tv.df // 2), 0) END), 0) AS pvalue
       FROM tv JOIN ks ON tv.df = ks.df GROUP BY 1, 2, 3)"""


@query(f"WITH {PVALS} SELECT window_id, asset_1, asset_2, round(pvalue, 6) + 0.0 AS pvalue FROM pv")
def r5_pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pvalues(spark, sf_dir).select("window_id", "asset_1", "asset_2", "pvalue"))


@query(f"WITH {PVALS} SELECT window_id, n_obs FROM nobs")
def r7_window_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir)


@query(f"WITH {PVALS} SELECT window_id, asset_1 AS u, asset_2 AS v, round(abs(rho), 6) AS weight FROM pv WHERE pvalue < 0.05")
def p7_g7_significant_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graphs.threshold(correlation.significant(pvalues(spark, sf_dir)), weight="rho")
    return rounded(g.select("window_id", "u", "v", "weight"))


@query(f"""WITH {PVALS}, g AS (SELECT window_id, asset_1, asset_2 FROM pv WHERE pvalue < 0.05), n AS (SELECT window_id, count(DISTINCT x) AS nodes FROM (SELECT window_id, asset_1 AS x FROM g UNION ALL SELECT window_id, asset_2 FROM g) GROUP BY 1), e AS (SELECT window_id, count(*) AS edges FROM g GROUP BY 1)
SELECT count(*) AS windows, round(avg(edges), 6) AS mean_edges, max(edges) AS max_edges, max(nodes) AS max_nodes, max(edges * nodes) AS max_cost, CASE WHEN max(edges) > 10000 THEN 'skip' WHEN max(edges) > 2000 THEN 'sample' ELSE 'full' END AS advice FROM e JOIN n USING (window_id)""")
def r30_workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.network_workload(pvalues(spark, sf_dir)))


STATS_SQL = """round(avg({x}), 6) + 0.0 AS mean, round(median({x}), 6) + 0.0 AS median, round(stddev_pop({x}), 6) AS std, round(min({x}), 6) AS min, round(max({x}), 6) AS max, round(quantile_cont({x}, 0.25), 6) AS q25, round(quantile_cont({x}, 0.75), 6) AS q75,
round(quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25), 6) AS iqr, round(stddev_pop({x}) / avg({x}), 6) AS cv"""


@query(f"""WITH {PAIRS}, m AS (SELECT window_id, min(distance) AS lo, max(distance) AS hi, avg(distance) AS mu, stddev_pop(distance) AS sd FROM pairs GROUP BY 1),
z AS (SELECT window_id, round(avg(pow((distance - mu) / sd, 3)), 5) + 0.0 AS skewness, round(avg(pow((distance - mu) / sd, 4)) - 3, 5) + 0.0 AS kurtosis FROM pairs JOIN m USING (window_id) GROUP BY 1),
h AS (SELECT window_id, -sum(p * log2(p)) AS entropy FROM (SELECT window_id, b, count(*) / sum(count(*)) OVER (PARTITION BY window_id) AS p FROM (SELECT window_id, least(floor((distance - lo) / ((hi - lo) / 20)), 19) AS b FROM pairs JOIN m USING (window_id)) GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT window_id, {STATS_SQL.format(x='distance')} FROM pairs GROUP BY 1)
SELECT s.*, skewness, kurtosis, round(entropy, 5) AS entropy FROM s JOIN z USING (window_id) JOIN h USING (window_id)""")
def r17_distance_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = statistics.distance_statistics(pairs(spark, sf_dir), ["window_id"])
    fine = ("skewness", "kurtosis", "entropy")
    return d.select(*[(F.round(c, 5 if c in fine else 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in d.dtypes])


@query(f"""WITH {PAIRS}, b AS (SELECT window_id, CAST(least(floor((rho + 1) / 0.05), 39) AS INT) AS bin FROM pairs) SELECT window_id, bin, count(*) AS count FROM b GROUP BY 1, 2""")
def f1_correlation_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table behind a histogram figure."""
    return statistics.histogram(pairs(spark, sf_dir), ["window_id"], "rho", -1.0, 1.0, 40)


@query(f"""WITH {PAIRS}, g AS (SELECT CAST(unnest(generate_series(1, 100)) AS INT) AS point)
SELECT window_id, point, round(0.5 + (point - 1) * (1.5 / 99), 6) AS grid, round(avg(CASE WHEN distance <= 0.5 + (point - 1) * (1.5 / 99) THEN 1.0 ELSE 0.0 END), 6) AS ecdf FROM pairs, g GROUP BY 1, 2""")
def r27_ecdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.ecdf(pairs(spark, sf_dir), ["window_id"], "distance", 0.5, 2.0))


@query(f"""WITH {PAIRS}, t AS (SELECT least(2.0, greatest(max(distance), 1.8)) AS top FROM pairs), g AS (SELECT CAST(k + 1 AS INT) AS point, k * top / 319 AS grid FROM t, (SELECT unnest(generate_series(0, 319)) AS k)),
b AS (SELECT window_id, count(*) AS n, stddev_samp(distance) * pow(count(*), -0.2) * 1.6 AS h FROM pairs GROUP BY 1)
SELECT window_id, point, round(any_value(grid), 6) AS grid, round(sum(exp(-pow((grid - distance) / h, 2) / 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 6) + 0.0 AS density FROM pairs JOIN b USING (window_id), g GROUP BY 1, 2""")
def r28_kernel_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.kernel_density(pairs(spark, sf_dir), ["window_id"], "distance"))


@query(f"""WITH {PAIRS}, t AS (SELECT least(2.0, greatest(max(distance), 1.8)) AS top FROM pairs), g AS (SELECT CAST(k + 1 AS INT) AS point, k * top / 319 AS grid FROM t, (SELECT unnest(generate_series(0, 319)) AS k)),
b AS (SELECT window_id, count(*) AS n, stddev_samp(distance) * pow(count(*), -0.2) * 1.6 AS h FROM pairs GROUP BY 1),
kd AS (SELECT window_id, point, any_value(grid) AS grid, sum(exp(-pow((grid - distance) / h, 2) / 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())) AS density FROM pairs JOIN b USING (window_id), g GROUP BY 1, 2),
w AS (SELECT d, exp(-0.5 * pow(d / 1.2, 2)) / sum(exp(-0.5 * pow(d / 1.2, 2))) OVER () AS w FROM (SELECT unnest(generate_series(-5, 5)) AS d)),
pl AS (SELECT point, w, CASE WHEN j < 320 THEN j ELSE 639 - j END + 1 AS j FROM (SELECT point, w, ((point - 1 + d) % 640 + 640) % 640 AS j FROM g, w)),
s AS (SELECT k.window_id, pl.point, sum(w * k.density) AS smoothed FROM pl JOIN kd k ON k.point = pl.j GROUP BY 1, 2)
SELECT kd.window_id, kd.point, round(grid, 6) AS grid, round(density, 6) + 0.0 AS density, round(smoothed, 6) + 0.0 AS smoothed FROM kd JOIN s ON kd.window_id = s.window_id AND kd.point = s.point""")
def r28_smoothed_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.smooth(statistics.kernel_density(pairs(spark, sf_dir), ["window_id"], "distance"), ["window_id"], "density", "point"))


# Graphs.


@query(f"WITH {KNN} SELECT window_id, u, v, round(distance, 6) AS distance FROM edges")
def g3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(knn(spark, sf_dir).select("window_id", "u", "v", "distance"))


@query(f"WITH {PAIRS} SELECT window_id, count(*) AS n_edges, CASE WHEN count(*) <= 30000 THEN round(avg(distance), 6) + 0.0 END AS dist_mean, CASE WHEN count(*) <= 299 THEN round(avg(distance), 6) + 0.0 END AS guarded_mean FROM pairs GROUP BY 1")
def g1_g13_complete_graph_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All windows stay; a costly metric is null over the limit, here the usual one and one of 299 edges."""
    e = graphs.complete(pairs(spark, sf_dir))
    m = graphs.distance_moments(e).select("window_id", "dist_mean")
    low = graphs.guarded(e, m.withColumnRenamed("dist_mean", "guarded_mean"), 299)
    return rounded(graphs.guarded(e, m).join(low.drop("n_edges"), "window_id"))


@query(f"WITH {KNN} SELECT window_id, node, degree, round(degree / (count(*) OVER (PARTITION BY window_id) - 1), 6) AS degree_centrality FROM deg")
def g9_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graphs.degrees(knn(spark, sf_dir)))


COMPONENTS = """,
reach AS (SELECT node, window_id, least(node, min(other)) AS c FROM me GROUP BY 1, 2),
r2 AS (SELECT me.node, me.window_id, least(min(a.c), min(b.c)) AS c FROM me JOIN reach a ON a.window_id = me.window_id AND a.node = me.other JOIN reach b ON b.window_id = me.window_id AND b.node = me.node GROUP BY 1, 2),
r3 AS (SELECT me.node, me.window_id, least(min(a.c), min(b.c)) AS c FROM me JOIN r2 a ON a.window_id = me.window_id AND a.node = me.other JOIN r2 b ON b.window_id = me.window_id AND b.node = me.node GROUP BY 1, 2),
r4 AS (SELECT me.node, me.window_id, least(min(a.c), min(b.c)) AS c FROM me JOIN r3 a ON a.window_id = me.window_id AND a.node = me.other JOIN r3 b ON b.window_id = me.window_id AND b.node = me.node GROUP BY 1, 2),
r5 AS (SELECT me.node, me.window_id, least(min(a.c), min(b.c)) AS c FROM me JOIN r4 a ON a.window_id = me.window_id AND a.node = me.other JOIN r4 b ON b.window_id = me.window_id AND b.node = me.node GROUP BY 1, 2),
comp AS (SELECT me.node, me.window_id, least(min(a.c), min(b.c)) AS component FROM me JOIN r5 a ON a.window_id = me.window_id AND a.node = me.other JOIN r5 b ON b.window_id = me.window_id AND b.node = me.node GROUP BY 1, 2),
cs AS (SELECT window_id, count(*) AS n_components, max(n) AS largest_component FROM (SELECT window_id, component, count(*) AS n FROM comp GROUP BY 1, 2) GROUP BY 1)"""


@query(f"""WITH {KNN}{COMPONENTS}, b AS (SELECT window_id, count(*) AS n_nodes, avg(degree) AS mean_degree, max(degree) AS max_degree FROM deg GROUP BY 1), m AS (SELECT window_id, count(*) AS n_edges FROM edges GROUP BY 1)
SELECT window_id, n_nodes, n_edges, round(mean_degree, 6) AS mean_degree, max_degree, round(2.0 * n_edges / (n_nodes * (n_nodes - 1)), 6) AS density, n_components, largest_component FROM b JOIN m USING (window_id) JOIN cs USING (window_id)""")
def g8_basics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = knn(spark, sf_dir)
    return rounded(graphs.basics(e).join(graphs.component_sizes(graphs.components(e)), "window_id"))


@query(f"""WITH {KNN}{COMPONENTS}, b AS (SELECT window_id, count(*) AS n_nodes FROM deg GROUP BY 1), m AS (SELECT window_id, count(*) AS n_edges FROM edges GROUP BY 1)
SELECT window_id, n_nodes, n_edges, n_components = 1 AS connected, n_components = 1 AND n_edges = n_nodes - 1 AS tree, true AS density_ok, CAST(0 AS BIGINT) AS weight_mismatches FROM b JOIN m USING (window_id) JOIN cs USING (window_id)""")
def g5_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = knn(spark, sf_dir)
    return graphs.validate(e, graphs.components(e))


TRI = """,
tri AS (SELECT a.window_id, a.u AS a, a.v AS b, b.v AS c FROM edges a JOIN edges b ON a.window_id = b.window_id AND a.v = b.u JOIN edges d ON d.window_id = a.window_id AND d.u = a.u AND d.v = b.v),
tn AS (SELECT window_id, node, count(*) AS t FROM (SELECT window_id, unnest([a, b, c]) AS node FROM tri) GROUP BY 1, 2),
lc AS (SELECT deg.window_id, degree AS k, coalesce(t, 0) AS t FROM deg LEFT JOIN tn ON deg.window_id = tn.window_id AND deg.node = tn.node)"""


@query(f"WITH {KNN}{TRI} SELECT window_id, round(avg(CASE WHEN k > 1 THEN t / (k * (k - 1) / 2.0) ELSE 0 END), 6) AS mean_clustering, round(sum(t) / sum(k * (k - 1) / 2.0), 6) AS transitivity FROM lc GROUP BY 1")
def g14_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graphs.clustering(knn(spark, sf_dir)))


@query(f"WITH {KNN} SELECT me.window_id, round(covar_pop(a.degree, b.degree) / nullif(stddev_pop(a.degree) * stddev_pop(b.degree), 0), 6) + 0.0 AS assortativity FROM me JOIN deg a ON a.window_id = me.window_id AND a.node = me.node JOIN deg b ON b.window_id = me.window_id AND b.node = me.other GROUP BY 1")
def g15_assortativity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graphs.assortativity(knn(spark, sf_dir)))


#: Curvature written out over neighbouring edges, not by the identity that the operator uses.
RICCI = """,
nb AS (SELECT e.window_id, e.u, e.v, e.weight AS w, sum(1 / sqrt(e.weight * o.weight)) AS s FROM edges e JOIN me o ON o.window_id = e.window_id AND ((o.node = e.u AND o.other <> e.v) OR (o.node = e.v AND o.other <> e.u)) GROUP BY 1, 2, 3, 4),
ric AS (SELECT e.window_id, e.u, e.v, e.weight * (2 / e.weight - coalesce(nb.s, 0)) AS ricci FROM edges e LEFT JOIN nb ON nb.window_id = e.window_id AND nb.u = e.u AND nb.v = e.v)"""


@query(f"WITH {KNN}{RICCI} SELECT window_id, u, v, round(ricci, 5) + 0.0 AS ricci FROM ric")
def g17_forman_ricci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graphs.forman_ricci(knn(spark, sf_dir)).select("window_id", "u", "v", "ricci"), 5)


MOMENTS_SQL = "round(avg({x}), 5) + 0.0 AS {p}_mean, round(var_samp({x}), 5) AS {p}_var, round(stddev_samp({x}), 5) AS {p}_std, round(skewness({x}), 4) + 0.0 AS {p}_skew, round(kurtosis({x}), 4) + 0.0 AS {p}_kurt"
SPREAD_SQL = "round(quantile_cont({x}, 0.1), 5) + 0.0 AS {p}_q10, round(quantile_cont({x}, 0.5), 5) + 0.0 AS {p}_q50, round(quantile_cont({x}, 0.9), 5) + 0.0 AS {p}_q90, round(quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25), 5) AS {p}_iqr, round(min({x}), 5) AS {p}_min, round(max({x}), 5) AS {p}_max"


def _moments_rounded(df: DataFrame) -> DataFrame:
    return df.select(*[(F.round(c, 4 if c.endswith(("_skew", "_kurt")) else 5) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(f"WITH {KNN}{RICCI} SELECT window_id, {MOMENTS_SQL.format(x='ricci', p='ricci')}, {SPREAD_SQL.format(x='ricci', p='ricci')} FROM ric GROUP BY 1")
def g17_r15_r16_ricci_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moments_rounded(graphs.ricci_statistics(knn(spark, sf_dir)))


@query(f"WITH {KNN} SELECT window_id, {MOMENTS_SQL.format(x='distance', p='dist')} FROM edges GROUP BY 1")
def g18_distance_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moments_rounded(graphs.distance_moments(knn(spark, sf_dir)))


@query(f"""WITH {KNN}{RICCI}, sc AS (SELECT window_id, node, avg(ricci) AS score FROM (SELECT window_id, unnest([u, v]) AS node, ricci FROM ric) GROUP BY 1, 2), ct AS (SELECT window_id, quantile_cont(score, 0.33) AS a, quantile_cont(score, 0.66) AS b FROM sc GROUP BY 1)
SELECT window_id, node, round(score, 5) + 0.0 AS score, CASE WHEN score <= a THEN 'low' WHEN score <= b THEN 'mid' ELSE 'high' END AS "group" FROM sc JOIN ct USING (window_id)""")
def g28_ricci_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graphs.ricci_groups(knn(spark, sf_dir)), 5)


LABELS = ", lab AS (SELECT window_id, node, CAST(regexp_extract(node, '(\\d+)$', 1) AS INT) % 4 AS community FROM deg), lab2 AS (SELECT window_id, node, CAST(regexp_extract(node, '(\\d+)$', 1) AS INT) % 3 AS community FROM deg)"


def _labels(edges: DataFrame, k: int) -> DataFrame:
    return graphs.degrees(edges).select("window_id", "node", (F.regexp_extract("node", r"(\d+)$", 1).cast("int") % k).alias("community"))


@query(f"""WITH {KNN}{LABELS}, e AS (SELECT edges.*, a.community AS cu, b.community AS cv FROM edges JOIN lab a ON a.window_id = edges.window_id AND a.node = u JOIN lab b ON b.window_id = edges.window_id AND b.node = v),
m AS (SELECT window_id, sum(weight) AS m FROM edges GROUP BY 1), d AS (SELECT window_id, c, sum(weight) AS d FROM (SELECT window_id, unnest([cu, cv]) AS c, weight FROM e) GROUP BY 1, 2), i AS (SELECT window_id, cu AS c, sum(weight) AS i FROM e WHERE cu = cv GROUP BY 1, 2)
SELECT window_id, round(sum(coalesce(i, 0) / m - pow(d / (2 * m), 2)), 6) + 0.0 AS modularity, count(*) AS n_communities FROM d JOIN m USING (window_id) LEFT JOIN i USING (window_id, c) GROUP BY 1""")
def g21_modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = knn(spark, sf_dir)
    return rounded(graphs.modularity(e, _labels(e, 4)))


@query(f"""WITH {KNN}{LABELS}, t AS (SELECT a.window_id, a.community AS x, b.community AS y, count(*) AS n FROM lab a JOIN lab2 b ON a.window_id = b.window_id AND a.node = b.node GROUP BY 1, 2, 3),
rx AS (SELECT window_id, x, sum(n) AS n FROM t GROUP BY 1, 2), ry AS (SELECT window_id, y, sum(n) AS n FROM t GROUP BY 1, 2), al AS (SELECT window_id, sum(n) AS m, sum(n * (n - 1) / 2) AS ij FROM t GROUP BY 1),
sx AS (SELECT window_id, sum(n * (n - 1) / 2) AS i, -sum(n / m * ln(n / m)) AS h FROM rx JOIN al USING (window_id) GROUP BY 1), sy AS (SELECT window_id, sum(n * (n - 1) / 2) AS j, -sum(n / m * ln(n / m)) AS h FROM ry JOIN al USING (window_id) GROUP BY 1),
mi AS (SELECT t.window_id, sum(t.n / m * ln(t.n * m / (rx.n * ry.n))) AS mi FROM t JOIN rx USING (window_id, x) JOIN ry USING (window_id, y) JOIN al USING (window_id) GROUP BY 1)
SELECT window_id, round((ij - i * j / (m * (m - 1) / 2)) / ((i + j) / 2 - i * j / (m * (m - 1) / 2)), 6) + 0.0 AS ari, round(mi / ((sx.h + sy.h) / 2), 6) + 0.0 AS nmi FROM al JOIN sx USING (window_id) JOIN sy USING (window_id) JOIN mi USING (window_id)""")
def c4_c5_g22_partition_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = knn(spark, sf_dir)
    return rounded(graphs.partition_agreement(_labels(e, 4), _labels(e, 3), ["window_id"]))


@query(f"WITH {KNN}{LABELS} SELECT lab.window_id, lab.community, lab2.community AS sector, count(*) AS count, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY lab.window_id, lab.community), 6) AS pct FROM lab JOIN lab2 ON lab.window_id = lab2.window_id AND lab.node = lab2.node GROUP BY 1, 2, 3")
def c6_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = knn(spark, sf_dir)
    sectors = _labels(e, 3).select(F.col("window_id").alias("_w"), "node", F.col("community").alias("sector"))
    return rounded(graphs.composition(_labels(e, 4), sectors.select("node", "sector").distinct(), ["window_id"]))


@query(f"""WITH {PAIRS}, p AS (SELECT window_id, asset_1 AS a, asset_2 AS b, distance AS d FROM pairs UNION ALL SELECT window_id, asset_2, asset_1, distance FROM pairs),
q AS (SELECT *, CAST(regexp_extract(a, '(\\d+)$', 1) AS INT) % 4 AS ca, CAST(regexp_extract(b, '(\\d+)$', 1) AS INT) % 4 AS cb FROM p), m AS (SELECT window_id, a, ca, cb, avg(d) AS d FROM q GROUP BY 1, 2, 3, 4),
i AS (SELECT window_id, a, max(d) FILTER (WHERE ca = cb) AS i, min(d) FILTER (WHERE ca <> cb) AS o FROM m GROUP BY 1, 2)
SELECT window_id, round(avg(CASE WHEN i IS NULL THEN 0 ELSE (o - i) / greatest(i, o) END), 6) + 0.0 AS silhouette FROM i GROUP BY 1""")
def c3_silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = graphs.complete(pairs(spark, sf_dir))
    both = correlation.symmetric(pairs(spark, sf_dir).select("window_id", "asset_1", "asset_2", "distance"), ["distance"]).toDF("window_id", "a", "b", "d")
    return rounded(graphs.silhouette(both, _labels(p, 4), ["window_id"]))


@query(None)
def g2_minimum_spanning_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(kernels.minimum_spanning_trees(graphs.complete(pairs(spark, sf_dir))))


@query(None)
def g4_planar_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(kernels.planar_graphs(graphs.complete(pairs(spark, sf_dir))))


@query(f"WITH {PAIRS}, n AS (SELECT window_id, count(DISTINCT x) AS n FROM (SELECT window_id, asset_1 AS x FROM pairs UNION ALL SELECT window_id, asset_2 FROM pairs) GROUP BY 1) SELECT window_id, n - 1 AS tree_edges, n - 1 AS shared_edges, 3 * n - 6 AS planar_edges FROM n")
def g2_g4_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A spanning tree has n - 1 edges, all of them in the planar graph, which has 3n - 6."""
    e = scratch.checkpointed(graphs.complete(pairs(spark, sf_dir)))
    t, p = scratch.checkpointed(kernels.minimum_spanning_trees(e)), scratch.checkpointed(kernels.planar_graphs(e))
    keys = ["window_id", "u", "v"]
    count = lambda x, name: x.groupBy("window_id").agg(F.count(F.lit(1)).alias(name))
    return count(t, "tree_edges").join(count(t.select(*keys).join(p.select(*keys), keys), "shared_edges"), "window_id").join(count(p, "planar_edges"), "window_id")


@query(None)
def g10_g11_g12_centralities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(kernels.centralities(kernels.planar_graphs(graphs.complete(pairs(spark, sf_dir)))))


HOPS = """,
h1 AS (SELECT window_id, node AS s, other AS t, 1 AS h FROM me),
h2 AS (SELECT window_id, s, t, min(h) AS h FROM (SELECT * FROM h1 UNION ALL SELECT h1.window_id, s, other, 2 FROM h1 JOIN me ON me.window_id = h1.window_id AND me.node = t WHERE other <> s) GROUP BY 1, 2, 3),
h4 AS (SELECT window_id, s, t, min(h) AS h FROM (SELECT * FROM h2 UNION ALL SELECT a.window_id, a.s, b.t, a.h + b.h FROM h2 a JOIN h2 b ON a.window_id = b.window_id AND a.t = b.s WHERE a.s <> b.t) GROUP BY 1, 2, 3),
h8 AS (SELECT window_id, s, t, min(h) AS h FROM (SELECT * FROM h4 UNION ALL SELECT a.window_id, a.s, b.t, a.h + b.h FROM h4 a JOIN h4 b ON a.window_id = b.window_id AND a.t = b.s WHERE a.s <> b.t) GROUP BY 1, 2, 3)"""


@query(f"WITH {KNN}{HOPS} SELECT window_id, round(avg(h), 6) AS mean_path, CAST(max(h) AS INT) AS diameter FROM h8 GROUP BY 1")
def g16_path_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(kernels.path_lengths(knn(spark, sf_dir)))


@query(f"WITH {KNN}{HOPS} SELECT window_id, s AS node, round(count(*) / sum(h) * count(*) / (any_value(n) - 1), 6) AS closeness_centrality FROM h8 JOIN (SELECT window_id, count(*) AS n FROM deg GROUP BY 1) USING (window_id) GROUP BY 1, 2")
def g11_closeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(kernels.centralities(knn(spark, sf_dir)).select("window_id", "node", "closeness_centrality"))


@query(f"""WITH {KNN}{HOPS}, n AS (SELECT window_id, count(*) AS n FROM deg GROUP BY 1)
SELECT window_id, n AS nodes, round(sum(h - 1) / ((n - 1) * (n - 2)), 6) + 0.0 AS betweenness_sum, 1.0 AS eigenvector_norm, round(sum(CASE WHEN h = 1 THEN 1 END) / (n - 1), 6) AS degree_sum FROM h8 JOIN n USING (window_id) GROUP BY 1, 2""")
def g10_g12_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Betweenness adds up to the pairs' inner path lengths over all pairs; eigenvector centrality has length one."""
    c = kernels.centralities(knn(spark, sf_dir)).groupBy("window_id")
    out = c.agg(F.count(F.lit(1)).alias("nodes"), F.sum("betweenness_centrality").alias("betweenness_sum"), F.round(F.sum(F.pow("eigenvector_centrality", F.lit(2.0))), 4).alias("eigenvector_norm"), F.sum("degree_centrality").alias("degree_sum"))
    return rounded(out)


@query(f"""WITH {KNN}{COMPONENTS} SELECT comp.window_id, count(*) AS nodes, true AS louvain_covers, true AS louvain_is_modular, true AS propagation_covers, true AS labels_within_components FROM comp GROUP BY 1""")
def g19_g20_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both methods label every node; Louvain's labels beat one community for all; propagated labels don't cross components."""
    e = knn(spark, sf_dir)
    n = graphs.degrees(e).groupBy("window_id").agg(F.count(F.lit(1)).alias("nodes"))
    a, b = kernels.communities(e), kernels.communities(e, "propagation")
    q = graphs.modularity(e, a).select("window_id", (F.col("modularity") > 0).alias("louvain_is_modular"))
    crossing = b.join(graphs.components(e), ["window_id", "node"]).groupBy("window_id", "community").agg(F.countDistinct("component").alias("_c")).groupBy("window_id").agg((F.max("_c") == 1).alias("labels_within_components"))
    count = lambda x, name: x.groupBy("window_id").agg(F.countDistinct("node").alias(name))
    out = n.join(count(a, "_a"), "window_id").join(count(b, "_b"), "window_id").join(q, "window_id").join(crossing, "window_id")
    return out.select("window_id", "nodes", (F.col("_a") == F.col("nodes")).alias("louvain_covers"), "louvain_is_modular", (F.col("_b") == F.col("nodes")).alias("propagation_covers"), "labels_within_components")


@query(f"""WITH {KNN}, m AS (SELECT window_id, count(*) AS m FROM edges GROUP BY 1), n AS (SELECT window_id, count(*) AS n, sum(degree) AS s FROM deg GROUP BY 1)
SELECT window_id, n AS nodes, m AS random_edges, true AS random_is_simple, true AS degrees_stay, m AS swapped_edges, true AS stubs_suffice, true AS configuration_is_simple FROM m JOIN n USING (window_id)""")
def g25_g26_g27_null_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A random graph of each null model beside the window's own: as many edges, the same degrees, and at most those of the stubs."""
    e = knn(spark, sf_dir)
    drawn = kernels.null_graphs(e)
    key = ["window_id", "model"]
    per = drawn.groupBy(*key).agg(F.count(F.lit(1)).alias("m"), F.countDistinct("u", "v").alias("_d"), F.every(F.col("u") < F.col("v")).alias("_no_loops"))
    per = per.withColumn("simple", (F.col("m") == F.col("_d")) & F.col("_no_loops"))
    degree = drawn.filter("model = 'swapped'").select("window_id", F.explode(F.array("u", "v")).alias("node")).groupBy("window_id", "node").agg(F.count(F.lit(1)).alias("_k"))
    same = graphs.degrees(e).join(degree, ["window_id", "node"], "left").groupBy("window_id").agg(F.count(F.lit(1)).alias("nodes"), F.every(F.col("degree") == F.col("_k")).alias("degrees_stay"), (F.sum("degree") / 2).alias("_m"))
    of = lambda name: per.filter(F.col("model") == name).select("window_id", F.col("m").alias(f"{name}_m"), F.col("simple").alias(f"{name}_s"))
    out = same.join(of("random"), "window_id").join(of("swapped"), "window_id").join(of("configuration"), "window_id")
    return out.select("window_id", "nodes", F.col("random_m").alias("random_edges"), F.col("random_s").alias("random_is_simple"), "degrees_stay", F.col("swapped_m").alias("swapped_edges"), (F.col("configuration_m") <= F.col("_m")).alias("stubs_suffice"), F.col("configuration_s").alias("configuration_is_simple"))


@query(None)
def g19_louvain(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = kernels.planar_graphs(graphs.complete(pairs(spark, sf_dir)))
    return rounded(graphs.modularity(e, kernels.communities(e)))


@query(None)
def g20_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = kernels.planar_graphs(graphs.complete(pairs(spark, sf_dir)))
    return kernels.communities(e, "propagation")


@query(None)
def g24_g27_r21_r23_null_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(kernels.null_tests(kernels.planar_graphs(graphs.complete(pairs(spark, sf_dir)))))


@query(None)
def r18_r20_distance_null_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(kernels.distance_null_tests(pairs(spark, sf_dir)))


@query(None)
def c1_average_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.clusters(pairs(spark, sf_dir))


@query(None)
def c2_cross_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(kernels.cross_method(pairs(spark, sf_dir)))


@query(None)
def c8_ward_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(kernels.ward_merges(pairs(spark, sf_dir)))


@query(f"""WITH {PVALS}, n AS (SELECT window_id, count(DISTINCT x) AS n FROM (SELECT window_id, asset_1 AS x FROM pairs UNION ALL SELECT window_id, asset_2 FROM pairs) GROUP BY 1)
SELECT window_id, CAST(n AS INT) AS n_assets, CAST(n_obs AS INT) AS n_obs, round(n / n_obs, 6) AS q, round(pow(1 - sqrt(n / n_obs), 2), 6) AS lambda_minus, round(pow(1 + sqrt(n / n_obs), 2), 6) AS lambda_plus, round(CAST(n AS DOUBLE), 6) AS lambda_sum, CAST(n AS INT) AS eigenvalues FROM n JOIN nobs USING (window_id)""")
def r9_marchenko_pastur(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The band's limits, and as invariants the eigenvalues' sum and number."""
    mp = kernels.marchenko_pastur(pairs(spark, sf_dir), observations(spark, sf_dir))
    return rounded(mp.select("window_id", "n_assets", "n_obs", "q", "lambda_minus", "lambda_plus", "lambda_sum", (F.col("n_signal") + F.col("n_noise")).alias("eigenvalues")))


@query(None)
def r9_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(kernels.marchenko_pastur(pairs(spark, sf_dir), observations(spark, sf_dir)))


@query(f"""WITH {PAIRS}, a AS (SELECT window_id, rho, 0 AS side FROM pairs UNION ALL SELECT window_id - 12, rho, 1 FROM pairs), k AS (SELECT window_id FROM a GROUP BY 1 HAVING count(DISTINCT side) = 2),
c AS (SELECT window_id, rho, sum(1 - side) OVER o AS f, sum(side) OVER o AS g, sum(1 - side) OVER (PARTITION BY window_id) AS m, sum(side) OVER (PARTITION BY window_id) AS n FROM a JOIN k USING (window_id) WINDOW o AS (PARTITION BY window_id ORDER BY rho))
SELECT window_id, round(max(abs(f / m - g / n)), 6) AS ks_stat FROM c GROUP BY 1""")
def r8_ks_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest gap of a window's correlations against those of the window a year on."""
    p = pairs(spark, sf_dir).select("window_id", "rho")
    both = p.withColumn("side", F.lit(0)).unionByName(p.select((F.col("window_id") - 12).alias("window_id"), "rho", F.lit(1).alias("side")))
    return rounded(kernels.ks_between(both, "rho").filter("ks_stat is not null").select("window_id", "ks_stat"))


@query(None)
def r8_ks_against_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(kernels.ks_against_noise(pairs(spark, sf_dir), observations(spark, sf_dir)))


def adf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = windowed(spark, sf_dir)
    return kernels.stationarity(rows, ["window_id", "asset"], "obs_date", "log_return", "window_id int, asset string")


@query(None)
def r10_stationarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(adf(spark, sf_dir))


@query(f"WITH {WINDOWED} SELECT DISTINCT window_id, asset FROM win WHERE window_id % 2 = 0")
def r11_j9_incremental_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys still to be tested when odd windows are done."""
    rows, _ = windowed(spark, sf_dir)
    keys = rows.select("window_id", "asset").distinct()
    return keys.join(keys.filter("window_id % 2 = 1"), ["window_id", "asset"], "left_anti")


@query(None)
def r32_window_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = windowed(spark, sf_dir)
    return rounded(kernels.window_bundle(pairs(spark, sf_dir), rows))


@query(f"""WITH {PVALS}, n AS (SELECT window_id, count(DISTINCT x) AS n FROM (SELECT window_id, asset_1 AS x FROM pairs UNION ALL SELECT window_id, asset_2 FROM pairs) GROUP BY 1)
SELECT window_id, 'pvalue' AS part, asset_1 AS name_1, asset_2 AS name_2, 'pvalue' AS metric, round(pvalue, 6) + 0.0 AS value FROM pv
UNION ALL SELECT window_id, 'mp', NULL, NULL, 'q', round(n / n_obs, 6) + 0.0 FROM n JOIN nobs USING (window_id) UNION ALL SELECT window_id, 'mp', NULL, NULL, 'lambda_plus', round(pow(1 + sqrt(n / n_obs), 2), 6) + 0.0 FROM n JOIN nobs USING (window_id)
UNION ALL SELECT window_id, 'adf', 'series', NULL, 'tested', CAST(count(*) AS DOUBLE) FROM (SELECT window_id, asset FROM win WHERE window_id % 2 = 0 GROUP BY 1, 2 HAVING count(log_return) >= 10) GROUP BY 1""")
def r32_j8_bundle_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the bundle the p-values, the noise band, and how many series were tested when those of odd windows are done."""
    rows, _ = windowed(spark, sf_dir)
    done = rows.filter("window_id % 2 = 1").select("window_id", "asset").distinct()
    b = kernels.window_bundle(pairs(spark, sf_dir), rows, done)
    some = b.filter("metric = 'pvalue' or (part = 'mp' and metric in ('q', 'lambda_plus'))")
    tested = b.filter("part = 'adf' and metric = 'adf_stat'").groupBy("window_id").agg(F.count(F.lit(1)).cast("double").alias("value"))
    return rounded(some.unionByName(tested.select("window_id", F.lit("adf").alias("part"), F.lit("series").alias("name_1"), F.lit(None).cast("string").alias("name_2"), F.lit("tested").alias("metric"), "value")))


@query(None)
def r14_s26_validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir)
    s = statistics.validation_summary(kernels.ks_against_noise(p, observations(spark, sf_dir)), adf(spark, sf_dir), kernels.cross_method(p))
    long = events.unpivot(s.withColumn("_one", F.lit(1)), ["_one"], [c for c in s.columns])
    return statistics.latex_table(long.select("metric", "value"), ["metric", "value"], ["metric"], "Validation summary", "tab:validation")


@query(None)
def s24_graphml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GraphML of the last window's planar graph (one window is the feature)."""
    e = kernels.planar_graphs(graphs.complete(pairs(spark, sf_dir)))
    last = calendar.month_windows(panels.dates(spark, sf_dir)).agg(F.max("window_id")).first()[0]
    return sinks.graphml(e, last)


@query(f"WITH {PAIRS}, n AS (SELECT count(DISTINCT x) AS n FROM (SELECT window_id, asset_1 AS x FROM pairs UNION ALL SELECT window_id, asset_2 FROM pairs) WHERE window_id = (SELECT max(window_id) FROM windows)) SELECT p.part, CASE p.part WHEN 1 THEN n WHEN 2 THEN 3 * n - 6 ELSE 1 END AS lines FROM n, (SELECT CAST(unnest([0, 1, 2, 3]) AS INT) AS part) p")
def s24_graphml_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s24_graphml(spark, sf_dir).groupBy("part").agg(F.count(F.lit(1)).alias("lines"))


# Size-adjusted metrics and event studies.


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per window: bounds, nodes, and four structural metrics of the nearest-neighbour graph."""
    e = knn(spark, sf_dir)
    w = calendar.month_windows(panels.dates(spark, sf_dir))
    out = w.join(graphs.basics(e).select("window_id", "n_nodes", "n_edges", "mean_degree"), "window_id").join(graphs.distance_moments(e).select("window_id", "dist_mean", "dist_std"), "window_id")
    return out.join(graphs.clustering(e), "window_id")


VALUES = ["mean_degree", "dist_mean", "dist_std", "transitivity"]
METRICS = KNN + TRI + """,
met AS (SELECT w.*, n_nodes, mean_degree, dist_mean, dist_std, transitivity FROM windows w JOIN (SELECT window_id, count(*) AS n_nodes, avg(degree) AS mean_degree FROM deg GROUP BY 1) USING (window_id)
        JOIN (SELECT window_id, avg(distance) AS dist_mean, stddev_samp(distance) AS dist_std FROM edges GROUP BY 1) USING (window_id) JOIN (SELECT window_id, sum(t) / sum(k * (k - 1) / 2.0) AS transitivity FROM lc GROUP BY 1) USING (window_id))"""


@query(f"""WITH {METRICS} SELECT window_id, n_nodes, round(mean_degree, 6) AS mean_degree, round(6 - 12.0 / n_nodes, 6) AS expected, round(mean_degree - (6 - 12.0 / n_nodes), 6) + 0.0 AS residual FROM met""")
def r24_planar_degree_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.planar_degree_residual(metrics(spark, sf_dir).select("window_id", "n_nodes", "mean_degree")))


COUNTS = WINDOWED + ", ct AS (SELECT window_id, count(DISTINCT obs_date) + window_id % 7 AS n_nodes, avg(volume) AS m FROM win GROUP BY 1)"


@query(f"""WITH {COUNTS}, f AS (SELECT regr_slope(m, ln(1 + n_nodes)) AS b, regr_intercept(m, ln(1 + n_nodes)) AS a FROM ct), r AS (SELECT window_id, m, a + b * ln(1 + n_nodes) AS e FROM ct, f)
SELECT window_id, round(m, 2) AS m, round(e, 2) AS expected, round(m - e, 2) + 0.0 AS residual, round((m - e) / (SELECT stddev_samp(m - e) FROM r), 5) + 0.0 AS zscore FROM r""")
def r24_r25_size_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = windowed(spark, sf_dir)
    c = rows.groupBy("window_id").agg((F.countDistinct("obs_date") + F.first("window_id") % 7).alias("n_nodes"), F.avg("volume").alias("m"))
    out = statistics.size_adjusted(c, "m")
    return out.select("window_id", *[(F.round(x, 2) + F.lit(0.0)).alias(x) for x in ("m", "expected", "residual")], (F.round("zscore", 5) + F.lit(0.0)).alias("zscore"))


@query(f"""WITH {COUNTS}, k AS (SELECT rank() OVER (ORDER BY n_nodes) + (count(*) OVER (PARTITION BY n_nodes) - 1) / 2 AS x, rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2 AS y FROM ct) SELECT round(corr(x, y), 6) AS rho FROM k""")
def r26_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = windowed(spark, sf_dir)
    c = rows.groupBy("window_id").agg((F.countDistinct("obs_date") + F.first("window_id") % 7).alias("n_nodes"), F.avg("volume").alias("m"))
    return rounded(statistics.spearman(c, "n_nodes", "m"))


def calendar_events(spark: SparkSession) -> DataFrame:
    """Two sets of dates, joined as rows of one table."""
    a = spark.sql("SELECT 'configured' AS event_set, d AS event_date, 'configured' AS status FROM VALUES (DATE'1997-07-15'), (DATE'1998-08-20'), (DATE'2000-04-10') AS t(d)")
    b = spark.sql("SELECT 'proxy' AS event_set, d AS event_date, s AS status FROM VALUES (DATE'1996-09-01', 'trigger_-3sigma'), (DATE'1999-01-13', 'trigger_-3sigma'), (DATE'1999-11-30', 'largest_drop') AS t(d, s)")
    return a.unionByName(b, allowMissingColumns=True)


EVENTS = """,
ev AS (SELECT 'configured' AS event_set, d AS event_date, 'configured' AS status FROM (VALUES (DATE '1997-07-15'), (DATE '1998-08-20'), (DATE '2000-04-10')) t(d)
       UNION ALL SELECT 'proxy', d, s FROM (VALUES (DATE '1996-09-01', 'trigger_-3sigma'), (DATE '1999-01-13', 'trigger_-3sigma'), (DATE '1999-11-30', 'largest_drop')) t(d, s)),
lg AS (UNPIVOT (SELECT window_id, window_start, window_end, mean_degree, dist_mean, dist_std, transitivity FROM met) ON mean_degree, dist_mean, dist_std, transitivity INTO NAME metric VALUE value),
ph AS (SELECT *, CASE WHEN window_start <= event_date AND event_date <= window_end THEN 'during' WHEN window_end < event_date AND window_end >= event_date - INTERVAL 6 MONTH THEN 'pre' WHEN window_start > event_date AND window_start <= event_date + INTERVAL 6 MONTH THEN 'post' ELSE 'tranquil' END AS phase FROM lg, ev),
pm AS (SELECT event_set, event_date, status, metric, phase, count(value) AS windows, avg(value) AS mean FROM ph GROUP BY ALL),
gr AS (SELECT * FROM (SELECT DISTINCT event_set, event_date, status, metric FROM ph), (SELECT unnest(['tranquil', 'pre', 'during', 'post']) AS phase)),
dt AS (SELECT gr.*, coalesce(pm.windows, 0) AS windows, pm.mean, pm.mean - pr.mean AS change_from_pre FROM gr LEFT JOIN pm USING (event_set, event_date, status, metric, phase) LEFT JOIN (SELECT * FROM pm WHERE phase = 'pre') pr ON pr.event_date = gr.event_date AND pr.metric = gr.metric AND pr.event_set = gr.event_set)"""


def phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.phase_summary(calendar_events(spark), scratch.checkpointed(metrics(spark, sf_dir)), VALUES)


@query(f"WITH {METRICS}{EVENTS} SELECT event_set, event_date, status, metric, phase, windows, round(mean, 6) + 0.0 AS mean, round(change_from_pre, 6) + 0.0 AS change_from_pre FROM dt")
def e3_e4_phase_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(phases(spark, sf_dir))


@query(f"""WITH {METRICS}{EVENTS} SELECT event_set, status, metric, phase, count(*) AS events, CAST(sum(CASE WHEN change_from_pre > 0 THEN 1 ELSE 0 END) AS BIGINT) AS positive, CAST(sum(CASE WHEN change_from_pre < 0 THEN 1 ELSE 0 END) AS BIGINT) AS negative, round(median(change_from_pre), 6) + 0.0 AS median_change, round(avg(change_from_pre), 6) + 0.0 AS mean_change,
CASE WHEN sum(CASE WHEN change_from_pre > 0 THEN 1 ELSE 0 END) >= sum(CASE WHEN change_from_pre < 0 THEN 1 ELSE 0 END) THEN 'positive' ELSE 'negative' END AS dominant_direction, round(greatest(sum(CASE WHEN change_from_pre > 0 THEN 1 ELSE 0 END), sum(CASE WHEN change_from_pre < 0 THEN 1 ELSE 0 END)) / count(*), 6) AS concordance_share
FROM dt WHERE phase IN ('during', 'post') AND change_from_pre IS NOT NULL GROUP BY 1, 2, 3, 4""")
def e5_concordance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(events.concordance(phases(spark, sf_dir)))


TRAJ = """,
tp AS (SELECT *, row_number() OVER k AS position, count(*) OVER (PARTITION BY event_set, event_date, metric) AS n, coalesce((value - avg(value) OVER (PARTITION BY event_set, event_date, metric)) / nullif(stddev_pop(value) OVER (PARTITION BY event_set, event_date, metric), 0), 0) AS z, value - lag(value) OVER k AS d
       FROM ph WHERE phase = 'pre' WINDOW k AS (PARTITION BY event_set, event_date, metric ORDER BY window_end)),
ts AS (SELECT * FROM tp WHERE n = 6),
tu AS (SELECT event_set, event_date, metric, sum(t) AS turning_points FROM (SELECT *, CASE WHEN sign(d) <> lag(sign(d)) OVER (PARTITION BY event_set, event_date, metric ORDER BY position) THEN 1 ELSE 0 END AS t FROM ts WHERE d <> 0) GROUP BY 1, 2, 3),
su AS (SELECT event_set, event_date, status, metric, max_by(d, position) AS latest_step, max_by(value, position) - min_by(value, position) AS endpoint_change, (max(value) - min(value)) / abs(avg(value)) AS relative_range, coalesce(any_value(turning_points), 0) AS turning_points FROM ts LEFT JOIN tu USING (event_set, event_date, metric) GROUP BY 1, 2, 3, 4)"""


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.trajectories(calendar_events(spark), metrics(spark, sf_dir), VALUES)


@query(f"WITH {METRICS}{EVENTS}{TRAJ} SELECT event_set, event_date, status, metric, window_id, CAST(position AS INT) AS position, round(value, 6) + 0.0 AS value, round(z, 4) + 0.0 AS z FROM ts")
def e7_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = paths(spark, sf_dir)
    return p.select("event_set", "event_date", "status", "metric", "window_id", "position", (F.round("value", 6) + F.lit(0.0)).alias("value"), (F.round("z", 4) + F.lit(0.0)).alias("z"))


@query(f"WITH {METRICS}{EVENTS}{TRAJ} SELECT event_set, event_date, status, metric, round(latest_step, 6) + 0.0 AS latest_step, round(endpoint_change, 6) + 0.0 AS endpoint_change, round(relative_range, 6) AS relative_range, CAST(turning_points AS BIGINT) AS turning_points FROM su")
def e8_trajectory_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(events.trajectory_summary(paths(spark, sf_dir)))


@query(f"""WITH {METRICS}{EVENTS}{TRAJ} SELECT metric, CAST(count(*) FILTER (WHERE latest_step < 0) AS BIGINT) AS down, CAST(count(*) FILTER (WHERE latest_step = 0) AS BIGINT) AS flat, CAST(count(*) FILTER (WHERE latest_step > 0) AS BIGINT) AS up, count(*) FILTER (WHERE status LIKE 'trigger%' AND latest_step > 0) AS trigger_up, count(*) FILTER (WHERE status LIKE 'trigger%' AND latest_step < 0) AS trigger_down, count(*) FILTER (WHERE status LIKE 'trigger%' AND latest_step = 0) AS trigger_flat, round(median(turning_points), 6) AS median_turning_points, round(median(relative_range), 6) AS median_relative_range FROM su GROUP BY 1""")
def e9_recurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(events.recurrence(events.trajectory_summary(paths(spark, sf_dir))))


@query(f"WITH {METRICS}{EVENTS} SELECT event_set, event_date, status, metric, phase, round((mean - min(mean) OVER (PARTITION BY metric)) / nullif(max(mean) OVER (PARTITION BY metric) - min(mean) OVER (PARTITION BY metric), 0), 5) + 0.0 AS scaled FROM dt WHERE mean IS NOT NULL")
def e11_min_max_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = events.min_max_scaled(phases(spark, sf_dir).filter("mean is not null"), ["metric"], "mean")
    return rounded(d.select("event_set", "event_date", "status", "metric", "phase", "scaled"), 5)


@query(f"""WITH {WINDOWED}, {{EVENTS_ONLY}}, mk AS (SELECT obs_date, avg(log_return) AS r, avg(close) AS level FROM (SELECT DISTINCT obs_date, asset, log_return, close FROM win) GROUP BY 1),
z AS (SELECT *, lag(level) OVER (ORDER BY obs_date) AS before, (r - (SELECT avg(r) FROM mk)) / (SELECT stddev_samp(r) FROM mk) AS z FROM mk),
nr AS (SELECT anchor, z.*, row_number() OVER (PARTITION BY anchor ORDER BY CASE WHEN coalesce(z, 0) > -3 THEN 1 ELSE 0 END, CASE WHEN z <= -3 THEN obs_date END, r NULLS LAST, obs_date) AS k FROM z, an WHERE abs(obs_date - anchor) <= 60),
sh AS (SELECT anchor, CASE WHEN z <= -3 THEN 'trigger_-3sigma' ELSE 'largest_drop' END AS status, obs_date AS shock_start, r AS shock_return, z AS shock_z, coalesce(before, level) AS recovery_level FROM nr WHERE k = 1),
en AS (SELECT anchor, min(mk.obs_date) FILTER (WHERE level >= recovery_level AND mk.obs_date > shock_start) AS recovery_end FROM sh JOIN mk ON mk.obs_date >= shock_start GROUP BY 1),
lo AS (SELECT sh.anchor, min_by(mk.obs_date, (level, mk.obs_date)) AS bottom_date, min(level) AS low FROM sh JOIN en USING (anchor) JOIN mk ON mk.obs_date >= shock_start AND (recovery_end IS NULL OR mk.obs_date <= recovery_end) GROUP BY 1)
SELECT sh.anchor, status, shock_start, round(shock_return, 6) + 0.0 AS shock_return, round(shock_z, 6) + 0.0 AS shock_z, round(recovery_level, 6) + 0.0 AS recovery_level, recovery_end, bottom_date, round(low / recovery_level - 1, 6) + 0.0 AS max_drawdown, CAST(recovery_end - shock_start AS INT) AS duration_days, recovery_end IS NOT NULL AS recovered
FROM sh JOIN en USING (anchor) JOIN lo USING (anchor)""".replace("{EVENTS_ONLY}", "an AS (SELECT DATE '1997-07-15' AS anchor UNION ALL SELECT DATE '1998-08-20' UNION ALL SELECT DATE '2000-04-10' UNION ALL SELECT DATE '1996-09-01' UNION ALL SELECT DATE '1999-01-13' UNION ALL SELECT DATE '1999-11-30')"))
def e1_shocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shocks of the market's mean weekly return around fixed anchors."""
    rows, _ = windowed(spark, sf_dir)
    market = rows.select("obs_date", "asset", "log_return", "close").distinct().groupBy("obs_date").agg(F.avg("log_return").alias("log_return"), F.avg("close").alias("level"))
    return rounded(events.shocks(market, calendar_events(spark).select(F.col("event_date").alias("anchor"))))


@query(f"""WITH {METRICS}{EVENTS} SELECT event_set, event_date, phase, metric, count(value) AS windows, round(avg(value), 6) + 0.0 AS mean FROM ph WHERE phase <> 'tranquil' GROUP BY 1, 2, 3, 4""")
def e10_j17_event_window_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    ph = events.unpivot(events.beside_events(metrics(spark, sf_dir), calendar_events(spark)), ["event_set", "event_date", "phase"], VALUES)
    return rounded(ph.groupBy("event_set", "event_date", "phase", "metric").agg(F.count("value").alias("windows"), F.avg("value").alias("mean")))
