"""Graphs as edge tables (window_id, u < v, distance, weight) and their relational metrics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .correlation import pearson
from .statistics import moments, spread

#: Above so many edges the costly metrics of a graph are left out.
HEAVY_EDGES = 30_000


def complete(pairs: DataFrame) -> DataFrame:
    """All pairs at a positive distance: (window_id, u, v, distance, weight)."""
    d = F.col("distance")
    return pairs.filter(d.isNotNull() & (d > 0)).select("window_id", F.col("asset_1").alias("u"), F.col("asset_2").alias("v"), "distance", d.alias("weight"))


def threshold(pairs: DataFrame, level: float = 0.05, weight: str = "distance") -> DataFrame:
    """Pairs with a significant correlation, weighted by distance or by |rho|."""
    w = F.col("distance") if weight == "distance" else F.abs("rho")
    return pairs.filter(F.col("pvalue") < level).filter("distance > 0").select("window_id", F.col("asset_1").alias("u"), F.col("asset_2").alias("v"), "distance", w.alias("weight"))


def mirrored(edges: DataFrame) -> DataFrame:
    there = edges.select("window_id", F.col("u").alias("node"), F.col("v").alias("other"), "distance", "weight")
    return there.unionByName(edges.select("window_id", F.col("v").alias("node"), F.col("u").alias("other"), "distance", "weight"))


def nearest_neighbours(edges: DataFrame, k: int = 5) -> DataFrame:
    """The union of each node's k nearest, undirected; ties, to 9 places, go to the lesser neighbour."""
    w = Window.partitionBy("window_id", "node").orderBy(F.round("distance", 9), "other")
    near = mirrored(edges).withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k)
    return near.select("window_id", F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v"), "distance", "weight").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(window_id, node, degree, degree_centrality): degree over the other nodes of the graph."""
    deg = mirrored(edges).groupBy("window_id", "node").agg(F.count(F.lit(1)).alias("degree"))
    n = F.count(F.lit(1)).over(Window.partitionBy("window_id"))
    return deg.withColumn("degree_centrality", F.col("degree") / F.nullif((n - 1).cast("double"), F.lit(0.0)))


def basics(edges: DataFrame) -> DataFrame:
    deg = degrees(edges).groupBy("window_id").agg(F.count(F.lit(1)).alias("n_nodes"), F.avg("degree").alias("mean_degree"), F.max("degree").alias("max_degree"))
    m = edges.groupBy("window_id").agg(F.count(F.lit(1)).alias("n_edges"))
    return deg.join(m, "window_id").withColumn("density", 2.0 * F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1)))


def components(edges: DataFrame) -> DataFrame:
    """(window_id, node, component): the least node reachable. One window's graph is one group, joined up in memory."""

    def of(e: pd.DataFrame) -> pd.DataFrame:
        root = {x: x for x in {*e["u"], *e["v"]}}

        def find(a):
            while root[a] != a:
                root[a] = root[root[a]]
                a = root[a]
            return a

        for a, b in zip(e["u"], e["v"], strict=True):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        nodes = sorted(root)
        return pd.DataFrame({"window_id": e["window_id"].iloc[0], "node": nodes, "component": [find(x) for x in nodes]})

    return edges.select("window_id", "u", "v").groupBy("window_id").applyInPandas(of, "window_id int, node string, component string")


def component_sizes(labels: DataFrame) -> DataFrame:
    size = labels.groupBy("window_id", "component").agg(F.count(F.lit(1)).alias("_n"))
    return size.groupBy("window_id").agg(F.count(F.lit(1)).alias("n_components"), F.max("_n").alias("largest_component"))


def triangles(edges: DataFrame) -> DataFrame:
    """(window_id, a < b < c): joins along ordered edges, so each triangle is found once."""
    e = edges.select("window_id", "u", "v")
    ab = e.select("window_id", F.col("u").alias("a"), F.col("v").alias("b"))
    bc = e.select("window_id", F.col("u").alias("b"), F.col("v").alias("c"))
    ac = e.select("window_id", F.col("u").alias("a"), F.col("v").alias("c"))
    return ab.join(bc, ["window_id", "b"]).join(ac, ["window_id", "a", "c"])


def clustering(edges: DataFrame) -> DataFrame:
    """Per window: mean local clustering and transitivity."""
    t = triangles(edges).select("window_id", F.explode(F.array("a", "b", "c")).alias("node")).groupBy("window_id", "node").agg(F.count(F.lit(1)).alias("_t"))
    d = degrees(edges).join(t, ["window_id", "node"], "left").select("window_id", F.col("degree").alias("k"), F.coalesce("_t", F.lit(0)).alias("t"))
    wedges = F.col("k") * (F.col("k") - 1) / 2.0
    local = F.when(wedges > 0, F.col("t") / wedges).otherwise(0.0)
    return d.groupBy("window_id").agg(F.avg(local).alias("mean_clustering"), F.coalesce(F.try_divide(F.sum("t").cast("double"), F.sum(wedges)), F.lit(0.0)).alias("transitivity"))


def assortativity(edges: DataFrame) -> DataFrame:
    """Per window the Pearson correlation of the degrees at both ends of the edges."""
    deg = degrees(edges).select("window_id", "node", "degree")
    both = mirrored(edges).select("window_id", "node", "other").join(deg.withColumnRenamed("degree", "_x"), ["window_id", "node"])
    both = both.join(deg.withColumnsRenamed({"node": "other", "degree": "_y"}), ["window_id", "other"])
    return both.groupBy("window_id").agg(pearson("_x", "_y").alias("assortativity"))


def forman_ricci(edges: DataFrame, weight: str = "weight") -> DataFrame:
    """Edges with ricci, the Forman curvature of unit nodes.

    w (2 / w - sum over edges at u and at v, but this one, of 1 / sqrt(w w'))
    = 4 - sqrt(w) (S_u + S_v) with S the sum of 1 / sqrt(w) over a node's
    edges: one aggregation and two joins. Roots are floored at 1e-12.
    """
    w = F.greatest(F.col(weight), F.lit(1e-12))
    s = mirrored(edges).groupBy("window_id", "node").agg(F.sum(1 / F.sqrt(F.greatest(F.col(weight), F.lit(1e-12)))).alias("_s"))
    out = edges.join(s.withColumnsRenamed({"node": "u", "_s": "_su"}), ["window_id", "u"]).join(s.withColumnsRenamed({"node": "v", "_s": "_sv"}), ["window_id", "v"])
    return out.withColumn("ricci", 4 - F.sqrt(w) * (F.col("_su") + F.col("_sv"))).drop("_su", "_sv")


def ricci_statistics(edges: DataFrame) -> DataFrame:
    return forman_ricci(edges).groupBy("window_id").agg(*moments("ricci", "ricci"), *spread("ricci", "ricci"))


def distance_moments(edges: DataFrame) -> DataFrame:
    return edges.groupBy("window_id").agg(*moments("distance", "dist"))


def ricci_groups(edges: DataFrame) -> DataFrame:
    """(window_id, node, score, group): terciles, at .33 and .66, of the mean curvature of a node's edges."""
    curved = forman_ricci(edges)
    score = curved.select("window_id", F.explode(F.array("u", "v")).alias("node"), "ricci").groupBy("window_id", "node").agg(F.avg("ricci").alias("score"))
    cut = score.groupBy("window_id").agg(F.percentile("score", F.lit(0.33)).alias("_a"), F.percentile("score", F.lit(0.66)).alias("_b"))
    group = F.when(F.col("score") <= F.col("_a"), "low").when(F.col("score") <= F.col("_b"), "mid").otherwise("high")
    return score.join(cut, "window_id").select("window_id", "node", "score", group.alias("group"))


def modularity(edges: DataFrame, labels: DataFrame, weight: str = "weight") -> DataFrame:
    """Per window Q = sum over communities of inner weight / m - (weight of degrees / 2m)^2; labels: window_id, node, community."""
    w = edges.select("window_id", "u", "v", F.col(weight).alias("_w"))
    a, b = labels.select("window_id", F.col("node").alias("u"), F.col("community").alias("_cu")), labels.select("window_id", F.col("node").alias("v"), F.col("community").alias("_cv"))
    e = w.join(a, ["window_id", "u"]).join(b, ["window_id", "v"])
    parts = e.select("window_id", F.explode(F.array(F.struct(F.col("_cu").alias("c"), F.col("_w").alias("d"), F.when(F.col("_cu") == F.col("_cv"), F.col("_w")).otherwise(0.0).alias("i")), F.struct(F.col("_cv").alias("c"), F.col("_w").alias("d"), F.lit(0.0).alias("i")))).alias("p"))
    c = parts.groupBy("window_id", "p.c").agg(F.sum("p.i").alias("_in"), F.sum("p.d").alias("_deg"))
    total = F.sum("_deg").over(Window.partitionBy("window_id"))
    share = c.withColumn("_q", F.coalesce(F.try_divide(2 * F.col("_in"), total) - F.pow(F.try_divide(F.col("_deg"), total), F.lit(2.0)), F.lit(0.0)))
    return share.groupBy("window_id").agg(F.sum("_q").alias("modularity"), F.count(F.lit(1)).alias("n_communities"))


def contingency(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    x = a.select(*keys, "node", F.col("community").alias("_a")).join(b.select(*keys, "node", F.col("community").alias("_b")), [*keys, "node"])
    return x.groupBy(*keys, "_a", "_b").agg(F.count(F.lit(1)).cast("double").alias("_n"))


def partition_agreement(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Adjusted Rand index and normalised mutual information (arithmetic mean) of two labellings of the nodes both have."""
    t = contingency(a, b, keys)
    ka, kb, k = Window.partitionBy(*keys, "_a"), Window.partitionBy(*keys, "_b"), Window.partitionBy(*keys)
    t = t.withColumns({"_ra": F.sum("_n").over(ka), "_rb": F.sum("_n").over(kb), "_all": F.sum("_n").over(k), "_ca": F.count(F.lit(1)).over(ka), "_cb": F.count(F.lit(1)).over(kb)})

    def pairs(c: str):
        return F.col(c) * (F.col(c) - 1) / 2

    p = lambda c: F.col(c) / F.col("_all")
    s = t.groupBy(*keys).agg(
        F.sum(pairs("_n")).alias("_ij"), F.sum(pairs("_ra") / F.col("_ca")).alias("_i"), F.sum(pairs("_rb") / F.col("_cb")).alias("_j"), F.max("_all").alias("_m"),
        F.sum(p("_n") * F.ln(F.col("_n") * F.col("_all") / (F.col("_ra") * F.col("_rb")))).alias("_mi"),
        (-F.sum(p("_ra") * F.ln(p("_ra")) / F.col("_ca"))).alias("_ha"), (-F.sum(p("_rb") * F.ln(p("_rb")) / F.col("_cb"))).alias("_hb"),
    )
    chance = F.try_divide(F.col("_i") * F.col("_j"), F.col("_m") * (F.col("_m") - 1) / 2)
    ari = F.coalesce(F.try_divide(F.col("_ij") - chance, (F.col("_i") + F.col("_j")) / 2 - chance), F.lit(1.0))
    nmi = F.coalesce(F.try_divide(F.col("_mi"), (F.col("_ha") + F.col("_hb")) / 2), F.lit(1.0))
    return s.filter("_m >= 2").select(*keys, ari.alias("ari"), nmi.alias("nmi"))


def composition(labels: DataFrame, sectors: DataFrame, keys: list[str]) -> DataFrame:
    """Per cluster and sector: count, and percent of the cluster."""
    s = labels.join(sectors, "node").groupBy(*keys, "community", "sector").agg(F.count(F.lit(1)).alias("count"))
    return s.withColumn("pct", 100.0 * F.col("count") / F.sum("count").over(Window.partitionBy(*keys, "community")))


def silhouette(points: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Mean silhouette per group from pair distances (keys, a, b, d; both orientations) and labels; a lone member scores 0."""
    la = labels.select(*keys, F.col("node").alias("a"), F.col("community").alias("_ca"))
    lb = labels.select(*keys, F.col("node").alias("b"), F.col("community").alias("_cb"))
    d = points.join(la, [*keys, "a"]).join(lb, [*keys, "b"]).groupBy(*keys, "a", "_ca", "_cb").agg(F.avg("d").alias("_d"))
    each = d.groupBy(*keys, "a").agg(F.max(F.when(F.col("_ca") == F.col("_cb"), F.col("_d"))).alias("_in"), F.min(F.when(F.col("_ca") != F.col("_cb"), F.col("_d"))).alias("_out"))
    s = F.coalesce(F.try_divide(F.col("_out") - F.col("_in"), F.greatest("_in", "_out")), F.lit(0.0))
    return each.groupBy(*keys).agg(F.avg(F.when(F.col("_in").isNull(), 0.0).otherwise(s)).alias("silhouette"))


def validate(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Per window: nodes, edges, connected, tree, density within [0, 1], edges whose weight isn't their distance."""
    mismatch = edges.groupBy("window_id").agg(F.sum((F.abs(F.col("weight") - F.col("distance")) > 1e-5 * F.abs("distance")).cast("int")).alias("weight_mismatches"))
    out = basics(edges).join(component_sizes(labels), "window_id").join(mismatch, "window_id")
    one = F.col("n_components") == 1
    return out.select("window_id", "n_nodes", "n_edges", one.alias("connected"), (one & (F.col("n_edges") == F.col("n_nodes") - 1)).alias("tree"), F.col("density").between(0, 1).alias("density_ok"), "weight_mismatches")


def guarded(edges: DataFrame, costly: DataFrame, limit: int = HEAVY_EDGES) -> DataFrame:
    """All windows with their edges and the costly metrics (window_id, ...), which are null where the graph is too heavy."""
    n = edges.groupBy("window_id").agg(F.count(F.lit(1)).alias("n_edges"))
    return n.join(costly, "window_id", "left").select("window_id", "n_edges", *[F.when(F.col("n_edges") <= limit, F.col(c)).alias(c) for c in costly.columns if c != "window_id"])


def light_windows(edges: DataFrame, limit: int = HEAVY_EDGES) -> DataFrame:
    """Windows whose graph isn't too heavy for the costly metrics."""
    return edges.groupBy("window_id").agg(F.count(F.lit(1)).alias("n_edges")).filter(F.col("n_edges") <= limit).select("window_id")
