"""Centralities by ranges of sources equal those of one task."""

import random

import pytest
from pyspark.sql import functions as F

from tidemesh.operators import brandes, kernels


@pytest.mark.parametrize("sources", [1, 7, 64])
def test_equal_to_one_task(spark, sources):
    rnd = random.Random(sources)
    rows = []
    for w in range(4):
        names = [f"n{k:02d}" for k in range(rnd.randint(2, 30))]
        pairs = {tuple(sorted(rnd.sample(names, 2))) for _ in range(rnd.randint(1, 60))}
        rows += [(w, u, v, 1.0, 1.0) for u, v in pairs]
    edges = spark.createDataFrame(rows, "window_id int, u string, v string, distance double, weight double")
    want = {(r.window_id, r.node): r for r in kernels.centralities(edges).collect()}
    turned = edges.select("window_id", F.col("v").alias("u"), F.col("u").alias("v")).unionByName(edges.limit(5).select("window_id", "u", "v"))  # repeated and turned round
    got = {(r.window_id, r.node): r for r in brandes.centralities(turned, sources).collect()}
    assert got.keys() == want.keys()
    for k, r in got.items():
        w = want[k]
        assert (r.degree, r.degree_centrality) == (w.degree, pytest.approx(w.degree_centrality))
        assert (r.betweenness_centrality, r.closeness_centrality) == (pytest.approx(w.betweenness_centrality, abs=1e-12), pytest.approx(w.closeness_centrality))


def test_no_edges(spark):
    assert brandes.centralities(spark.createDataFrame([(1, "a", "a")], "window_id int, u string, v string")).count() == 0
