import inspect
import math

import numpy as np
import pytest

from tidemesh.operators import kernels


def test_defaults_are_the_published_numbers():
    for f in (kernels.null_tests, kernels.distance_null_tests):
        assert inspect.signature(f).parameters["samples"].default == 1000


def test_graph_metrics_of_a_path_and_a_node_apart():
    got = dict(zip(kernels.GRAPH_METRICS, kernels.graph_metrics(5, np.array([0, 1, 2]), np.array([1, 2, 3])), strict=True))
    assert (got["nodes"], got["edges"], got["components"], got["largest_component"], got["diameter"]) == (5, 3, 2, 4, 3)
    assert got["density"] == pytest.approx(0.3) and got["mean_path"] == pytest.approx(20 / 12) and got["transitivity"] == got["clustering"] == 0
    assert got["assortativity"] == pytest.approx(-0.5)
    assert (got["ricci_min"], got["ricci_max"]) == (pytest.approx(0), pytest.approx(1))  # 4 - the ends' degrees


def test_curvature_weighs_strength():
    u, v, w = np.array([0, 1, 1]), np.array([1, 2, 3]), np.array([0.5, 2.0, 3.0])
    want = [2 - w[k] * sum(1 / math.sqrt(w[k] * w[j]) for j in range(3) if j != k) for k in range(3)]
    got = dict(zip(kernels.GRAPH_METRICS, kernels.graph_metrics(4, u, v, w), strict=True))
    assert got["ricci_mean"] == pytest.approx(np.mean(want)) and got["ricci_max"] == pytest.approx(max(want))


def test_a_random_graph_is_no_more_modular_than_its_randomisations(spark):
    """Permuted labels would find any partition that Louvain makes significant."""
    rng = np.random.default_rng(8)
    rows = []
    for window in range(4):
        for a, b in zip(*kernels.random_edges(20, 50, rng), strict=True):
            rows.append((window, f"n{a:02d}", f"n{b:02d}", 1.0, 1.0))
    blocks = [(9, f"{x}{a}", f"{x}{b}", 1.0, 1.0) for x in "abcd" for a in range(6) for b in range(a)] + [(9, "a0", "b0", 1.0, 1.0), (9, "b1", "c0", 1.0, 1.0), (9, "c1", "d0", 1.0, 1.0)]
    edges = spark.createDataFrame(rows + blocks, "window_id int, u string, v string, distance double, weight double")
    got = {(r["window_id"], r["test"]): r for r in kernels.null_tests(edges, 60).collect()}
    assert len(got) == 20
    assert sum(got[k, "modularity"]["pvalue"] < 0.05 for k in range(4)) <= 1 and all(got[k, "metrics"]["verdict"] != "reject" for k in range(4))
    assert got[9, "modularity"]["pvalue"] == 0 and got[9, "metrics"]["statistic"] >= 3 and got[9, "metrics"]["verdict"] == "reject"
