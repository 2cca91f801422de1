import math
from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from tidemesh.operators import graphs, kernels
from tidemesh.operators.planarity import filtered_graph, is_planar


def complete(n):
    return list(combinations(range(n), 2))


PETERSEN = [(k, (k + 1) % 5) for k in range(5)] + [(k, k + 5) for k in range(5)] + [(5 + k, 5 + (k + 2) % 5) for k in range(5)]


@pytest.mark.parametrize(("n", "edges", "planar"), [
    (4, complete(4), True), (5, complete(5), False), (5, complete(5)[1:], True), (6, [(a, b) for a in range(3) for b in range(3, 6)], False),
    (10, PETERSEN, False), (7, [(k, k + 1) for k in range(6)], True), (8, complete(4) + [(a + 4, b + 4) for a, b in complete(4)], True),
])
def test_planarity_of_known_graphs(n, edges, planar):
    assert is_planar(n, edges) is planar


def has_minor(n, edges):
    """K5 or K3,3 as a minor, by contracting and deleting: for tiny graphs."""
    seen = {}

    def search(e):
        if e in seen:
            return seen[e]
        nodes = sorted({x for p in e for x in p})
        found = False
        if len(e) >= 9:
            found = any(all(p in e for p in combinations(c, 2)) for c in combinations(nodes, 5))
            found = found or any(all((min(x, y), max(x, y)) in e for x in a for y in b) for a in combinations(nodes, 3) for b in combinations([v for v in nodes if v not in a], 3))
            for a, b in e if not found else ():
                merged = frozenset((min(x, y), max(x, y)) for x, y in ((a if u == b else u, a if v == b else v) for u, v in e) if x != y)
                if search(merged):
                    found = True
                    break
        seen[e] = found
        return found

    return search(frozenset(edges))


def test_planarity_against_minors():
    rng = np.random.default_rng(4)
    verdicts = []
    for _ in range(120):
        n = int(rng.integers(6, 8))
        all_ = complete(n)
        m = int(rng.integers(9, min(3 * n - 6, len(all_)) + 1))
        e = [all_[k] for k in sorted(rng.choice(len(all_), m, replace=False))]
        verdicts.append(is_planar(n, e))
        assert verdicts[-1] is not has_minor(n, e)
    assert 0 < sum(verdicts) < 120


@pytest.mark.parametrize("n", [3, 4, 5, 12, 30])
def test_filtered_graph_is_maximal(n):
    rng = np.random.default_rng(n)
    edges = complete(n)
    rng.shuffle(edges)
    kept = [tuple(edges[k]) for k in filtered_graph(n, [tuple(e) for e in edges])]
    assert len(kept) == (3 * n - 6 if n > 2 else 1) and is_planar(n, kept)


def path(n):
    return [[b for b in (a - 1, a + 1) if 0 <= b < n] for a in range(n)]


def test_centralities_of_a_path_and_a_star():
    assert kernels.betweenness(path(5)) == pytest.approx(np.array([0, 3, 4, 3, 0]) / 6)
    star = [[1, 2, 3, 4], [0], [0], [0], [0]]
    assert kernels.betweenness(star) == pytest.approx([1, 0, 0, 0, 0])
    assert kernels.closeness(star) == pytest.approx([1, 4 / 7, 4 / 7, 4 / 7, 4 / 7])
    assert kernels.eigenvector(star)[0] == pytest.approx(1 / math.sqrt(2), abs=1e-4)
    assert kernels.closeness([[1], [0], []]) == pytest.approx([0.5, 0.5, 0])


def test_louvain_finds_cliques():
    e = complete(5) + [(a + 5, b + 5) for a, b in complete(5)] + [(0, 5)]
    u, v = np.array(e).T
    label = kernels.louvain(10, u, v, np.ones(len(e)))
    assert len(set(label[:5])) == 1 and len(set(label[5:])) == 1 and label[0] != label[5]
    q = kernels.partition_quality(10, u, v, np.ones(len(e)), label)
    assert q == pytest.approx(2 * (10 / 21 - (21 / 42) ** 2))
    assert kernels.label_propagation(10, u[:-1], v[:-1]).tolist() == [0] * 5 + [1] * 5


def test_linkage_and_cuts():
    x = np.array([0.0, 0.1, 0.2, 5.0, 5.1])
    d = np.abs(x[:, None] - x[None])
    for method in ("average", "complete", "ward"):
        t = kernels.linkage(d, method)
        assert kernels.cut_tree(t, 5, 2).tolist() == [0, 0, 0, 1, 1] and (np.diff(t[:, 2]) >= -1e-12).all() and t[-1, 3] == 5
    assert kernels.linkage(np.array([[0, 3.0], [3.0, 0]]), "ward")[0, 2] == pytest.approx(3.0)
    assert kernels.silhouette(d, np.array([0, 0, 0, 1, 1])) > 0.9
    with pytest.raises(ValueError):
        kernels.linkage(d, "other")


def test_ks_and_its_law():
    assert kernels.ks_two_sample(np.arange(4.0), np.arange(4.0))[0] == 0
    assert kernels.ks_two_sample(np.arange(4.0), np.arange(10.0, 14.0))[0] == 1
    # Published points of the limit law.
    assert kernels.kolmogorov_sf(1.36) == pytest.approx(0.05, abs=2e-3)
    assert kernels.kolmogorov_sf(1.63) == pytest.approx(0.01, abs=1e-3)
    assert kernels.kolmogorov_sf(1.0) == pytest.approx(kernels.kolmogorov_sf(0.9999999), abs=1e-6)


def test_dickey_fuller():
    rng = np.random.default_rng(2)
    noise = rng.normal(size=300)
    stat, p = kernels.dickey_fuller(noise)
    assert stat < -8 and p < 0.01
    assert kernels.dickey_fuller(np.cumsum(noise))[1] > 0.05
    assert kernels.dickey_fuller(np.ones(50)) is None and kernels.dickey_fuller(noise[:5]) is None
    # Critical values of the test with a constant.
    assert kernels.mackinnon_p(-2.86) == pytest.approx(0.05, abs=3e-3)
    assert kernels.mackinnon_p(-3.43) == pytest.approx(0.01, abs=2e-3)


def test_null_models_keep_what_they_promise():
    rng = np.random.default_rng(0)
    u, v = kernels.random_edges(12, 20, rng)
    assert len(set(zip(u, v))) == 20
    e = kernels.swapped_edges(u, v, rng)
    assert len(e) == 20 and (np.bincount(np.array(e).ravel(), minlength=12) == np.bincount(np.r_[u, v], minlength=12)).all()
    assert e != sorted(zip(u.tolist(), v.tolist()))
    c = kernels.configuration_edges([3, 2, 2, 1, 1], rng)
    assert all(a < b for a, b in c) and len(set(c)) == len(c)
    m = kernels.random_distances(6, rng)
    assert (m == m.T).all() and m.max() == 1 and (np.diag(m) == 0).all()


EDGES = "window_id int, u string, v string, distance double, weight double"


def test_relational_metrics_of_tiny_graphs(spark):
    k4 = [(1, "abcd"[a], "abcd"[b], 1.0, 1.0) for a, b in complete(4)]
    two = [(2, "a", "b", 0.5, 0.5), (2, "b", "c", 1.0, 1.0), (2, "x", "y", 2.0, 2.0)]
    e = spark.createDataFrame(k4 + two, EDGES)
    b = {r["window_id"]: r for r in graphs.basics(e).join(graphs.component_sizes(graphs.components(e)), "window_id").collect()}
    assert (b[1]["n_nodes"], b[1]["n_edges"], b[1]["density"], b[1]["n_components"]) == (4, 6, 1.0, 1)
    assert (b[2]["n_components"], b[2]["largest_component"]) == (2, 3)
    c = {r["window_id"]: r for r in graphs.clustering(e).collect()}
    assert c[1]["transitivity"] == 1 and c[2]["transitivity"] == 0 and c[1]["mean_clustering"] == 1
    # A regular graph has no degree variance: undefined, not an error.
    a = {r["window_id"]: r["assortativity"] for r in graphs.assortativity(e).collect()}
    assert a[1] is None
    r = {(x["u"], x["v"]): x["ricci"] for x in graphs.forman_ricci(e.filter("window_id = 2")).collect()}
    assert r["x", "y"] == pytest.approx(2.0) and r["a", "b"] == pytest.approx(2 - 0.5 / math.sqrt(0.5))
    assert kernels.minimum_spanning_trees(e).filter("window_id = 1").count() == 3
    p = {x["window_id"]: x for x in kernels.path_lengths(e).collect()}
    assert (p[1]["diameter"], p[2]["diameter"], p[2]["mean_path"]) == (1, 2, pytest.approx(4 / 3))


def test_one_window_is_one_row_of_spectrum(spark):
    pairs = spark.createDataFrame([(1, "a", "b", 0.5), (2, "a", "b", 0.1)], "window_id int, asset_1 string, asset_2 string, rho double")
    obs = spark.createDataFrame([(1, 50), (2, 2)], "window_id int, n_obs int")
    mp = {r["window_id"]: r for r in kernels.marchenko_pastur(pairs, obs).collect()}
    assert mp[1]["lambda_max"] == pytest.approx(1.5) and mp[1]["lambda_sum"] == pytest.approx(2)
    assert mp[2]["n_signal"] == 0 and mp[2]["lambda_plus"] is None
    assert isinstance(pd.DataFrame([mp[1].asDict()]), pd.DataFrame)
