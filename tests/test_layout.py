"""Layouts: shortest paths, falling stress, gaps, and the figure's sizes and widths."""

import numpy as np
import pandas as pd
import pytest

from tidemesh.operators import layout


def random_graph(rng, n):
    u = np.concatenate([np.arange(1, n), rng.integers(0, n, n)])
    v = np.concatenate([[rng.integers(0, k) for k in range(1, n)], rng.integers(0, n, n)])
    keep = u != v
    return u[keep], v[keep], rng.uniform(0.1, 2, keep.sum())


@pytest.mark.parametrize("seed", range(5))
def test_path_distances(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(2, 15))
    u, v, w = random_graph(rng, n)
    want = np.full((n, n), np.inf)
    np.fill_diagonal(want, 0)
    for a, b, x in zip(u, v, w, strict=True):
        want[a, b] = want[b, a] = min(want[a, b], x)
    for _ in range(n):  # relax along every edge
        for a, b, x in zip(u, v, w, strict=True):
            want[a] = np.minimum(want[a], want[b] + x)
            want[b] = np.minimum(want[b], want[a] + x)
    assert np.allclose(layout.path_distances(n, u, v, w), want)


def test_parts_without_a_path_stay_finite():
    d = layout.path_distances(4, np.array([0, 2]), np.array([1, 3]), np.array([1.0, 2.0]))
    assert d[0, 2] == 3.0 and d[0, 1] == 1.0


@pytest.mark.parametrize("n", [3, 10, 25, 60])
def test_stress_falls(n):
    rng = np.random.default_rng(n)
    d = layout.path_distances(n, *random_graph(rng, n))
    xy, seen = layout.spring_layout(d)
    assert all(b <= a + 1e-9 * a for a, b in zip(seen, seen[1:], strict=False)) and seen[-1] < 0.7 * seen[0]
    assert seen[-1] == pytest.approx(layout.stress(xy, d))
    # No nudge of one node lowers it by much: a minimum, if a local one.
    for _ in range(50):
        other = xy.copy()
        other[rng.integers(n)] += rng.normal(0, 0.02, 2)
        assert layout.stress(other, d) > seen[-1] * 0.999


def test_stress_finds_a_drawing_that_fits():
    rng = np.random.default_rng(4)
    true = rng.uniform(-1, 1, (12, 2))
    xy, seen = layout.spring_layout(layout.gaps(true), rounds=5000, tolerance=0)
    assert seen[-1] < 1e-2 and np.abs(layout.gaps(xy) - layout.gaps(true)).max() < 0.3


@pytest.mark.parametrize("n", [1, 2, 3, 25, 150])
def test_positions_keep_apart(n):
    rng = np.random.default_rng(n)
    d = layout.path_distances(n, *random_graph(rng, n)) if n > 1 else np.zeros((1, 1))
    xy = layout.positions(d, rng.uniform(0, 1, n))
    assert xy.shape == (n, 2) and np.abs(xy).max() <= 1.3 + 1e-9
    if n > 1:
        assert layout.gaps(xy)[np.triu_indices(n, 1)].min() > 0.08


def test_nodes_at_one_place_part():
    assert layout.gaps(layout.spread_out(np.zeros((9, 2)), 0.1))[np.triu_indices(9, 1)].min() >= 0.1


def test_tables(spark):
    edges = spark.createDataFrame(
        pd.DataFrame({"window_id": [1, 1, 1, 2], "u": ["a", "a", "a", "b"], "v": ["b", "c", "d", "c"], "distance": [0.5, 1.0, 2.0, 0.0], "weight": [0.5, 1.0, 2.0, 0.0]}), "window_id int, u string, v string, distance double, weight double"
    )
    nodes = {(r.window_id, r.node): r for r in layout.node_layout(edges).collect()}
    assert len(nodes) == 6
    hub = nodes[1, "a"]
    assert hub.degree == 3 and hub.size == pytest.approx(1.3 * (140 + 1550)) and nodes[1, "d"].size == pytest.approx(1.3 * (140 + 1550 * 0.28 / 3))
    again = {(r.window_id, r.node): r for r in layout.node_layout(edges.repartition(5)).collect()}
    assert again == nodes
    pvalues = spark.createDataFrame([(1, "b", "a", 0.01), (1, "a", "c", 0.2)], "window_id int, asset_1 string, asset_2 string, pvalue double")
    lines = {(r.window_id, r.u, r.v): (r.width, r["style"]) for r in layout.edge_lines(edges, pvalues).collect()}
    assert lines == {
        (1, "a", "b"): (pytest.approx(1.12 * (0.8 + 2.6 * 1.8)), "solid"), (1, "a", "c"): (pytest.approx(1.12 * 3.4), "dashed"),
        (1, "a", "d"): (pytest.approx(1.12 * 2.1), "dashed"), (2, "b", "c"): (pytest.approx(1.12 * 3.4), "dashed"),
    }
