"""Per-window kernels in NumPy: trees, paths, centralities, communities, clusters, spectra, tests.

Each works on one window's small graph or matrix; ``grouped`` runs them with
one task per group of windows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .planarity import filtered_graph


def grouped(df: DataFrame, keys: list[str], kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``kernel`` on each group. A group is one window, bounded by the square of its assets, whatever the table's size."""
    return df.groupBy(*keys).applyInPandas(kernel, schema)


# Graphs as arrays: nodes sorted, edges as index pairs.


def indexed(e: pd.DataFrame) -> tuple[list, np.ndarray, np.ndarray]:
    nodes = sorted(set(e["u"]) | set(e["v"]))
    at = {x: k for k, x in enumerate(nodes)}
    return nodes, e["u"].map(at).to_numpy(), e["v"].map(at).to_numpy()


def neighbours(n: int, u: np.ndarray, v: np.ndarray) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(n)]
    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        out[a].append(b)
        out[b].append(a)
    return out


def ascending(e: pd.DataFrame) -> pd.DataFrame:
    """Edges by distance; ties, to 12 places as sums differ in the last by partitioning, by (u, v)."""
    order = np.lexsort((e["v"].to_numpy(str), e["u"].to_numpy(str), e["distance"].round(12).to_numpy()))
    return e.iloc[order]


def spanning_tree(e: pd.DataFrame) -> pd.DataFrame:
    """Edges of the minimum spanning forest."""
    e = ascending(e)
    nodes, u, v = indexed(e)
    root = list(range(len(nodes)))

    def find(a: int) -> int:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    kept = []
    for k, (a, b) in enumerate(zip(u.tolist(), v.tolist(), strict=True)):
        a, b = find(a), find(b)
        if a != b:
            root[a] = b
            kept.append(k)
    return e.iloc[kept]


def planar_filter(e: pd.DataFrame) -> pd.DataFrame:
    """Edges of the planar maximally filtered graph."""
    e = ascending(e)
    nodes, u, v = indexed(e)
    return e.iloc[filtered_graph(len(nodes), list(zip(u.tolist(), v.tolist(), strict=True)))]


EDGE_SCHEMA = "window_id int, u string, v string, distance double, weight double"
EDGE_COLUMNS = ["window_id", "u", "v", "distance", "weight"]


def minimum_spanning_trees(edges: DataFrame) -> DataFrame:
    return grouped(edges.select(*EDGE_COLUMNS), ["window_id"], spanning_tree, EDGE_SCHEMA)


def planar_graphs(edges: DataFrame) -> DataFrame:
    return grouped(edges.select(*EDGE_COLUMNS), ["window_id"], planar_filter, EDGE_SCHEMA)


def hops(adjacent: list[list[int]], start: int) -> list[int]:
    out = [-1] * len(adjacent)
    out[start], ring = 0, [start]
    while ring:
        ring = [w for v in ring for w in adjacent[v] if out[w] < 0 and not out.__setitem__(w, out[v] + 1)]
    return out


def betweenness(adjacent: list[list[int]]) -> np.ndarray:
    """Share of shortest paths through each node (Brandes' accumulation), over (n - 1)(n - 2) / 2 pairs."""
    n = len(adjacent)
    total = np.zeros(n)
    for s in range(n):
        order, paths, dist, before = [], [0] * n, [-1] * n, [[] for _ in range(n)]
        paths[s], dist[s] = 1, 0
        ring = [s]
        while ring:
            following = []
            for v in ring:
                order.append(v)
                for w in adjacent[v]:
                    if dist[w] < 0:
                        dist[w] = dist[v] + 1
                        following.append(w)
                    if dist[w] == dist[v] + 1:
                        paths[w] += paths[v]
                        before[w].append(v)
            ring = following
        share = [0.0] * n
        for w in reversed(order):
            for v in before[w]:
                share[v] += paths[v] / paths[w] * (1 + share[w])
            if w != s:
                total[w] += share[w]
    return total / ((n - 1) * (n - 2)) if n > 2 else total


def closeness(adjacent: list[list[int]]) -> np.ndarray:
    """Reachable others over their hops, scaled by the share of nodes reachable."""
    n, out = len(adjacent), np.zeros(len(adjacent))
    for v in range(n):
        d = [x for x in hops(adjacent, v) if x > 0]
        if d and n > 1:
            out[v] = len(d) / sum(d) * len(d) / (n - 1)
    return out


def eigenvector(adjacent: list[list[int]], rounds: int = 1000, tolerance: float = 1e-6) -> np.ndarray:
    """Power iteration on A + I with unit length; zeros if it doesn't settle."""
    n = len(adjacent)
    a = np.eye(n)
    for v, ws in enumerate(adjacent):
        a[v, ws] += 1
    x = np.full(n, 1 / n)
    for _ in range(rounds):
        y = a @ x
        y /= np.linalg.norm(y) or 1.0
        if np.abs(y - x).sum() < n * tolerance:
            return y
        x = y
    return np.zeros(n)


def centralities(edges: DataFrame, tolerance: float = 1e-6, rounds: int = 1000) -> DataFrame:
    """Node metrics of each window; ``tolerance`` and ``rounds`` bound the power iteration of the eigenvector."""

    def of(e: pd.DataFrame) -> pd.DataFrame:
        nodes, u, v = indexed(e)
        adj = neighbours(len(nodes), u, v)
        deg = np.array([len(x) for x in adj])
        return pd.DataFrame({
            "window_id": e["window_id"].iloc[0], "node": nodes, "degree": deg, "degree_centrality": deg / max(len(nodes) - 1, 1),
            "betweenness_centrality": betweenness(adj), "closeness_centrality": closeness(adj), "eigenvector_centrality": eigenvector(adj, rounds, tolerance),
        })

    return grouped(edges.select(*EDGE_COLUMNS), ["window_id"], of, "window_id int, node string, degree int, degree_centrality double, betweenness_centrality double, closeness_centrality double, eigenvector_centrality double")


def path_lengths(edges: DataFrame) -> DataFrame:
    """Per window mean hops and diameter of the largest component (of equals, that with the least node)."""

    def of(e: pd.DataFrame) -> pd.DataFrame:
        nodes, u, v = indexed(e)
        adj, best, seen = neighbours(len(nodes), u, v), [], set()
        for v0 in range(len(nodes)):
            if v0 not in seen:
                part = [k for k, d in enumerate(hops(adj, v0)) if d >= 0]
                seen.update(part)
                best = part if len(part) > len(best) else best
        d = [x for v0 in best for x in hops(adj, v0) if x > 0]
        return pd.DataFrame({"window_id": [e["window_id"].iloc[0]], "mean_path": [sum(d) / len(d) if d else None], "diameter": [max(d) if d else None]})

    return grouped(edges.select(*EDGE_COLUMNS), ["window_id"], of, "window_id int, mean_path double, diameter int")


def partition_quality(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray, label: np.ndarray) -> float:
    m = w.sum()
    if m <= 0:
        return 0.0
    deg = np.bincount(u, w, n) + np.bincount(v, w, n)
    inner = w[label[u] == label[v]].sum() / m
    return float(inner - (np.bincount(label, deg) ** 2).sum() / (4 * m * m))


def louvain(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Communities by greedy modularity, level by level. Nodes are visited in order; a tie goes to the least community."""
    part = np.arange(n)
    u, v, w = u.copy(), v.copy(), w.astype(float).copy()
    while True:
        k = int(part.max()) + 1 if n else 0
        links: list[dict[int, float]] = [{} for _ in range(k)]
        own = np.zeros(k)
        for a, b, x in zip(u.tolist(), v.tolist(), w.tolist(), strict=True):
            if a == b:
                own[a] += x
            else:
                links[a][b] = links[a].get(b, 0.0) + x
                links[b][a] = links[b].get(a, 0.0) + x
        deg = np.array([sum(x.values()) for x in links]) + 2 * own
        two_m = deg.sum()
        if two_m <= 0:
            return _dense(part)
        com, total, moved_any = list(range(k)), deg.copy(), False
        for _ in range(100):
            moved = False
            for a in range(k):
                near: dict[int, float] = {}
                for b, x in links[a].items():
                    near[com[b]] = near.get(com[b], 0.0) + x
                c = com[a]
                total[c] -= deg[a]
                best, gain = c, near.get(c, 0.0) - deg[a] * total[c] / two_m
                for d in sorted(near):
                    g = near[d] - deg[a] * total[d] / two_m
                    if g > gain + 1e-12:
                        best, gain = d, g
                total[best] += deg[a]
                if best != c:
                    com[a], moved, moved_any = best, True, True
            if not moved:
                break
        if not moved_any:
            return _dense(part)
        com = _dense(np.array(com))
        part, u, v = com[part], com[u], com[v]


def _dense(label: np.ndarray) -> np.ndarray:
    """Labels 0, 1, ... in order of first appearance."""
    seen: dict[int, int] = {}
    return np.array([seen.setdefault(int(x), len(seen)) for x in label], dtype=int)


def label_propagation(n: int, u: np.ndarray, v: np.ndarray, rounds: int = 100) -> np.ndarray:
    adj, label = neighbours(n, u, v), list(range(n))
    for _ in range(rounds):
        before = list(label)
        for a in range(n):
            if adj[a]:
                count: dict[int, int] = {}
                for b in adj[a]:
                    count[label[b]] = count.get(label[b], 0) + 1
                most = max(count.values())
                label[a] = label[a] if count.get(label[a]) == most else min(c for c, x in count.items() if x == most)
        if label == before:
            break
    return _dense(np.array(label, dtype=int))


def communities(edges: DataFrame, method: str = "louvain", weight: str = "distance") -> DataFrame:
    """(window_id, node, community). By default heavier means farther, as edges are weighted by distance."""

    def of(e: pd.DataFrame) -> pd.DataFrame:
        nodes, u, v = indexed(e)
        label = louvain(len(nodes), u, v, e[weight].to_numpy()) if method == "louvain" else label_propagation(len(nodes), u, v)
        return pd.DataFrame({"window_id": e["window_id"].iloc[0], "node": nodes, "community": label})

    return grouped(edges.select(*EDGE_COLUMNS), ["window_id"], of, "window_id int, node string, community int")


# Hierarchical clustering.


def linkage(d: np.ndarray, method: str) -> np.ndarray:
    """Merges (left, right, height, size), heights rising; for ward ``d`` holds Euclidean distances.

    A chain goes from a cluster to its nearest and on, each step nearer than
    the last, until two are each other's nearest. Under these methods a merge
    elsewhere never comes between such two, so they merge at once and the
    chain goes on from what is left of it: some 3 n looks along a row, n^2 in
    all. Distances of a merged cluster follow Lance and Williams' recurrences;
    merges are sorted by height at the end. Of equally near clusters the one
    before in the chain is taken, else the first.
    """
    if method not in ("average", "complete", "ward"):
        raise ValueError(f"unknown linkage {method}")
    n = len(d)
    d = d.astype(float).copy()
    if method == "ward":
        d **= 2
    np.fill_diagonal(d, np.inf)
    size, alive = np.ones(n), np.ones(n, bool)
    made: list[tuple[float, int, int]] = []
    chain: list[int] = []
    while len(made) < n - 1:
        if not chain:
            chain.append(int(np.argmax(alive)))
        x = chain[-1]
        y = int(np.argmin(d[x]))
        if len(chain) > 1 and d[x, chain[-2]] <= d[x, y]:
            y = chain[-2]
        if len(chain) < 2 or y != chain[-2]:
            chain.append(y)
            continue
        del chain[-2:]
        i, j, h = min(x, y), max(x, y), d[x, y]
        others = alive.copy()
        others[[i, j]] = False
        di, dj = d[i, others], d[j, others]
        if method == "average":
            new = (size[i] * di + size[j] * dj) / (size[i] + size[j])
        elif method == "complete":
            new = np.maximum(di, dj)
        else:
            k = size[others]
            new = ((size[i] + k) * di + (size[j] + k) * dj - k * h) / (size[i] + size[j] + k)
        d[i, others] = d[others, i] = new
        d[j], d[:, j] = np.inf, np.inf
        alive[j] = False
        size[i] += size[j]
        made.append((h, i, j))
    out = np.zeros((max(n - 1, 0), 4))
    root, name, count = list(range(n)), list(range(n)), [1] * n
    for step, (h, i, j) in enumerate(sorted(made, key=lambda m: m[0])):
        a, b = _root(root, i), _root(root, j)
        out[step] = min(name[a], name[b]), max(name[a], name[b]), math.sqrt(h) if method == "ward" else h, count[a] + count[b]
        root[b], name[a] = a, n + step
        count[a] += count[b]
    return out


def _root(root: list[int], a: int) -> int:
    while root[a] != a:
        root[a] = root[root[a]]
        a = root[a]
    return a


def cut_tree(merges: np.ndarray, n: int, k: int) -> np.ndarray:
    """Labels 0 .. k - 1 after all but the last k - 1 merges."""
    root = list(range(2 * n))

    def find(a: int) -> int:
        while root[a] != a:
            a = root[a]
        return a

    for step in range(n - k):
        a, b = int(merges[step, 0]), int(merges[step, 1])
        root[find(a)] = root[find(b)] = n + step
    return _dense(np.array([find(x) for x in range(n)]))


def silhouette(d: np.ndarray, label: np.ndarray) -> float:
    k = label.max() + 1
    if not 2 <= k < len(label):
        return math.nan
    one = np.eye(k)[label]
    size = one.sum(0)
    sums = d @ one
    own = size[label] - 1
    inner = np.where(own > 0, sums[np.arange(len(label)), label] / np.maximum(own, 1), 0.0)
    mean = sums / size
    mean[np.arange(len(label)), label] = np.inf
    outer = mean.min(1)
    top = np.maximum(inner, outer)
    return float(np.where((own > 0) & (top > 0), (outer - inner) / np.where(top > 0, top, 1), 0.0).mean())


def square(p: pd.DataFrame, value: str, diagonal: float) -> tuple[list, np.ndarray]:
    """One window's pairs as a symmetric matrix; a missing pair is undefined."""
    names = sorted(set(p["asset_1"]) | set(p["asset_2"]))
    at = {x: k for k, x in enumerate(names)}
    m = np.full((len(names), len(names)), np.nan)
    i, j = p["asset_1"].map(at).to_numpy(), p["asset_2"].map(at).to_numpy()
    m[i, j] = m[j, i] = p[value].to_numpy(dtype=float)
    np.fill_diagonal(m, diagonal)
    return names, m


def _euclid(x: np.ndarray) -> np.ndarray:
    s = (x * x).sum(1)
    return np.sqrt(np.maximum(s[:, None] + s[None] - 2 * x @ x.T, 0))


def best_cut(d: np.ndarray, method: str, n: int, max_k: int) -> tuple[int | None, float | None, np.ndarray | None]:
    """Of a linkage's cuts into 2 .. min(max_k, n - 1) groups the least k of the best silhouette: (k, silhouette, labels)."""
    tree = linkage(d, method)
    best = max(((silhouette(d, lab), -k, lab) for k in range(2, min(max_k, n - 1) + 1) for lab in [cut_tree(tree, n, k)]), key=lambda x: (x[0], x[1]), default=None)
    return (-best[1], best[0], best[2]) if best else (None, None, None)


def cross_method(pairs: DataFrame, max_k: int = 10) -> DataFrame:
    """Per window and linkage, on the rows of the correlation matrix: k of the best silhouette, that, and modularity on positive correlations."""

    def of(p: pd.DataFrame) -> pd.DataFrame:
        names, rho = square(p, "rho", 1.0)
        rho = np.where(np.isnan(rho), 1.0, rho)
        n, d = len(names), _euclid(rho)
        u, v = np.triu_indices(n, 1)
        w = np.maximum(rho[u, v], 0)
        rows = []
        for method in ("ward", "average", "complete"):
            k, s, label = best_cut(d, method, n, max_k)
            rows.append((p["window_id"].iloc[0], method, k, s, None if label is None else partition_quality(n, u, v, w, label)))
        return pd.DataFrame(rows, columns=["window_id", "method", "best_k", "silhouette", "modularity"])

    return grouped(pairs.select("window_id", "asset_1", "asset_2", "rho"), ["window_id"], of, "window_id int, method string, best_k int, silhouette double, modularity double")


def leaf_order(tree: np.ndarray, n: int) -> list[int]:
    """The leaves from left to right, each merge's left side first."""
    out, todo = [], [2 * n - 2] if n > 1 else [0]
    while todo:
        k = todo.pop()
        if k < n:
            out.append(k)
        else:
            todo += [int(tree[k - n, 1]), int(tree[k - n, 0])]
    return out


def dendrogram_groups(pairs: DataFrame, max_k: int = 8) -> DataFrame:
    """Per window and asset: its place in Ward's dendrogram and its group in the best cut, with that cut's k, silhouette and modularity.

    k is tried from 2 to min(max_k, max(2, n - 1)); two assets are one group
    and their silhouette undefined. Modularity is of the positive correlations,
    the diagonal among them.
    """

    def of(p: pd.DataFrame) -> pd.DataFrame:
        names, rho = square(p, "rho", 1.0)
        rho = np.where(np.isnan(rho), 1.0, rho)
        n, d = len(names), _euclid(rho)
        tree = linkage(d, "ward")
        best = (None, 2, np.ones(n, int))
        if n >= 3:
            for k in range(2, min(max_k, max(2, n - 1)) + 1):
                label = cut_tree(tree, n, k)
                s = silhouette(d, label)
                if best[0] is None or s > best[0]:
                    best = (s, k, label)
        u, v = np.triu_indices(n)
        q = partition_quality(n, u, v, np.maximum(rho[u, v], 0), best[2])
        place = np.argsort(leaf_order(tree, n))
        return pd.DataFrame({"window_id": p["window_id"].iloc[0], "node": names, "place": place + 1, "community": np.asarray(best[2], int), "best_k": best[1], "silhouette": best[0], "modularity": q})

    return grouped(pairs.select("window_id", "asset_1", "asset_2", "rho"), ["window_id"], of, "window_id int, node string, place int, community int, best_k int, silhouette double, modularity double")


def clusters(pairs: DataFrame, k: int = 5) -> DataFrame:
    """Average linkage on distances, cut into at most k clusters: (window_id, node, community)."""

    def of(p: pd.DataFrame) -> pd.DataFrame:
        names, d = square(p, "distance", 0.0)
        d = np.where(np.isnan(d), np.nanmax(d), d)
        return pd.DataFrame({"window_id": p["window_id"].iloc[0], "node": names, "community": cut_tree(linkage(d, "average"), len(names), min(k, len(names)))})

    return grouped(pairs.select("window_id", "asset_1", "asset_2", "distance"), ["window_id"], of, "window_id int, node string, community int")


def ward_merges(pairs: DataFrame) -> DataFrame:
    """The dendrogram: (window_id, step, left_node, right_node, height, size)."""

    def of(p: pd.DataFrame) -> pd.DataFrame:
        names, rho = square(p, "rho", 1.0)
        t = linkage(_euclid(np.where(np.isnan(rho), 1.0, rho)), "ward")
        return pd.DataFrame({"window_id": p["window_id"].iloc[0], "step": range(1, len(t) + 1), "left_node": t[:, 0].astype(int), "right_node": t[:, 1].astype(int), "height": t[:, 2], "size": t[:, 3].astype(int)})

    return grouped(pairs.select("window_id", "asset_1", "asset_2", "rho"), ["window_id"], of, "window_id int, step int, left_node int, right_node int, height double, size int")


# Spectra and tests.


def marchenko_pastur(pairs: DataFrame, observations: DataFrame) -> DataFrame:
    """Per window: eigenvalues of the correlation matrix against the noise band of N assets and W observations."""

    def of(p: pd.DataFrame) -> pd.DataFrame:
        names, rho = square(p, "rho", 1.0)
        n, w = len(names), int(p["n_obs"].iloc[0])
        base = {"window_id": p["window_id"].iloc[0], "n_assets": n, "n_obs": w}
        if n < 2 or w <= n:
            return pd.DataFrame([base | {"q": n / w if w else None, "lambda_minus": None, "lambda_plus": None, "lambda_max": None, "n_signal": 0, "n_noise": n, "signal_share": 0.0, "market_share": None, "lambda_sum": None}])
        q = n / w
        lam = np.maximum(np.linalg.eigvalsh(np.where(np.isnan(rho), 0.0, rho)), 0)
        top = (1 + math.sqrt(q)) ** 2
        return pd.DataFrame([base | {"q": q, "lambda_minus": (1 - math.sqrt(q)) ** 2, "lambda_plus": top, "lambda_max": lam.max(), "n_signal": int((lam > top).sum()), "n_noise": int((lam <= top).sum()), "signal_share": lam[lam > top].sum() / lam.sum(), "market_share": lam.max() / lam.sum(), "lambda_sum": lam.sum()}])

    rows = pairs.select("window_id", "asset_1", "asset_2", "rho").join(observations, "window_id")
    return grouped(rows, ["window_id"], of, "window_id int, n_assets int, n_obs int, q double, lambda_minus double, lambda_plus double, lambda_max double, n_signal int, n_noise int, signal_share double, market_share double, lambda_sum double")


def kolmogorov_sf(x: float) -> float:
    """The limit law's upper tail; the dual series serves small x, where the direct one is slow."""
    if x <= 0:
        return 1.0
    if x < 1.0:
        t = math.exp(-math.pi**2 / (8 * x * x))
        return max(0.0, 1 - math.sqrt(2 * math.pi) / x * sum(t ** ((2 * k - 1) ** 2) for k in range(1, 8)))
    return min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 30)))


#: Values of the larger sample up to which a gap's p-value is exact.
EXACT_VALUES = 10_000


@functools.lru_cache(maxsize=4096)
def gap_sf(m: int, n: int, h: int) -> float:
    """P(gap >= h / (m n)) of two samples of m and n values in random order, exactly.

    The merged order is a walk: with i of the first sample and j of the second
    passed, the next value is of the first with chance (m - i) / (m + n - i - j).
    The mass that reaches |i n - j m| >= h at some step is summed up.
    """
    i = np.arange(m + 1)
    at, out = np.zeros(m + 1), 0.0
    at[0] = 1.0
    for step in range(m + n):
        j = step - i
        here = (j >= 0) & (j <= n)
        first = np.where(here, (m - i) / (m + n - step), 0.0)
        moved = at * first
        at = at - moved
        at[1:] += moved[:-1]
        off = np.abs(i * n - (step + 1 - i) * m) >= h
        out += at[off].sum()
        at[off] = 0.0
    return float(min(out, 1.0))


def ks_two_sample(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """The largest gap of two empirical distributions, and its p-value: exact up to EXACT_VALUES values, else that of the limit law."""
    a, b = np.sort(a), np.sort(b)
    m, n = len(a), len(b)
    both = np.concatenate([a, b])
    h = int(np.abs(np.searchsorted(a, both, "right") * n - np.searchsorted(b, both, "right") * m).max())
    d = h / (m * n)
    return d, gap_sf(m, n, h) if max(m, n) <= EXACT_VALUES else kolmogorov_sf(d * math.sqrt(m * n / (m + n)))


def ks_between(rows: DataFrame, value: str) -> DataFrame:
    """Per window the test of its values of side 0 against those of side 1; null where one side has none."""

    def of(g: pd.DataFrame) -> pd.DataFrame:
        a, b = [g.loc[g["side"] == s, value].dropna().to_numpy(float) for s in (0, 1)]
        got = ks_two_sample(a, b) if len(a) and len(b) else (None, None)
        return pd.DataFrame([(g["window_id"].iloc[0], *got)], columns=["window_id", "ks_stat", "ks_pvalue"])

    return grouped(rows.select("window_id", "side", value), ["window_id"], of, "window_id int, ks_stat double, ks_pvalue double")


def ks_against_noise(pairs: DataFrame, observations: DataFrame) -> DataFrame:
    """Per window: correlations against those of as many independent Gaussian series, drawn with the window's number as seed."""

    def of(p: pd.DataFrame) -> pd.DataFrame:
        names, rho = square(p, "rho", 1.0)
        n, w = len(names), int(p["n_obs"].iloc[0])
        out = {"window_id": p["window_id"].iloc[0], "ks_stat": None, "ks_pvalue": None}
        if n >= 2 and w >= 2:
            noise = np.corrcoef(np.random.default_rng(int(out["window_id"])).normal(size=(w, n)), rowvar=False)
            at = np.triu_indices(n, 1)
            x = rho[at]
            x = x[~np.isnan(x)]
            if len(x):
                out["ks_stat"], out["ks_pvalue"] = ks_two_sample(x, noise[at])
        return pd.DataFrame([out])

    rows = pairs.select("window_id", "asset_1", "asset_2", "rho").join(observations, "window_id")
    return grouped(rows, ["window_id"], of, "window_id int, ks_stat double, ks_pvalue double")


#: MacKinnon (1994) response surface of the test with a constant: fixed published values.
#: Beyond tau_max p is 1, below tau_min 0; small p up to tau_star, large p above.
TAU_MAX, TAU_MIN, TAU_STAR = 2.74, -18.83, -1.61
SMALL_P = (2.1659, 1.4412, 0.038269)
LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)


def mackinnon_p(tau: float) -> float:
    if tau > TAU_MAX:
        return 1.0
    if tau < TAU_MIN:
        return 0.0
    z = sum(c * tau**k for k, c in enumerate(SMALL_P if tau <= TAU_STAR else LARGE_P))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _ols(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """AIC, and t of the first coefficient."""
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    r = y - x @ beta
    n, k = x.shape
    s2 = r @ r / max(n - k, 1)
    cov = np.linalg.pinv(x.T @ x)
    se = math.sqrt(max(s2 * cov[0, 0], 0))
    ll = -n / 2 * (math.log(2 * math.pi) + math.log(max(r @ r / n, 1e-300)) + 1)
    return -2 * ll + 2 * k, float(beta[0] / se) if se > 0 else math.nan


def dickey_fuller(x: np.ndarray, lags: int | None = None) -> tuple[float, float] | None:
    """Augmented test with a constant, lags by AIC up to 12 (n / 100)^(1/4), or up to ``lags``: (statistic, p), or None for a short or constant series."""
    n = len(x)
    most = min(math.ceil(12 * (n / 100) ** 0.25) if lags is None else lags, n // 2 - 2)
    if n < 10 or most < 0 or np.ptp(x) == 0:
        return None
    x = x - x.mean()  # the constant takes it up
    dx = np.diff(x)

    def design(own: int, first: int) -> tuple[np.ndarray, np.ndarray]:
        rows = np.arange(first, len(dx))
        return np.column_stack([x[rows], np.ones(len(rows)), *[dx[rows - k] for k in range(1, own + 1)]]), dx[rows]

    best = _least_aic(*design(most, most))
    _, t = _ols(*design(best, best))
    return None if math.isnan(t) else (t, mackinnon_p(t))


def _least_aic(z: np.ndarray, y: np.ndarray, always: int = 2) -> int:
    """How many columns behind the first ``always`` give the least AIC: all regressions are leading blocks of one product."""
    gram, right, whole = z.T @ z, z.T @ y, y @ y

    def aic(k: int) -> float:
        try:
            rest = whole - right[:k] @ np.linalg.solve(gram[:k, :k], right[:k])
        except np.linalg.LinAlgError:  # columns that depend on each other
            rest = ((y - z[:, :k] @ np.linalg.lstsq(z[:, :k], y, rcond=None)[0]) ** 2).sum()
        return len(y) * math.log(max(rest, 1e-14 * whole, 1e-300)) + 2 * k

    return int(np.argmin([aic(k) for k in range(always, z.shape[1] + 1)]))


def stationarity(df: DataFrame, keys: list[str], date_col: str, value: str, schema: str, lags: int | None = None) -> DataFrame:
    """Per key the Dickey-Fuller test of its series in date order: statistic, p-value, stationary at 5 %, verdict."""

    def of(g: pd.DataFrame) -> pd.DataFrame:
        x = g.sort_values(date_col)[value].dropna().to_numpy(dtype=float)
        got = dickey_fuller(x, lags) if len(x) >= 10 else None
        verdict = "INSUFICIENTE" if len(x) < 10 else "ERRO" if got is None else "SIM" if got[1] < 0.05 else "NAO"
        return pd.DataFrame([{k: g[k].iloc[0] for k in keys} | {"adf_stat": got and got[0], "adf_pvalue": got and got[1], "adf_stationary": got and got[1] < 0.05, "verdict": verdict}])

    return grouped(df.select(*keys, date_col, value), keys, of, f"{schema}, adf_stat double, adf_pvalue double, adf_stationary boolean, verdict string")


def student_sf2(t: np.ndarray, df: int) -> np.ndarray:
    """Two-sided tail of Student's t for whole degrees of freedom, by the finite series in the angle atan(t / sqrt(df))."""
    a = np.arctan(np.asarray(t, float) / math.sqrt(df))
    cos2, odd = np.cos(a) ** 2, df % 2
    term, total = np.cos(a) if odd else np.ones_like(a), np.zeros_like(a)
    for k in range(1, (df - 1) // 2 + 1 if odd else df // 2 + 1):
        total += term
        term = term * cos2 * ((2 * k) / (2 * k + 1) if odd else (2 * k - 1) / (2 * k))
    inner = 2 / math.pi * (a + np.sin(a) * total) if odd else np.sin(a) * total
    return np.maximum(1 - np.abs(inner), 0.0)


#: Rows of a window's bundle: what was tested, of which pair, asset or method, and one number of it.
BUNDLE = "window_id int, part string, name_1 string, name_2 string, metric string, value double"


def window_bundle(pairs: DataFrame, returns: DataFrame, done: DataFrame | None = None, asset: str = "asset", date_col: str = "obs_date", value: str = "log_return") -> DataFrame:
    """All that is computed of a window from one look at both its sides: (window_id, part, name_1, name_2, metric, value).

    pvalue: correlation and p-value of each pair; an unknown correlation is 1.
    ks: the correlations against noise of the window's seed. mp: the spectrum
    against the noise band. adf: the unit-root test of each series that has
    ten values, but for keys in ``done`` (window_id, asset). cross: the best
    cut of each linkage. summary: Ward's. Observations are those of the longest
    series, 252 without any. Under two assets there are null ks and summary
    rows only; a window without pairs has no rows.
    """
    rows = returns if done is None else returns.join(done.select("window_id", asset).withColumn("_done", F.lit(True)), ["window_id", asset], "left")
    rows = rows.select("window_id", asset, date_col, value, F.coalesce(F.col("_done"), F.lit(False)).alias("_done") if done is not None else F.lit(False).alias("_done"))

    def of(p: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(p):
            window = int(p["window_id"].iloc[0])
            names, rho = square(p, "rho", 1.0)
            rho = np.where(np.isnan(rho), 1.0, rho)
            n = len(names)
            series = {str(a): g.sort_values(date_col)[value].to_numpy(float) for a, g in r.groupby(asset)} if len(r) else {}
            w = max((int((~np.isnan(x)).sum()) for x in series.values()), default=252)
            u, v = np.triu_indices(n, 1)
            x = rho[u, v]
            df = max(w - 2, 1)
            tail = student_sf2(np.abs(x) * np.sqrt(df / np.maximum(1 - x * x, 1e-12)), df)
            for i, j, c, q in zip(u, v, x, tail, strict=True):
                out += [(window, "pvalue", names[i], names[j], "rho", c), (window, "pvalue", names[i], names[j], "pvalue", q)]
            noise = np.corrcoef(np.random.default_rng(window).normal(size=(w, n)), rowvar=False) if w >= 2 else None
            gap = ks_two_sample(x, noise[u, v]) if noise is not None else (None, None)
            out += [(window, "ks", None, None, "ks_stat", gap[0]), (window, "ks", None, None, "ks_pvalue", gap[1])]
            if w > n:
                q, lam = n / w, np.maximum(np.linalg.eigvalsh(rho), 0)
                top = (1 + math.sqrt(q)) ** 2
                numbers = {"n_assets": n, "n_obs": w, "q": q, "lambda_plus": top, "lambda_max": lam.max(), "n_signal": (lam > top).sum(), "n_noise": (lam <= top).sum(), "signal_share": lam[lam > top].sum() / lam.sum(), "market_share": lam.max() / lam.sum()}
            else:
                numbers = {"n_assets": n, "n_obs": w, "q": n / w if w else None, "n_signal": 0, "n_noise": n, "signal_share": 0.0}
            out += [(window, "mp", None, None, k, float(x) if x is not None else None) for k, x in numbers.items()]
            skip = set(r.loc[r["_done"], asset]) if len(r) else set()
            for a in names:
                got = dickey_fuller(y) if a in series and a not in skip and len(y := series[a][~np.isnan(series[a])]) >= 10 else None
                out += [(window, "adf", a, None, m, x) for m, x in zip(("adf_stat", "adf_pvalue"), got or (), strict=False)]
            d, pairs_w = _euclid(rho), np.maximum(x, 0)
            for method in ("ward", "average", "complete"):
                best = best_cut(d, method, n, 10)
                cut = {"best_k": best[0], "silhouette": best[1], "modularity": partition_quality(n, u, v, pairs_w, best[2]) if best[2] is not None else None}
                out += [(window, "cross", method, None, k, x) for k, x in cut.items()]
                if method == "ward":
                    out += [(window, "summary", None, None, f"ward_{k}", x) for k, x in cut.items()]
        table = pd.DataFrame(out, columns=["window_id", "part", "name_1", "name_2", "metric", "value"])
        return table.astype({"value": float})

    a, b = pairs.select("window_id", "asset_1", "asset_2", "rho").groupBy("window_id"), rows.groupBy("window_id")
    return a.cogroup(b).applyInPandas(of, BUNDLE)


# Surfaces.


def _reflected(x: np.ndarray, sigma: float, truncate: float = 4.0) -> np.ndarray:
    """A Gaussian filter along the first axis, edges reflected with the edge value twice."""
    radius = int(truncate * sigma + 0.5)
    weights = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    n = len(x)
    at = (np.arange(n)[:, None] + np.arange(-radius, radius + 1)) % (2 * n)
    return np.einsum("ikj,k->ij", x[np.where(at < n, at, 2 * n - 1 - at)], weights / weights.sum())


def _spline(x: np.ndarray, size: int) -> np.ndarray:
    """The cubic spline through the rows of ``x`` at ``size`` even places from the first row to the last, mirrored at the ends."""
    n = len(x)
    if n == 1:
        return np.repeat(x, size, 0)
    m = np.diag(np.full(n, 4.0)) + np.diag(np.ones(n - 1), 1) + np.diag(np.ones(n - 1), -1)
    m[0, 1] = m[-1, -2] = 2.0
    c = np.linalg.solve(m / 6, x)
    at = np.linspace(0, n - 1, size)
    base = np.minimum(np.floor(at).astype(int), n - 2)
    f = (at - base)[:, None]
    parts = ((1 - f) ** 3 / 6, (3 * f**3 - 6 * f**2 + 4) / 6, (-3 * f**3 + 3 * f**2 + 3 * f + 1) / 6, f**3 / 6)

    def row(k: np.ndarray) -> np.ndarray:
        k = np.abs(k)
        return np.where(k > n - 1, 2 * (n - 1) - k, k)

    return sum(w * c[row(base + k)] for k, w in zip((-1, 0, 1, 2), parts, strict=True))


def _numbered(df: DataFrame, axis: str, place: str, size: str) -> DataFrame:
    """An axis's distinct values with their places from 0, and how many they are: one row a value, as many as the figure has lines."""
    values = df.select(axis).distinct()
    return values.select(axis, (F.row_number().over(Window.orderBy(axis)) - 1).alias(place), F.count(F.lit(1)).over(Window.partitionBy()).cast("int").alias(size))


def _along(df: DataFrame, own: str, other: str, sizes: tuple[str, str], value: str, sigma: float, zoom: float) -> DataFrame:
    """Smooth and refine along the axis ``own``, for each place of ``other`` by itself; an absent cell is 0."""

    def of(g: pd.DataFrame) -> pd.DataFrame:
        n = int(g[sizes[0]].iloc[0])
        x = np.zeros((n, 1))
        x[g[own].to_numpy()] = g[[value]].fillna(0.0).to_numpy(float)
        x = _reflected(x, sigma)
        if zoom != 1:
            x = _spline(x, round(n * zoom))
        return pd.DataFrame({own: np.arange(len(x)), other: g[other].iloc[0], sizes[1]: g[sizes[1]].iloc[0], value: x[:, 0]})

    return df.select(own, other, *sizes, value).groupBy(other).applyInPandas(of, f"{own} int, {other} int, {sizes[1]} int, {value} double")


def smoothed_surface(df: DataFrame, row: str, column: str, value: str, sigma: tuple[float, float] = (2.2, 2.8), zoom: tuple[int, int] = (3, 2), top: float | None = 5.0) -> DataFrame:
    """A grid of values, smoothed along both axes, refined by a cubic spline, and clipped to 0 .. ``top``: (row, column, value) from 1.

    Filter and spline act on each axis alone, so the columns are treated one
    by one and then the rows, each a group of one line of the grid; no task
    has the whole of it. An absent value is 0, the mean stands for several of
    a cell. Zoom (1, 1) leaves the smoothed grid as it is.
    """
    cells = df.groupBy(row, column).agg(F.avg(value).alias("_v"))
    cells = cells.join(F.broadcast(_numbered(df, row, "_r", "_rows")), row).join(F.broadcast(_numbered(df, column, "_c", "_columns")), column)
    down = _along(cells, "_r", "_c", ("_rows", "_columns"), "_v", sigma[0], zoom[0])
    both = _along(down.withColumn("_rows", F.lit(0)), "_c", "_r", ("_columns", "_rows"), "_v", sigma[1], zoom[1])
    z = F.col("_v") if top is None else F.greatest(F.least("_v", F.lit(float(top))), F.lit(0.0))
    return both.select((F.col("_r") + 1).alias(row), (F.col("_c") + 1).alias(column), z.alias(value))


# Null models.


def random_distances(n: int, rng: np.random.Generator) -> np.ndarray:
    """A symmetric matrix of uniform draws, averaged with its transpose, over its largest value; zero diagonal."""
    m = rng.uniform(size=(n, n))
    m = (m + m.T) / 2
    np.fill_diagonal(m, 0)
    return m / m.max() if n > 1 else m


def random_edges(n: int, m: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Exactly m of the pairs, uniformly."""
    u, v = np.triu_indices(n, 1)
    pick = np.sort(rng.choice(len(u), m, replace=False))
    return u[pick], v[pick]


def configuration_edges(degree: Sequence[int], rng: np.random.Generator) -> list[tuple[int, int]]:
    """Stubs matched at random, made a simple graph; an odd sum gets one more stub."""
    stubs = np.repeat(np.arange(len(degree)), degree)
    if len(stubs) % 2:
        stubs = np.r_[stubs, 0]
    rng.shuffle(stubs)
    return sorted({(min(a, b), max(a, b)) for a, b in stubs.reshape(-1, 2).tolist() if a != b})


def swapped_edges(u: np.ndarray, v: np.ndarray, rng: np.random.Generator, swaps: int = 10) -> list[tuple[int, int]]:
    """Double edge swaps, ``swaps`` times the edges in at most ten times as many tries; degrees stay."""
    e = [(int(min(a, b)), int(max(a, b))) for a, b in zip(u, v, strict=True)]
    have, m = set(e), len(e)
    done = 0
    tries = (x for _ in range(10 * swaps) for x in rng.integers(0, (m, m, 2), (m, 3)).tolist())
    for i, j, turned in tries if m > 1 else ():
        if done >= swaps * m:
            break
        (a, b), (c, d) = e[i], e[j]
        if turned:
            c, d = d, c
        x, y = (min(a, d), max(a, d)), (min(c, b), max(c, b))
        if len({a, b, c, d}) == 4 and x not in have and y not in have:
            have -= {e[i], e[j]}
            have |= {x, y}
            e[i], e[j] = x, y
            done += 1
    return sorted(e)


def null_graphs(edges: DataFrame) -> DataFrame:
    """One graph of each null model per window, drawn with its number as seed: (window_id, model, u, v), u < v.

    random: as many edges, anywhere. configuration: stubs matched at random,
    loops and repeats dropped. swapped: the window's own edges, swapped in
    pairs, so degrees stay.
    """

    def of(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["u", "v"])
        nodes, u, v = indexed(g)
        window = int(g["window_id"].iloc[0])
        rng = np.random.default_rng(window)
        drawn = {"random": list(zip(*random_edges(len(nodes), len(u), rng), strict=True)), "configuration": configuration_edges(np.bincount(np.r_[u, v], minlength=len(nodes)), rng), "swapped": swapped_edges(u, v, rng)}
        return pd.DataFrame([(window, m, *sorted((nodes[a], nodes[b]))) for m, e in drawn.items() for a, b in e], columns=["window_id", "model", "u", "v"])

    return grouped(edges.select("window_id", "u", "v"), ["window_id"], of, "window_id int, model string, u string, v string")


def transitivity(n: int, e: list[tuple[int, int]]) -> float:
    a = np.zeros((n, n))
    for x, y in e:
        a[x, y] = a[y, x] = 1
    deg = a.sum(0)
    wedges = (deg * (deg - 1)).sum()
    return float(np.trace(a @ a @ a) / wedges) if wedges else 0.0


#: Global metrics of a graph that are held against random graphs.
GRAPH_METRICS = ("nodes", "edges", "density", "mean_degree", "max_degree", "components", "largest_component", "clustering", "transitivity", "assortativity", "mean_path", "diameter") + tuple(f"ricci_{x}" for x in ("mean", "var", "std", "skew", "kurt", "q10", "q50", "q90", "iqr", "min", "max"))


def graph_metrics(n: int, u: np.ndarray, v: np.ndarray, strength: np.ndarray | None = None) -> list[float]:
    """GRAPH_METRICS; an undefined one is nan. Paths are of the largest component, curvature weighs edges by ``strength`` (1 by default)."""
    a = np.zeros((n, n))
    a[u, v] = a[v, u] = 1
    deg = a.sum(0)
    closed = np.einsum("ij,ji->i", a @ a, a)
    wedges = deg * (deg - 1)
    local = np.where(wedges > 0, closed / np.where(wedges > 0, wedges, 1), 0.0)
    far, seen, ring = np.zeros((n, n)), np.eye(n, dtype=bool), np.eye(n)
    for step in range(1, n):
        new = (ring @ a > 0) & ~seen
        if not new.any():
            break
        far[new], seen, ring = step, seen | new, new.astype(float)
    reach = seen.sum(1)
    part = np.flatnonzero(seen[int(reach.argmax())])
    inner = far[np.ix_(part, part)]
    k = len(part)
    x, y = np.r_[deg[u], deg[v]], np.r_[deg[v], deg[u]]
    w = np.ones(len(u)) if strength is None else strength
    root = np.bincount(u, 1 / np.sqrt(w), n) + np.bincount(v, 1 / np.sqrt(w), n)
    # Each end's sum over its other edges of 1 / sqrt(w_e w_f), times w_e.
    curved = 2 - np.sqrt(w) * (root[u] + root[v] - 2 / np.sqrt(w))
    r = pd.Series(curved)
    q10, q25, q50, q75, q90 = np.quantile(curved, (0.1, 0.25, 0.5, 0.75, 0.9))
    components = round(float((1 / reach).sum()))
    return [n, len(u), len(u) / (n * (n - 1) / 2), deg.mean(), deg.max(), components, k, local.mean(), closed.sum() / wedges.sum() if wedges.sum() else 0.0, float(np.corrcoef(x, y)[0, 1]) if x.std() > 0 else math.nan, inner.sum() / (k * (k - 1)) if k > 1 else math.nan, inner.max() if k > 1 else math.nan, r.mean(), r.var(), r.std(), r.skew(), r.kurt(), q10, q50, q90, q75 - q25, curved.min(), curved.max()]


def metric_tests(seen: np.ndarray, null: np.ndarray, alpha: float = 0.05) -> tuple[int, np.ndarray, np.ndarray]:
    """Significant metrics after Bonferroni, z, and two-sided normal p; metrics defined in under ten samples are not tested, constant ones never significant."""
    tested = ~np.isnan(seen) & ((~np.isnan(null)).sum(0) >= 10)
    z, p = np.full(len(seen), np.nan), np.full(len(seen), np.nan)
    for k in np.flatnonzero(tested):
        x = null[~np.isnan(null[:, k]), k]
        sd = x.std(ddof=1)
        if np.ptp(x) > 1e-12:
            z[k] = (seen[k] - x.mean()) / sd
            p[k] = math.erfc(abs(z[k]) / math.sqrt(2))
    return int((p < alpha / max(tested.sum(), 1)).sum()), z, p


#: Samples of one task.
SAMPLES_PER_TASK = 50
#: Partitions of the samples; a number that is given keeps small ones from being joined, as drawing is slow beside their size.
TASKS = 96


def null_tests(edges: DataFrame, samples: int = 1000) -> DataFrame:
    """Per window the battery of three tests, and beside it transitivity against the degree-preserving null.

    metrics: GRAPH_METRICS against random graphs of as many edges; the
    statistic is the number significant after Bonferroni, z and p (Bonferroni)
    are the strongest metric's, share is of the tested ones; three reject.
    degrees: the share of KS tests of the degrees against those graphs with p
    below 0.05; over 0.95 rejects; statistic is the mean gap, p the mean p.
    modularity: Louvain's on the graph against Louvain's on each
    degree-preserving randomisation, whose edges weigh 1; p is the share of
    samples at least as modular; below 0.05 rejects. Two or three rejections
    reject, one is inconclusive. Samples are split over tasks by window and
    seed range; a sample's numbers depend on window and number alone.
    """

    def draw(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["u", "v"])
        nodes, u, v = indexed(g)
        n, window, part = len(nodes), int(g["window_id"].iloc[0]), int(g["_part"].iloc[0])
        deg = np.bincount(np.r_[u, v], minlength=n)
        rows = []
        if not part:
            w = g["weight"].to_numpy(float)
            real = graph_metrics(n, u, v, 1 / (g["distance"].to_numpy(float) + 1e-9))
            rows.append((window, -1, real, None, None, partition_quality(n, u, v, w, louvain(n, u, v, w)), transitivity(n, list(zip(u, v, strict=True)))))
        for k in range(part * SAMPLES_PER_TASK, min(samples, (part + 1) * SAMPLES_PER_TASK)):
            rng = np.random.default_rng((window, k))
            a, b = random_edges(n, len(u), rng)
            gap, p = ks_two_sample(deg, np.bincount(np.r_[a, b], minlength=n))
            e = swapped_edges(u, v, rng)
            x, y = np.array(e).T
            one = np.ones(len(e))
            rows.append((window, k, graph_metrics(n, a, b), gap, p, partition_quality(n, x, y, one, louvain(n, x, y, one)), transitivity(n, e)))
        return pd.DataFrame(rows, columns=["window_id", "sample", "metrics", "gap", "p", "modularity", "transitivity"])

    def judge(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("sample")
        real, null = g.iloc[0], g.iloc[1:]
        hits, z, p = metric_tests(np.array(real["metrics"], float), np.stack([np.array(x, float) for x in null["metrics"]]))
        tested = int((~np.isnan(p)).sum())
        top = int(np.nanargmax(np.abs(z))) if tested else None
        rows = [("metrics", float(hits), z[top] if tested else 0.0, min(1.0, p[top] * tested) if tested else 1.0, hits / tested if tested else 0.0)]
        share = float((null["p"] < 0.05).mean())
        rows.append(("degrees", float(null["gap"].mean()), 0.0, float(null["p"].mean()), share))
        for name in ("modularity", "transitivity"):
            x = null[name].to_numpy(float)
            at_least = float((x >= real[name]).mean())
            zscore = (real[name] - x.mean()) / x.std() if x.std() > 0 else 0.0
            rows.append((name, real[name], zscore, at_least if name == "modularity" else math.erfc(abs(zscore) / math.sqrt(2)), at_least))
        rejected = (hits >= 3) + (share > 0.95) + (rows[2][3] < 0.05)
        verdict = "reject" if rejected >= 2 else "inconclusive" if rejected else "keep"
        return pd.DataFrame([(int(real["window_id"]), *r, verdict) for r in rows], columns=["window_id", "test", "statistic", "zscore", "pvalue", "share", "verdict"])

    parts = F.explode(F.sequence(F.lit(0), F.lit(-(-samples // SAMPLES_PER_TASK) - 1)))
    drawn = grouped(edges.select(*EDGE_COLUMNS, parts.alias("_part")).repartition(TASKS, "window_id", "_part"), ["window_id", "_part"], draw, "window_id int, sample int, metrics array<double>, gap double, p double, modularity double, transitivity double")
    return grouped(drawn, ["window_id"], judge, "window_id int, test string, statistic double, zscore double, pvalue double, share double, verdict string")


#: Statistics of a distance matrix that are held against the null.
MATRIX_STATISTICS = ("mean", "median", "std", "skewness", "kurtosis", "iqr", "entropy", "cv")


def matrix_statistics(x: np.ndarray, bins: int = 20) -> list[float]:
    sd = x.std()
    z = (x - x.mean()) / sd if sd > 0 else np.zeros(len(x))
    p = np.histogram(x, bins)[0] / len(x)
    p = p[p > 0]
    return [x.mean(), float(np.median(x)), sd, (z**3).mean(), (z**4).mean() - 3, float(np.subtract(*np.quantile(x, [0.75, 0.25]))), float(-(p * np.log2(p)).sum()), sd / x.mean() if x.mean() else 0.0]


def distance_null_tests(pairs: DataFrame, samples: int = 1000) -> DataFrame:
    """Per window: each statistic of the distances against random matrices (z, two-sided p, percentile, Bonferroni), and the largest KS gap's verdict.

    Three significant statistics reject, one is weak. The gap decides strongly,
    moderately or weakly if it tops .3, .2 or .15 in 95, 90 or 80 % of samples.
    """

    def of(p: pd.DataFrame) -> pd.DataFrame:
        names, d = square(p, "distance", 0.0)
        at = np.triu_indices(len(names), 1)
        x = d[at]
        x = x[~np.isnan(x)]
        window = int(p["window_id"].iloc[0])
        rng = np.random.default_rng(window)
        null, gaps, seen = [], [], matrix_statistics(x / x.max())
        for _ in range(samples):
            r = random_distances(len(names), rng)[at]
            null.append(matrix_statistics(r))
            gaps.append(ks_two_sample(x / x.max(), r)[0])
        null, gaps = np.array(null), np.array(gaps)
        sd = null.std(0)
        z = np.where(sd > 0, (seen - null.mean(0)) / np.where(sd > 0, sd, 1), 0.0)
        pv = [math.erfc(abs(t) / math.sqrt(2)) for t in z]
        hits = sum(t < 0.05 / len(z) for t in pv)
        by_stats = "reject" if hits >= 3 else "weak" if hits else "keep"
        by_gap = next((name for limit, share, name in ((0.3, 0.95, "strong"), (0.2, 0.90, "moderate"), (0.15, 0.80, "weak")) if (gaps > limit).mean() >= share), "none")
        decision = "reject" if by_stats == "reject" and by_gap in ("strong", "moderate") else "inconclusive" if by_stats != "keep" or by_gap != "none" else "keep"
        rows = [(window, s, a, b, c, float((null[:, k] <= a).mean()), by_stats, by_gap, decision) for k, (s, a, b, c) in enumerate(zip(MATRIX_STATISTICS, seen, z, pv, strict=True))]
        return pd.DataFrame(rows, columns=["window_id", "statistic", "value", "zscore", "pvalue", "percentile", "by_statistics", "by_gap", "decision"])

    return grouped(pairs.select("window_id", "asset_1", "asset_2", "distance"), ["window_id"], of, "window_id int, statistic string, value double, zscore double, pvalue double, percentile double, by_statistics string, by_gap string, decision string")
