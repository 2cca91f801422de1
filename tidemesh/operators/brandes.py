"""Path centralities with a window's graph spread over tasks, by ranges of sources."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sources of one row of work.
SOURCES = 64


def adjacency(u: np.ndarray, v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours of all nodes as one array, and where each node's begin."""
    ends, others = np.concatenate([u, v]), np.concatenate([v, u])
    order = np.lexsort((others, ends))
    return np.searchsorted(ends[order], np.arange(n + 1)), others[order]


def from_source(s: int, starts: np.ndarray, other: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hops from a source (-1: none), and what its shortest paths add to each node's betweenness: Brandes' accumulation, a ring at a time.

    A ring's edges are cut out of the adjacency array at once; paths are
    counted going out, shares come back in the reverse order.
    """
    hops, paths = np.full(n, -1), np.zeros(n)
    hops[s], paths[s] = 0, 1.0
    ring, steps = np.array([s]), []
    while len(ring):
        count = starts[ring + 1] - starts[ring]
        tail = np.repeat(ring, count)
        first = np.repeat(starts[ring] - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
        head = other[first + np.arange(len(tail))]
        depth = hops[ring[0]] + 1
        hops[head[hops[head] < 0]] = depth
        down = hops[head] == depth
        tail, head = tail[down], head[down]
        np.add.at(paths, head, paths[tail])
        steps.append((tail, head))
        ring = np.unique(head)
    share = np.zeros(n)
    for tail, head in reversed(steps):
        np.add.at(share, tail, paths[tail] / paths[head] * (1 + share[head]))
    share[s] = 0
    return hops, share


def centralities(edges: DataFrame, sources: int = SOURCES) -> DataFrame:
    """(window_id, node, degree, degree_centrality, betweenness_centrality, closeness_centrality) of unweighted graphs.

    A window's graph is gathered once into one row, its edges as numbers of
    its sorted nodes, and dealt to a task for every ``sources`` of its nodes;
    each task follows the paths from its sources, and what they add to the
    nodes is summed by a shuffle. So a window's n^2 m work isn't one task's;
    only its edges must fit into a row. Betweenness is the share of shortest
    paths through a node, over (n - 1)(n - 2) / 2 pairs; closeness is the
    number of nodes reached over their hops, scaled by their share of the
    others; both are 0 where there is none.
    """
    e = edges.select("window_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u <> v").distinct()
    nodes = e.select("window_id", F.explode(F.array("u", "v")).alias("node")).groupBy("window_id").agg(F.sort_array(F.collect_set("node")).alias("nodes"))
    graph = e.groupBy("window_id").agg(F.sort_array(F.collect_list(F.struct("u", "v"))).alias("edges")).join(nodes, "window_id")
    blocks = graph.withColumn("first", F.explode(F.sequence(F.lit(0), F.size("nodes") - 1, F.lit(sources)))).repartition("window_id", "first")

    def follow(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for window, pairs, names, first in batch.itertuples(index=False):
                names = list(names)
                at = {x: k for k, x in enumerate(names)}
                n = len(names)
                u, v = (np.array([at[p[c]] for p in pairs]) for c in ("u", "v"))
                starts, other = adjacency(u, v, n)
                total, close = np.zeros(n), np.zeros(n)
                for s in range(first, min(first + sources, n)):
                    hops, share = from_source(s, starts, other, n)
                    total += share
                    reached = hops > 0
                    close[s] = reached.sum() / hops[reached].sum() * reached.sum() / (n - 1) if reached.any() else 0.0
                own = np.arange(n)
                degree = np.where((own >= first) & (own < first + sources), np.diff(starts), 0)
                yield pd.DataFrame({"window_id": window, "node": names, "n": n, "degree": degree, "between": total, "close": close})

    parts = blocks.select("window_id", "edges", "nodes", "first").mapInPandas(follow, "window_id int, node string, n int, degree int, between double, close double")
    sums = parts.groupBy("window_id", "node").agg(F.max("n").alias("n"), F.sum("degree").cast("int").alias("degree"), F.sum("between").alias("between"), F.sum("close").alias("closeness_centrality"))
    pairs = F.nullif(((F.col("n") - 1) * (F.col("n") - 2)).cast("double"), F.lit(0.0))
    return sums.select("window_id", "node", "degree", (F.col("degree") / (F.col("n") - 1)).alias("degree_centrality"), F.coalesce(F.try_divide("between", pairs), F.lit(0.0)).alias("betweenness_centrality"), "closeness_centrality")
