"""Positions, sizes and line widths of network drawings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .correlation import lookup_pvalues
from .kernels import EDGE_COLUMNS, betweenness, grouped, indexed, neighbours

#: Least distance of two nodes before the drawing is scaled, and that scale; shrinkage of the radius of the node most between; size of the least node, range of sizes, shares of betweenness and degree in it.
#: Fixed values of the figure.
NODE_GAP = 0.085
SCALE = 1.30
PULL = 0.48
LEAST_SIZE, SIZE_RANGE, BETWEENNESS_SHARE, DEGREE_SHARE = 140, 1550, 0.72, 0.28
#: Width of an edge: constant, factor of the strength, greatest strength that counts, scale. Fixed values of the figure.
LEAST_WIDTH, WIDTH_RANGE, MOST_STRENGTH, WIDTH_SCALE = 0.8, 2.6, 1.8, 1.12


def path_distances(n: int, u: np.ndarray, v: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Lengths of all shortest paths; nodes without a path between them are taken half again as far as the farthest that have one."""
    d = np.full((n, n), np.inf)
    np.fill_diagonal(d, 0)
    np.minimum.at(d, (u, v), length)
    d = np.minimum(d, d.T)
    for k in range(n):
        np.minimum(d, d[:, k, None] + d[None, k], out=d)
    known = np.isfinite(d)
    d[~known] = 1.5 * d[known].max() or 1.0
    return d


def gaps(xy: np.ndarray) -> np.ndarray:
    return np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2))


def stress(xy: np.ndarray, d: np.ndarray) -> float:
    """Sum over pairs of the squared relative error of their distance: the energy of springs as stiff as the inverse square of their length."""
    upper = np.triu_indices(len(d), 1)
    return float((((gaps(xy)[upper] - d[upper]) / d[upper]) ** 2).sum())


def circle(n: int) -> np.ndarray:
    at = 2 * np.pi * np.arange(n) / max(n, 1)
    return np.column_stack([np.cos(at), np.sin(at)])


def spring_layout(d: np.ndarray, rounds: int = 300, tolerance: float = 1e-7) -> tuple[np.ndarray, list[float]]:
    """Positions of least stress found from a circle, and the stress after each round.

    Each round minimises a quadratic that lies above the stress and touches it
    at the present positions, so the stress never rises: one product with the
    inverse of the weights' Laplacian, which is made once.
    """
    n = len(d)
    xy = circle(n) * (d.mean() if n > 1 else 1)
    seen = [stress(xy, d)]
    if n < 3:
        return xy if n < 2 else np.array([[-d[0, 1] / 2, 0], [d[0, 1] / 2, 0]]), [*seen, 0.0]
    w = np.divide(1, d * d, where=~np.eye(n, dtype=bool), out=np.zeros((n, n)))
    inverse = np.linalg.pinv(np.diag(w.sum(1)) - w)
    for _ in range(rounds):
        now = gaps(xy)
        pull = np.divide(w * d, now, where=now > 1e-12, out=np.zeros((n, n)))
        xy = inverse @ ((np.diag(pull.sum(1)) - pull) @ xy)
        seen.append(stress(xy, d))
        if seen[-2] - seen[-1] <= tolerance * seen[-2]:
            break
    return xy, seen


def spread_out(xy: np.ndarray, gap: float, rounds: int = 2000) -> np.ndarray:
    """Push nodes apart, each of a pair by half of what it lacks, until all are ``gap`` apart; those at one place part in directions of their own."""
    n = len(xy)
    xy = xy + 1e-9 * circle(n)
    for _ in range(rounds):
        step = xy[:, None] - xy[None]
        far = np.sqrt((step**2).sum(2))
        lack = np.where(~np.eye(n, dtype=bool) & (far < gap), 1.001 * gap - far, 0)
        if not lack.any():
            break
        xy = xy + ((0.5 * lack / np.maximum(far, 1e-12))[..., None] * step).sum(1)
    return xy


def boxed(xy: np.ndarray) -> np.ndarray:
    """Each axis from -1 to 1."""
    low, span = xy.min(0), np.maximum(np.ptp(xy, axis=0), 1e-9)
    return 2 * (xy - low) / span - 1


def positions(d: np.ndarray, between: np.ndarray) -> np.ndarray:
    """Least stress, then nodes nearer to the middle the more they are between others, then no two too near, in a box from -SCALE to SCALE.

    The gap is less than ``NODE_GAP`` only for so many nodes (over 200) that the box can't hold them.
    """
    xy, _ = spring_layout(d)
    xy = xy - xy.mean(0)
    xy = xy / (np.abs(xy).max() or 1)
    xy = xy * (1 - PULL * between / (between.max() or 1))[:, None]
    gap = min(NODE_GAP, 1.2 / np.sqrt(max(len(d), 1)))
    for _ in range(20):  # where the box shrinks an axis, nodes part again
        xy = boxed(spread_out(xy, gap))
        if len(xy) < 2 or gaps(xy)[np.triu_indices(len(xy), 1)].min() >= gap:
            break
    return SCALE * xy


def node_layout(edges: DataFrame, weight: str | None = "weight") -> DataFrame:
    """Per window and node: x, y, size, degree, betweenness. Path lengths are sums of ``weight``, or hops if that is None.

    A window's graph is laid out by itself, in one task bounded by the square
    of its nodes, from a circle in the nodes' order; so windows are independent
    and a result doesn't depend on partitioning. Sizes follow the shares of
    the largest betweenness and degree.
    """

    def of(e: pd.DataFrame) -> pd.DataFrame:
        nodes, u, v = indexed(e)
        adjacent = neighbours(len(nodes), u, v)
        degree, between = np.array([len(x) for x in adjacent]), betweenness(adjacent)
        length = np.maximum(e[weight].to_numpy(float), 1e-9) if weight else np.ones(len(e))
        xy = positions(path_distances(len(nodes), u, v, length), between)
        size = SCALE * (LEAST_SIZE + SIZE_RANGE * (BETWEENNESS_SHARE * between / (between.max() or 1) + DEGREE_SHARE * degree / degree.max()))
        return pd.DataFrame({"window_id": e["window_id"].iloc[0], "node": nodes, "x": xy[:, 0], "y": xy[:, 1], "size": size, "degree": degree, "betweenness": between})

    return grouped(edges.select(*EDGE_COLUMNS), ["window_id"], of, "window_id int, node string, x double, y double, size double, degree int, betweenness double")


def edge_width(distance: Column) -> Column:
    """Wider the nearer its ends are; an edge without a positive distance has strength 1."""
    strength = F.when(distance > 0, 1 / distance).otherwise(1.0)
    return (LEAST_WIDTH + WIDTH_RANGE * F.least(strength, F.lit(MOST_STRENGTH))) * WIDTH_SCALE


def edge_lines(edges: DataFrame, pvalues: DataFrame, level: float = 0.05, significant: str = "solid") -> DataFrame:
    """Per edge: width, p-value of its pair whichever way round it is stored, and style: one for p below ``level``, the other for the rest and where there is none."""
    other = "dashed" if significant == "solid" else "solid"
    style = F.when(F.col("pvalue") < level, significant).otherwise(other)
    return lookup_pvalues(edges.select("window_id", "u", "v", "distance"), pvalues).withColumn("width", edge_width(F.col("distance"))).withColumn("style", style)
