"""Outlines of groups of points: hulls, triangulations, clusters of short triangles."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from morphloom.functions import shapes
from morphloom.operators.components import connected_components


def hulls(points: DataFrame, group: str, x: str = "x", y: str = "y") -> DataFrame:
    """(group, ring) convex hulls. Each task first reduces what it holds of a group to its hull, so
    that a large group reaches its last task as a few corner points."""
    kind = points.schema[group].dataType
    corner = T.StructType([T.StructField(group, kind), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])

    def corners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict = {}
        for b in batches:
            for g, part in b.groupby(group, dropna=False):
                p = part[["x", "y"]].to_numpy(float)
                kept[g] = shapes.hull(np.concatenate([kept[g], p]) if g in kept else p)
        for g, p in kept.items():
            yield pd.DataFrame({group: [g] * len(p), "x": p[:, 0], "y": p[:, 1]})

    def close(pdf: pd.DataFrame) -> pd.DataFrame:
        p = shapes.hull(pdf[["x", "y"]].to_numpy(float))
        ring = [{"x": float(a), "y": float(b)} for a, b in [*p, p[0]]]
        return pd.DataFrame({group: [pdf[group].iloc[0]], "ring": [ring]})

    few = points.select(group, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna().mapInPandas(corners, corner)
    out = T.StructType([T.StructField(group, kind), T.StructField("ring", T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])))])
    return few.groupBy(group).applyInPandas(close, out)


def delaunay(points: np.ndarray) -> np.ndarray:
    """Triangles (rows of point numbers) by incremental insertion; each point is held against all
    circumcircles at once, around the points' own middle so that large coordinates lose nothing."""
    n = len(points)
    if n < 3:
        return np.empty((0, 3), int)
    span = np.ptp(points, axis=0).max() or 1.0
    p = (points - points.mean(0)) / span
    p = np.concatenate([p, [[-600.0, -300.0], [600.0, -300.0], [0.0, 600.0]]])
    room = 2 * n + 16
    corner, middle, radius = np.zeros((room, 3), int), np.zeros((room, 2)), np.full(room, -1.0)

    def circles(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b, c = p[t[:, 0]], p[t[:, 1]] - p[t[:, 0]], p[t[:, 2]] - p[t[:, 0]]
        d = 2 * (b[:, 0] * c[:, 1] - b[:, 1] * c[:, 0])
        d[d == 0] = np.nan
        bb, cc = (b**2).sum(1), (c**2).sum(1)
        u = np.stack([c[:, 1] * bb - b[:, 1] * cc, b[:, 0] * cc - c[:, 0] * bb], 1) / d[:, None]
        return a + u, (u**2).sum(1)

    corner[0] = (n, n + 1, n + 2)
    middle[:1], radius[:1] = circles(corner[:1])
    made = 1
    for i in np.lexsort((p[:n, 1], p[:n, 0])).tolist():
        gone = np.flatnonzero(((middle[:made] - p[i]) ** 2).sum(1) < radius[:made] * (1 - 1e-12))
        if not len(gone):  # a repeated point
            continue
        t = corner[gone]
        edges = np.sort(np.concatenate([t[:, [0, 1]], t[:, [1, 2]], t[:, [2, 0]]]), axis=1)
        kinds, times = np.unique(edges, axis=0, return_counts=True)
        rim = kinds[times == 1]
        new = np.column_stack([rim, np.full(len(rim), i)])
        centre, size = circles(new)
        flat = np.isnan(size)
        new, centre, size = new[~flat], centre[~flat], size[~flat]
        at = np.concatenate([gone[: len(new)], np.arange(made, made + len(new) - min(len(new), len(gone)))])
        radius[gone] = -1.0
        if len(at) and at.max() >= len(corner):
            corner, middle, radius = np.concatenate([corner, np.zeros_like(corner)]), np.concatenate([middle, np.zeros_like(middle)]), np.concatenate([radius, np.full(len(radius), -1.0)])
        corner[at], middle[at], radius[at] = new, centre, size
        made = max(made, int(at.max(initial=-1)) + 1)
    kept = corner[:made][(radius[:made] >= 0) & (corner[:made].max(1) < n)]
    return np.sort(kept, axis=1)


def concave_ring(points: np.ndarray, longest: float) -> list[np.ndarray]:
    """Outlines (alpha shape) of the triangles whose edges are all at most ``longest``; rings of points."""
    from morphloom.functions import overlay

    t = delaunay(points)
    if not len(t):
        return []
    sides = np.stack([np.hypot(*(points[t[:, i]] - points[t[:, (i + 1) % 3]]).T) for i in range(3)], 1)
    return [p[0] for p in overlay.union([[points[r]] for r in t[(sides <= longest).all(1)]])]


def inscribed_circle(polygon: list[np.ndarray], precision: float = 1e-3) -> tuple[float, float, float]:
    """(x, y, radius) of the largest circle inside a polygon: squares that could hold a better centre are quartered."""
    import heapq

    from morphloom.functions import overlay

    edges = overlay.closed_edges(polygon)
    low, high = polygon[0].min(0), polygon[0].max(0)

    def depth(c: np.ndarray) -> float:
        d = edges[:, 1] - edges[:, 0]
        u = np.clip(((c - edges[:, 0]) * d).sum(1) / np.maximum((d**2).sum(1), 1e-300), 0, 1)
        far = float(np.hypot(*(edges[:, 0] + u[:, None] * d - c).T).min())
        return far if overlay.inside(c[None], polygon)[0] else -far

    half = float((high - low).max()) / 2
    first = (low + high) / 2
    best = (depth(first), first)
    heap = [(-(best[0] + half * math.sqrt(2)), 0, first, half)]
    count = 1
    while heap:
        bound, _, c, h = heapq.heappop(heap)
        if -bound - best[0] <= precision:
            break
        for dx in (-0.5, 0.5):
            for dy in (-0.5, 0.5):
                q = c + h * np.array([dx, dy])
                r = depth(q)
                best = max(best, (r, q), key=lambda b: b[0])
                heapq.heappush(heap, (-(r + h / 2 * math.sqrt(2)), count, q, h / 2))
                count += 1
    return float(best[1][0]), float(best[1][1]), best[0]


def delaunay_edges(points: DataFrame, key: str, group: str) -> DataFrame:
    """(focal, neighbor, weight = length) of the triangulation of each group, one group a task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        p, ids = pdf[["x", "y"]].to_numpy(float), pdf[key].to_numpy()
        t = delaunay(p)
        pairs = np.unique(np.sort(np.concatenate([t[:, [0, 1]], t[:, [1, 2]], t[:, [0, 2]]]), axis=1), axis=0) if len(t) else np.empty((0, 2), int)
        return pd.DataFrame({"focal": ids[pairs[:, 0]], "neighbor": ids[pairs[:, 1]], "weight": np.hypot(*(p[pairs[:, 0]] - p[pairs[:, 1]]).T)})

    return points.select(F.col(key).cast("bigint").alias(key), group, "x", "y").groupBy(group).applyInPandas(run, "focal bigint, neighbor bigint, weight double")


def natural_cities(edges: DataFrame, min_size: int) -> DataFrame:
    """(node, component): parts connected by edges up to the mean length, larger than ``min_size``."""
    mean = edges.agg(F.avg("weight").alias("m")).first().m
    comps = connected_components(edges.where(F.col("weight") <= F.lit(mean)), "focal", "neighbor")
    large = comps.groupBy("component").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > min_size).select("component")
    return comps.join(large, "component", "left_semi")
