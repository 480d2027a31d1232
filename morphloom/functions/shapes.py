"""Shape kernels without a closed expression: numpy inside Arrow-batched UDFs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

RING = "array<struct<x:double,y:double>>"
MEASURES = ["longest", "shortest", "orientation", "mrr_area", "mrr_perimeter", "elongation", "radius", "hull_area"]
#: Types as objects: text would need a session when this module is imported.
_MEASURES = T.StructType([T.StructField(c, T.DoubleType()) for c in MEASURES])
_RING = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))


def _xy(ring) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in ring], float) if ring is not None and len(ring) else np.empty((0, 2))


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise, open; collinear points go."""
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return pts

    def half(rows: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def minimum_rectangle(points: np.ndarray) -> tuple[float, float, float]:
    """(long side, short side, direction of the long side in degrees) of the smallest rectangle."""
    h = hull(points)
    if len(h) < 2:
        return 0.0, 0.0, 0.0
    edges = np.roll(h, -1, axis=0) - h
    angles = np.unique(np.arctan2(edges[:, 1], edges[:, 0]) % (math.pi / 2))
    c, s = np.cos(angles)[:, None], np.sin(angles)[:, None]
    wide, tall = np.ptp(c * h[:, 0] + s * h[:, 1], axis=1), np.ptp(c * h[:, 1] - s * h[:, 0], axis=1)
    at = int(np.flatnonzero(wide * tall <= (wide * tall).min() + 1e-12)[0])
    w, t, angle = float(wide[at]), float(tall[at]), float(angles[at])
    return (w, t, math.degrees(angle)) if w >= t else (t, w, math.degrees(angle) + 90.0)


def enclosing_circle(points: np.ndarray) -> tuple[float, float, float]:
    """(x, y, radius) of the smallest circle around the points (move-to-front algorithm)."""
    pts = hull(points)
    if not len(pts):
        return 0.0, 0.0, 0.0
    pts = pts[np.random.default_rng(0).permutation(len(pts))]

    def two(a, b):
        c = (a + b) / 2
        return c[0], c[1], float(np.hypot(*(a - c)))

    def three(a, b, c):
        d = 2 * (a[0] * (b[1] - c[1]) + b[0] * (c[1] - a[1]) + c[0] * (a[1] - b[1]))
        if abs(d) < 1e-12:
            return max((two(a, b), two(b, c), two(a, c)), key=lambda t: t[2])
        aa, bb, cc = a @ a, b @ b, c @ c
        x = (aa * (b[1] - c[1]) + bb * (c[1] - a[1]) + cc * (a[1] - b[1])) / d
        y = (aa * (c[0] - b[0]) + bb * (a[0] - c[0]) + cc * (b[0] - a[0])) / d
        return x, y, float(np.hypot(a[0] - x, a[1] - y))

    outside = lambda p, circle: np.hypot(p[0] - circle[0], p[1] - circle[1]) > circle[2] * (1 + 1e-10) + 1e-12
    circle = (pts[0][0], pts[0][1], 0.0)
    for i, p in enumerate(pts):
        if outside(p, circle):
            circle = (p[0], p[1], 0.0)
            for j, q in enumerate(pts[:i]):
                if outside(q, circle):
                    circle = two(p, q)
                    for r in pts[:j]:
                        if outside(r, circle):
                            circle = three(p, q, r)
    return circle


def simplify(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker."""
    keep = np.zeros(len(points), bool)
    if len(points) < 3:
        return points
    keep[[0, -1]] = True
    todo = [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d, inner = points[b] - points[a], points[a + 1 : b] - points[a]
        size = np.hypot(*d)
        far = np.abs(d[0] * inner[:, 1] - d[1] * inner[:, 0]) / size if size else np.hypot(inner[:, 0], inner[:, 1])
        k = int(far.argmax())
        if far[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return points[keep]


def clip_convex(subject: np.ndarray, clipper: np.ndarray) -> np.ndarray:
    """Sutherland-Hodgman: the part of an open ring inside a convex, counter-clockwise one."""
    out = [tuple(p) for p in subject]
    for (ax, ay), (bx, by) in zip(clipper, np.roll(clipper, -1, axis=0)):
        side = lambda p: (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax)  # noqa: B023, E731
        given, out = out, []
        for p, q in zip(given, given[1:] + given[:1]):
            sp, sq = side(p), side(q)
            if sp >= 0:
                out.append(p)
            if sp * sq < 0:
                t = sp / (sp - sq)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        if not out:
            break
    return np.array(out).reshape(-1, 2)


def ring_area(points: np.ndarray) -> float:
    if len(points) < 3:
        return 0.0
    x, y = (points - points[0]).T
    return abs(float(x @ np.roll(y, -1) - y @ np.roll(x, -1))) / 2


def hausdorff(a: np.ndarray, b: np.ndarray) -> float:
    d = np.hypot(*(a[:, None, :] - b[None, :, :]).transpose(2, 0, 1))
    return float(max(d.min(0).max(), d.min(1).max()))


def _sides(ring) -> tuple[float, float] | None:
    """Width and height of a closed ring that is a rectangle along the axes."""
    if ring is None or len(ring) != 5:
        return None
    (ax, ay), (bx, by), (cx, cy), (dx, dy), (ex, ey) = ((p["x"], p["y"]) for p in ring)
    if ex != ax or ey != ay or not (ay == by and bx == cx and cy == dy and dx == ax or ax == bx and by == cy and cx == dx and dy == ay):
        return None
    w, h = abs(cx - ax), abs(cy - ay)
    return (w, h) if 0 < w < math.inf and 0 < h < math.inf else None


@F.pandas_udf(_MEASURES)
def shape_chars(rings: pd.Series) -> pd.DataFrame:
    """Rectangle, circle and hull measures of each outer ring."""
    rows = []
    for ring in rings:
        if (sides := _sides(ring)) is not None:
            b, a = sorted(sides)
            rows.append((a, b, 0.0, a * b, 2 * (a + b), b / a, math.hypot(a, b) / 2, a * b))
            continue
        p = _xy(ring)
        a, b, o = minimum_rectangle(p)
        o = o % 90
        rows.append((a, b, min(o, 90 - o), a * b, 2 * (a + b), b / a if a else None, enclosing_circle(p)[2], ring_area(hull(p))))
    return pd.DataFrame(rows, columns=MEASURES)


@F.pandas_udf(T.DoubleType())
def overlap_area(subject: pd.Series, clipper: pd.Series) -> pd.Series:
    """Area of an outer ring inside a convex one."""
    out = []
    for s, c in zip(subject, clipper):
        s, c = _xy(s)[:-1], hull(_xy(c))
        out.append(ring_area(clip_convex(s, c)) if len(s) > 2 and len(c) > 2 else 0.0)
    return pd.Series(out, dtype=float)


@F.pandas_udf(T.DoubleType())
def hausdorff_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([hausdorff(_xy(x), _xy(y)) for x, y in zip(a, b)], dtype=float)


def simplified(tolerance: float):
    @F.pandas_udf(_RING)
    def run(lines: pd.Series) -> pd.Series:
        return lines.map(lambda line: [{"x": float(x), "y": float(y)} for x, y in simplify(_xy(line), tolerance)])

    return run
