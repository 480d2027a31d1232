"""Polygon kernels as Arrow-batched UDFs over ``array<ring>``: an outer ring, then its holes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from morphloom.functions import overlay as O
from morphloom.functions import shapes as S

POINT_TYPE = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
RINGS_TYPE = T.ArrayType(T.ArrayType(POINT_TYPE))
PARTS_TYPE = T.ArrayType(RINGS_TYPE)
RINGS = "array<array<struct<x:double,y:double>>>"
ARROW_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
ARROW_RINGS = pa.list_(pa.list_(ARROW_POINT))
ARROW_PARTS = pa.list_(ARROW_RINGS)


def to_polygon(rings) -> O.Polygon:
    """Open rings of an array of closed ones; null has none."""
    return [S._xy(r)[:-1] for r in rings if r is not None and len(r) > 3] if rings is not None else []


def from_polygon(polygon: O.Polygon) -> list[list[dict]]:
    return [[{"x": float(x), "y": float(y)} for x, y in np.concatenate([r, r[:1]])] for r in polygon]


def area_of(parts: list[O.Polygon]) -> float:
    return sum(map(O.polygon_area, parts))


def segment_gap(a: np.ndarray, b: np.ndarray) -> float:
    """Smallest distance between two sets of segments (n, 2, 2), 0 where they cross."""

    def to(points: np.ndarray, edges: np.ndarray) -> float:
        d = edges[:, 1] - edges[:, 0]
        size = np.maximum((d**2).sum(1), 1e-300)
        t = np.clip(((points[:, None] - edges[None, :, 0]) * d).sum(2) / size, 0, 1)
        return float(np.sqrt(((edges[None, :, 0] + t[..., None] * d - points[:, None]) ** 2).sum(2)).min())

    side = lambda p, q, r: (q[..., 0] - p[..., 0]) * (r[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (r[..., 0] - p[..., 0])
    p, q, r, s = a[:, None, 0], a[:, None, 1], b[None, :, 0], b[None, :, 1]
    if ((side(p, q, r) * side(p, q, s) < 0) & (side(r, s, p) * side(r, s, q) < 0)).any():
        return 0.0
    return min(to(a.reshape(-1, 2), b), to(b.reshape(-1, 2), a))


def polygon_gap(a: O.Polygon, b: O.Polygon) -> float:
    if O.inside(a[0][:1], b)[0] or O.inside(b[0][:1], a)[0]:
        return 0.0
    return segment_gap(O.closed_edges(a), O.closed_edges(b))


def _two(result: T.DataType, empty):
    """A UDF of two arrays of rings; ``empty`` tells the result where one has none."""

    def make(f):
        @F.arrow_udf(result)
        def run(a: pa.Array, b: pa.Array) -> pa.Array:
            pairs = ((to_polygon(x), to_polygon(y)) for x, y in zip(a.to_pylist(), b.to_pylist()))
            return pa.array([f(x, y) if x and y else empty(x, y) for x, y in pairs], pa.float64() if isinstance(result, T.DoubleType) else ARROW_PARTS)

        return run

    return make


#: Side to which two polygons are brought before they are cut, so that snapping is small beside them.
FINE = 1e3


def common_area(a: O.Polygon, b: O.Polygon) -> float:
    """Area two polygons share: convex ones are clipped, of others the overlay is measured."""
    if len(a) == len(b) == 1 and O._convex(a[0]) and O._convex(b[0]):
        return S.ring_area(S.clip_convex(a[0], b[0] if O.signed_area(b[0]) > 0 else b[0][::-1]))
    low = np.minimum(a[0].min(0), b[0].min(0))
    wide = float((np.maximum(a[0].max(0), b[0].max(0)) - low).max())
    by = FINE / wide if 0 < wide < FINE else 1.0
    return area_of(O.intersection([[(r - low) * by for r in a]], [[(r - low) * by for r in b]])) / by**2


#: Area two polygons share, of any shape.
shared_area = _two(T.DoubleType(), lambda x, y: 0.0)(common_area)
#: Parts of the first polygon inside the second; and those outside of it.
common_parts = _two(PARTS_TYPE, lambda x, y: [])(lambda x, y: [from_polygon(p) for p in O.intersection([x], [y])])
parts_without = _two(PARTS_TYPE, lambda x, y: [from_polygon(x)] if x else [])(lambda x, y: [from_polygon(p) for p in O.difference([x], [y])])
#: Distance of two polygons, 0 where they meet; null without one of them.
polygon_distance = _two(T.DoubleType(), lambda x, y: None)(polygon_gap)


@F.arrow_udf(T.DoubleType())
def line_distance(rings: pa.Array, line: pa.Array) -> pa.Array:
    """Distance of a polygon's rim to a line."""
    out = []
    for r, s in zip(rings.to_pylist(), line.to_pylist()):
        p, q = to_polygon(r), S._xy(s)
        out.append(segment_gap(O.closed_edges(p), np.stack([q[:-1], q[1:]], 1)) if p and len(q) > 1 else None)
    return pa.array(out, pa.float64())


@F.arrow_udf(POINT_TYPE)
def representative_point(rings: pa.Array) -> pa.Array:
    """A point sure to lie inside."""
    made = [dict(zip("xy", O.representative_point(p))) if (p := to_polygon(r)) else None for r in rings.to_pylist()]
    return pa.array(made, ARROW_POINT)


def _one(f):
    @F.arrow_udf(PARTS_TYPE)
    def run(rings: pa.Array) -> pa.Array:
        return pa.array([[from_polygon(p) for p in f(q)] if (q := to_polygon(r)) else [] for r in rings.to_pylist()], ARROW_PARTS)

    return run


#: Valid parts of a polygon whose rings may cross: the points inside by the even-odd rule.
made_valid = _one(lambda p: O.union([p]))


def buffered(distance: float, quarter: int = 8):
    """Parts of the polygon grown (or, below zero, shrunk) by ``distance``."""
    return _one(lambda p: O.buffer([p], distance, quarter))


@F.arrow_udf(RINGS_TYPE)
def normalized(rings: pa.Array) -> pa.Array:
    return pa.array([from_polygon(O.normalized(p)) if (p := to_polygon(r)) else None for r in rings.to_pylist()], ARROW_RINGS)


def simplified_rings(tolerance: float):
    """Rings by Douglas-Peucker, from their first vertex; a hole that collapses goes."""

    def thin(ring):
        xy = S._xy(ring)
        far = int(np.hypot(*(xy - xy[0]).T).argmax())
        return np.concatenate([S.simplify(xy[: far + 1], tolerance)[:-1], S.simplify(xy[far:], tolerance)[:-1]])

    @F.arrow_udf(RINGS_TYPE)
    def run(rings: pa.Array) -> pa.Array:
        thinned = ([thin(r) for r in p] if p else None for p in rings.to_pylist())
        return pa.array([from_polygon([t for k, t in enumerate(p) if k == 0 or len(t) > 2]) if p else None for p in thinned], ARROW_RINGS)

    return run


@F.arrow_udf(PARTS_TYPE)
def without(rings: pa.Array, cuts: pa.Array) -> pa.Array:
    """Parts of a polygon outside all of an array of polygons."""
    given = zip(rings.to_pylist(), cuts.to_pylist())
    return pa.array([[from_polygon(p) for p in O.difference([to_polygon(g)], [to_polygon(x) for x in xs])] for g, xs in given], ARROW_PARTS)


MEASURES = ["area", "perimeter", "outer_length", "n_rings", "longest", "shortest", "orientation", "mrr_area", "mrr_perimeter", "radius"]


def measures(polygon: O.Polygon) -> tuple[float, ...]:
    """Area, rim, outer rim, holes, smallest rectangle and circle of one polygon."""
    a, b, o = S.minimum_rectangle(polygon[0])
    o = o % 90
    return (O.polygon_area(polygon), sum(map(O.ring_length, polygon)), O.ring_length(polygon[0]), float(len(polygon) - 1), a, b, min(o, 90 - o), a * b, 2 * (a + b), S.enclosing_circle(polygon[0])[2])
_MEASURES = T.StructType([T.StructField(c, T.DoubleType()) for c in MEASURES])


@F.arrow_udf(_MEASURES)
def measured(rings: pa.Array) -> pa.Array:
    rows = [dict(zip(MEASURES, measures(p))) if (p := to_polygon(r)) else None for r in rings.to_pylist()]
    return pa.array(rows, pa.struct([(c, pa.float64()) for c in MEASURES]))
