"""Measures of rings and lines as built-in expressions (no Python in the plan).

A ring or line is ``array<struct<x:double,y:double>>``; rings are closed (last point = first).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def segments(line: Column) -> Column:
    """array<struct<a,b>> of consecutive points."""
    n = F.size(line)
    ends = F.slice(line, F.lit(2), F.greatest(n - 1, F.lit(0)))
    starts = F.slice(line, F.lit(1), F.greatest(n - 1, F.lit(0)))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _sum(items: Column, f) -> Column:
    return F.aggregate(F.transform(items, f), F.lit(0.0), lambda a, v: a + v)


def _distance(a: Column, b: Column) -> Column:
    return F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))


def length(line: Column) -> Column:
    return _sum(segments(line), lambda s: _distance(s["a"], s["b"]))


def _cross(ring: Column, s: Column) -> Column:
    """Cross product of a segment's ends around the ring's first point: large coordinates would cancel."""
    o = ring[0]
    return (s["a"]["x"] - o["x"]) * (s["b"]["y"] - o["y"]) - (s["b"]["x"] - o["x"]) * (s["a"]["y"] - o["y"])


def signed_area(ring: Column) -> Column:
    return 0.5 * _sum(segments(ring), lambda s: _cross(ring, s))


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def polygon_area(rings: Column) -> Column:
    """Outer ring less holes."""
    holes = _sum(F.slice(rings, F.lit(2), F.greatest(F.size(rings) - 1, F.lit(0))), area)
    return area(rings[0]) - holes


def courtyard_area(rings: Column) -> Column:
    return area(rings[0]) - polygon_area(rings)


def perimeter(rings: Column) -> Column:
    return _sum(rings, length)


def centroid(ring: Column) -> Column:
    """Area centroid; the mean of the vertices where the ring has no area."""
    a6 = 6.0 * signed_area(ring)
    n = F.size(ring) - 1
    plain = lambda c: _sum(F.slice(ring, F.lit(1), F.greatest(n, F.lit(1))), lambda p: p[c]) / F.greatest(n, F.lit(1))
    moment = lambda c: _sum(segments(ring), lambda s: (s["a"][c] + s["b"][c] - 2 * ring[0][c]) * _cross(ring, s))
    axis = lambda c: F.coalesce(F.try_divide(moment(c), a6) + ring[0][c], plain(c))
    return point(axis("x"), axis("y"))


def bounds(ring: Column) -> Column:
    xs, ys = ring["x"], ring["y"]
    return F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))


def upright(ring: Column) -> Column:
    """Whether a closed ring is a rectangle with sides along the axes."""
    x, y = (lambda i: ring[i]["x"]), (lambda i: ring[i]["y"])
    flat = lambda u, v: (v(0) == v(1)) & (u(1) == u(2)) & (v(2) == v(3)) & (u(3) == u(0))
    return F.when(F.size(ring) == 5, (flat(x, y) | flat(y, x)) & (x(4) == x(0)) & (y(4) == y(0))).otherwise(F.lit(False))


def along_axis(line: Column) -> Column:
    """Whether a line is one straight piece along an axis."""
    a, b = line[0], F.element_at(line, -1)
    return F.when(F.size(line) == 2, (a["x"] == b["x"]) | (a["y"] == b["y"])).otherwise(F.lit(False))


def linearity(line: Column) -> Column:
    """End-to-end distance over length."""
    return F.try_divide(_distance(line[0], F.element_at(line, -1)), length(line))


def swap_axes(ring: Column) -> Column:
    return F.transform(ring, lambda p: F.struct(p["y"].alias("x"), p["x"].alias("y")))


def fold_orientation(degrees: Column) -> Column:
    """Deviation from the cardinal directions, 0 to 45 degrees."""
    folded = F.pmod(degrees, F.lit(90.0))
    return F.least(folded, 90.0 - folded)


def line_orientation(line: Column) -> Column:
    first, last = line[0], F.element_at(line, -1)
    return fold_orientation(F.degrees(F.atan2(last["y"] - first["y"], last["x"] - first["x"])))


def facade_ratio(area_: Column, perimeter_: Column) -> Column:
    return F.try_divide(area_, perimeter_)


def equivalent_rectangular_index(a: Column, p: Column, a_mrr: Column, p_mrr: Column) -> Column:
    return F.sqrt(F.try_divide(a, a_mrr)) * F.try_divide(p_mrr, p)


def circular_compactness(a: Column, radius: Column) -> Column:
    return F.try_divide(a, F.lit(3.141592653589793) * radius * radius)


def compactness_weighted_axis(diameter: Column, a: Column, p: Column) -> Column:
    return diameter * (4.0 / 3.141592653589793 - F.try_divide(16.0 * a, p * p))


def corner_angles(ring: Column) -> Column:
    """Interior turning angle in degrees at each vertex of a closed ring."""
    n = F.size(ring) - 1
    at = F.sequence(F.lit(0), n - 1)

    def angle(i: Column) -> Column:
        p, a, b = F.get(ring, i), F.get(ring, F.pmod(i - 1, n)), F.get(ring, i + 1)
        ux, uy, vx, vy = a["x"] - p["x"], a["y"] - p["y"], b["x"] - p["x"], b["y"] - p["y"]
        return F.degrees(F.abs(F.atan2(ux * vy - uy * vx, ux * vx + uy * vy)))

    return F.transform(at, angle)


def corners(ring: Column, eps: float = 15.0) -> Column:
    """Vertices whose angle departs from a straight line by more than ``eps`` degrees."""
    return F.size(F.filter(corner_angles(ring), lambda a: F.abs(180.0 - a) > eps))


def squareness(ring: Column, eps: float = 15.0) -> Column:
    """Mean deviation of the corners from 90 degrees."""
    real = F.filter(corner_angles(ring), lambda a: F.abs(180.0 - a) > eps)
    return F.try_divide(_sum(real, lambda a: F.abs(90.0 - a)), F.size(real).cast("double"))


def contains_point(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd ray cast; a point on a lower or left edge is inside, on an upper or right one not."""

    def crosses(s: Column) -> Column:
        a, b = s["a"], s["b"]
        hit = x < (b["x"] - a["x"]) * F.try_divide(y - a["y"], b["y"] - a["y"]) + a["x"]
        return F.when((a["y"] > y) != (b["y"] > y), hit.cast("int")).otherwise(0)

    return F.pmod(F.aggregate(F.transform(segments(ring), crosses), F.lit(0), lambda t, v: t + v), F.lit(2)) == 1


def point_segment_distance(x: Column, y: Column, a: Column, b: Column) -> Column:
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    along = F.coalesce(F.try_divide((x - a["x"]) * dx + (y - a["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    px, py = a["x"] + t * dx - x, a["y"] + t * dy - y
    return F.sqrt(px * px + py * py)


def point_line_distance(x: Column, y: Column, line: Column) -> Column:
    return F.array_min(F.transform(segments(line), lambda s: point_segment_distance(x, y, s["a"], s["b"])))


def rectangle(x: Column, y: Column, w: Column, h: Column) -> Column:
    """A closed axis-parallel ring."""
    return F.array(point(x, y), point(x + w, y), point(x + w, y + h), point(x, y + h), point(x, y))


def snapped(ring: Column, digits: int) -> Column:
    """Coordinates on a grid of ``digits`` decimals; points that fall together in a row are one."""
    near = F.transform(ring, lambda p: point(F.round(p["x"], digits), F.round(p["y"], digits)))
    return F.filter(near, lambda p, i: (i == 0) | (F.get(near, i - 1) != p))


def resampled(line: Column, step: float) -> Column:
    """Points at most ``step`` apart along a line, its own vertices included."""

    def between(s: Column) -> Column:
        a, b = s["a"], s["b"]
        n = F.greatest(F.lit(1), F.ceil(_distance(a, b) / F.lit(float(step))).cast("int"))
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: point(a["x"] + (b["x"] - a["x"]) * i / n, a["y"] + (b["y"] - a["y"]) * i / n))

    return F.concat(F.flatten(F.transform(segments(line), between)), F.array(F.element_at(line, -1)))


def lines_distance(a: Column, b: Column) -> Column:
    """Smallest distance of two lines' vertices to each other's segments: exact where they do not cross."""
    far = lambda p, q: F.array_min(F.transform(p, lambda v: point_line_distance(v["x"], v["y"], q)))
    return F.least(far(a, b), far(b, a))
