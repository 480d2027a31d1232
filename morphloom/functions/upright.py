"""Closed forms for one upright rectangle, or two that meet, grown by a disc of ``4 * quarter`` corners.

Boxes are rows of minx, miny, maxx, maxy. The growth of a union is the union of the growths, so these
are the measures that ``overlay.buffer`` and ``overlay.union`` lead to, for whole columns at a time.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from morphloom.functions import shapes as S
from morphloom.functions.overlay import PRECISION

MEASURES = ["area", "perimeter", "outer_length", "n_rings", "longest", "shortest"]
#: Shortest side, and how much longer than the growth a step or half a courtyard's side has to be.
LEAST = 1e-3
#: Coordinates up to which snapping is exact.
FAR = 1e9
_MEASURES = T.StructType([T.StructField(c, T.DoubleType()) for c in MEASURES])


def snapped(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two different boxes on the grid on which they would be united; a box alone as it is."""
    origin = np.tile(np.floor(np.minimum(a, b)[:, :2]), 2)
    two = (a != b).any(1)[:, None]
    near = lambda v: np.where(two, np.round((v - origin) / PRECISION) * PRECISION, v)
    return near(a), near(b)


def holds(a: np.ndarray, b: np.ndarray, hole: np.ndarray, distance: float) -> np.ndarray:
    """Where the closed forms hold: boxes that are the same or meet along more than a point, whose steps and
    courtyard's sides (NaN without one) the growth does not use up."""
    sides = np.concatenate([v[:, 2:] - v[:, :2] for v in (a, b)], 1)
    known = np.isfinite(sides).all(1) & (np.abs(np.concatenate([a, b], 1)) < FAR).all(1) & (sides > LEAST).all(1)
    court = np.isnan(hole).all(1)
    same = (a == b).all(1)
    a, b = snapped(np.where(known[:, None], a, 0.0), np.where(known[:, None], b, 0.0))
    shared = np.minimum(a, b)[:, 2:] - np.maximum(a, b)[:, :2]
    steps = np.abs(a - b)
    meet = (shared >= 0).all(1) & (shared.max(1) > LEAST) & ((steps == 0) | (steps > distance + LEAST)).all(1) & court
    return known & np.where(same, court | (hole > 2 * (distance + LEAST)).all(1), meet)


def concave(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Concave corners of the union of two boxes: where an upright edge of one runs into a level edge of the other."""
    n = np.zeros(len(a))
    for p, q in ((a, b), (b, a)):
        for x in (0, 2):
            for y in (1, 3):
                at_x, at_y = p[:, x], q[:, y]
                # beyond the upright edge there has to be q, beyond the level edge p
                go_x = (q[:, 0] <= at_x) & (at_x < q[:, 2]) if x else (q[:, 0] < at_x) & (at_x <= q[:, 2])
                go_y = (p[:, 1] <= at_y) & (at_y < p[:, 3]) if y == 3 else (p[:, 1] < at_y) & (at_y <= p[:, 3])
                corner = (at_x == q[:, 2 - x]) & (at_y == p[:, 4 - y])
                n += go_x & go_y & ~corner
    return n


def smallest_rectangle(a: np.ndarray, b: np.ndarray, distance: float, quarter: int) -> tuple[np.ndarray, np.ndarray]:
    """Long and short side of the smallest rectangle around two grown boxes. It lies along an edge of the hull:
    of a box, of the disc, or one that joins two like corners of the boxes."""
    step = math.pi / (2 * quarter)
    fixed = np.concatenate([[0.0], (np.arange(quarter) + 0.5) * step if distance else []])
    d = b - a
    joins = np.stack([np.arctan2(d[:, y], d[:, x]) % (math.pi / 2) for x in (0, 2) for y in (1, 3)], 1)
    angle = np.sort(np.concatenate([np.tile(fixed, (len(a), 1)), joins], 1), 1)
    c, s = np.cos(angle), np.sin(angle)
    off = np.abs(angle - np.round(angle / step) * step)
    more = 2 * distance * np.cos(off)
    at = lambda v, x, y: (c * v[:, x, None] + s * v[:, y, None], c * v[:, y, None] - s * v[:, x, None])
    wide = np.maximum(at(a, 2, 3)[0], at(b, 2, 3)[0]) - np.minimum(at(a, 0, 1)[0], at(b, 0, 1)[0]) + more
    tall = np.maximum(at(a, 0, 3)[1], at(b, 0, 3)[1]) - np.minimum(at(a, 2, 1)[1], at(b, 2, 1)[1]) + more
    size = wide * tall
    best = (size <= size.min(1, keepdims=True) + 1e-12).argmax(1)[:, None]
    w, t = np.take_along_axis(wide, best, 1)[:, 0], np.take_along_axis(tall, best, 1)[:, 0]
    return np.maximum(w, t), np.minimum(w, t)


def measures(a: np.ndarray, b: np.ndarray, hole: np.ndarray, distance: float, quarter: int) -> list[np.ndarray]:
    """``MEASURES`` of the union of two boxes (or one: both the same), grown; ``hole`` has the courtyard's sides or NaN."""
    a, b = snapped(a, b)
    shared = np.minimum(a, b)[:, 2:] - np.maximum(a, b)[:, :2]
    sides = [v[:, 2:] - v[:, :2] for v in (a, b)]
    flat, rim = (sum(f(v) for v in sides) - f(shared) for f in (lambda v: v.prod(1), lambda v: 2 * v.sum(1)))
    steps = concave(a, b)
    sector, arc = quarter * distance**2 * math.sin(math.pi / (2 * quarter)) / 2, 2 * quarter * distance * math.sin(math.pi / (4 * quarter))
    outer = rim + (4 + steps) * arc - 2 * steps * distance
    court = np.nan_to_num(hole - 2 * distance)
    area = flat + rim * distance + (4 + steps) * sector - steps * distance**2 - court.prod(1)
    long, short = smallest_rectangle(a, b, distance, quarter)
    return [area, outer + 2 * court.sum(1), outer, (~np.isnan(hole).any(1)).astype(float), long, short]


def radii(a: np.ndarray, b: np.ndarray, distance: float, quarter: int) -> np.ndarray:
    """Radius of the smallest circle around the two grown boxes."""
    a, b = snapped(a, b)
    step, side = math.pi / (2 * quarter), a[:, 2:] - a[:, :2]
    half, angle = np.hypot(*side.T) / 2, np.arctan2(side[:, 1], side[:, 0])
    out = np.sqrt(half**2 + distance**2 + 2 * half * distance * np.cos(angle - np.round(angle / step) * step))
    turn = np.linspace(0, math.pi / 2, quarter + 1)
    for i in np.flatnonzero((a != b).any(1)):
        arcs = [v[[x, y]] + distance * np.stack([(1 if x else -1) * np.cos(turn), (1 if y == 3 else -1) * np.sin(turn)], 1) for v in (a[i], b[i]) for x in (0, 2) for y in (1, 3)]
        out[i] = S.enclosing_circle(np.concatenate(arcs))[2]
    return out


def _table(columns: tuple[pa.Array, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v = np.stack([np.asarray(c.to_numpy(zero_copy_only=False), float) for c in columns], 1)
    return v[:, :4], v[:, 4:8], v[:, 8:]


def grown(distance: float, quarter: int, most: float):
    """A UDF of two boxes and a courtyard's sides: ``MEASURES``, null where the closed forms do not hold up to a growth by ``most``."""

    @F.arrow_udf(_MEASURES)
    def run(ax: pa.Array, ay: pa.Array, aX: pa.Array, aY: pa.Array, bx: pa.Array, by: pa.Array, bX: pa.Array, bY: pa.Array, w: pa.Array, h: pa.Array) -> pa.Array:
        a, b, hole = _table((ax, ay, aX, aY, bx, by, bX, bY, w, h))
        ok = holds(a, b, hole, most)
        a, b, hole = (v[ok] for v in (a, b, hole))
        fill = np.zeros((len(MEASURES), len(ok)))
        fill[:, ok] = measures(a, b, hole, distance, quarter) if ok.any() else 0.0
        return pa.StructArray.from_arrays([pa.array(v) for v in fill], fields=[pa.field(c, pa.float64()) for c in MEASURES], mask=pa.array(~ok))

    return run


def grown_radius(distance: float, quarter: int):
    """A UDF of two boxes: the radius of the smallest circle around them, grown."""

    @F.arrow_udf(T.DoubleType())
    def run(ax: pa.Array, ay: pa.Array, aX: pa.Array, aY: pa.Array, bx: pa.Array, by: pa.Array, bX: pa.Array, bY: pa.Array) -> pa.Array:
        a, b, _ = _table((ax, ay, aX, aY, bx, by, bX, bY))
        return pa.array(radii(a, b, distance, quarter))

    return run
