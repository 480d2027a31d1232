"""Street cleaning, triangulations and outlines on cases drawn by hand."""

import math

import numpy as np
import pytest

from morphloom.operators import outline, streets

LINES = f"id long, line {streets.LINE}"


def drawn(df):
    return sorted(tuple(round(v, 6) for p in (r.line if (r.line[0].x, r.line[0].y) <= (r.line[-1].x, r.line[-1].y) else r.line[::-1]) for v in (p.x, p.y)) for r in df.collect())


def test_gaps_extensions_and_junctions(spark):
    gap = spark.createDataFrame([(0, [(0.0, 0.0), (10.0, 0.0)]), (1, [(11.0, 0.0), (20.0, 0.0)]), (2, [(0.0, 9.0), (20.0, 9.0)])], LINES)
    assert drawn(streets.close_gaps(gap, "id", 2.0)) == [(0, 0, 10.5, 0), (0, 9, 20, 9), (10.5, 0, 20, 0)]
    short = spark.createDataFrame([(0, [(0.0, 0.0), (10.0, 0.0)]), (1, [(5.0, 6.0), (5.0, 1.0)])], LINES)
    assert drawn(streets.extend(short, "id", 2.0)) == [(0, 0, 10, 0), (5, 0, 5, 6)]
    assert drawn(streets.extend(short, "id", 0.5)) == [(0, 0, 10, 0), (5, 1, 5, 6)]
    cut = streets.split_at_junctions(streets.extend(short, "id", 2.0), "id")
    assert drawn(cut) == [(0, 0, 5, 0), (5, 0, 5, 6), (5, 0, 10, 0)]
    crossing = spark.createDataFrame([(0, [(-9.0, 0.0), (0.0, 0.0)]), (1, [(0.0, 0.0), (1.0, 0.0)]), (2, [(1.0, 0.0), (9.0, 0.0)]), (3, [(0.0, 0.0), (0.0, 9.0)]), (4, [(1.0, 0.0), (1.0, -9.0)])], LINES)
    assert drawn(streets.consolidate(crossing, "id", 1.5)) == [(-9, 0, 0.5, 0), (0, 9, 0.5, 0), (0.5, 0, 1, -9), (0.5, 0, 9, 0)]


def test_false_junctions_vanish(spark):
    lines = [(0, [(0.0, 0.0), (1.0, 0.0)]), (1, [(2.0, 0.0), (1.0, 0.0)]), (2, [(2.0, 0.0), (3.0, 1.0), (4.0, 0.0)]), (3, [(4.0, 0.0), (4.0, 5.0)]), (4, [(4.0, 0.0), (9.0, 0.0)]), (5, [(0.0, 50.0), (1.0, 50.0)]), (6, [(1.0, 50.0), (0.0, 51.0)]), (7, [(0.0, 51.0), (0.0, 50.0)])]
    got = streets.remove_false_nodes(spark.createDataFrame(lines, LINES).repartition(3), "id").collect()
    assert {r.id: len(r.line) for r in got} == {0: 5, 3: 2, 4: 2, 5: 4}
    assert math.isclose(sum(math.dist(a, b) for r in got for a, b in zip(r.line, r.line[1:])), 2 + 2 * math.sqrt(2) + 10 + 2 + math.sqrt(2))
    flags = spark.createDataFrame([(0, [(0.0, 0.0), (9.0, 0.0)], None), (1, [(9.0, 0.0), (99.0, 0.0)], [(["is_tunnel"], [0.0, 1.0])])], f"{LINES}, road_flags array<struct<values:array<string>,between:array<double>>>")
    assert [r.id for r in streets.simplify_streets(flags).collect()] == [0]


@pytest.mark.parametrize("shift", [0.0, 4e6])
def test_triangulation_is_delaunay(shift):
    rng = np.random.default_rng(3)
    p = rng.uniform(0, 100, (300, 2)) + shift
    t = outline.delaunay(p)
    assert len(t) > 560
    a, b, c = p[t[:, 0]], p[t[:, 1]], p[t[:, 2]]
    area = np.abs((b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])).sum() / 2
    from morphloom.functions.shapes import hull, ring_area

    assert math.isclose(area, ring_area(hull(p)), rel_tol=1e-6)
    assert len(outline.delaunay(np.concatenate([p, p[:50]]))) == len(t)
    assert outline.delaunay(p[:2]).shape == (0, 3) and len(outline.delaunay(np.array([[0.0, 0], [1, 1], [2, 2]]))) == 0


def test_concave_outline_and_inscribed_circle():
    grid = np.array([(x, y) for x in range(12) for y in range(12) if not (3 < x < 8 and y > 3)], float)
    rings = outline.concave_ring(grid, 1.5)
    from morphloom.functions.overlay import signed_area

    assert len(rings) == 1 and math.isclose(abs(signed_area(rings[0])), 11 * 3 + 2 * 3 * 8 + 2 * 0.5)  # a triangle fills each inner corner
    ell = [np.array([(0, 0), (10, 0), (10, 3), (3, 3), (3, 10), (0, 10)], float)]
    x, y, r = outline.inscribed_circle(ell, 1e-4)
    # it touches two walls and the inner corner, and is larger than either arm's
    assert math.isclose(r, 3 * math.sqrt(2) / (1 + math.sqrt(2)), abs_tol=1e-3) and math.isclose(x, y, abs_tol=1e-2)
