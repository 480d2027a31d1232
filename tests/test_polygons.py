"""Polygon overlay against counted cells and areas that must add up; trees, paths and searches by brute force."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from morphloom.functions import geometry as G
from morphloom.functions import overlay as O
from morphloom.functions import polygons as K
from morphloom.functions.shapes import hull
from morphloom.operators import cluster, polygons, spatial, ward

RINGS = "array<array<struct<x:double,y:double>>>"


def box(x, y, w, h):
    return [np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h)], float)]


def closed(*rings):
    return [[*map(tuple, r.tolist()), tuple(r[0].tolist())] for r in rings]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 7)] * 2, *[st.integers(1, 5)] * 2), min_size=1, max_size=6), st.lists(st.tuples(*[st.integers(0, 7)] * 2, *[st.integers(1, 5)] * 2), min_size=1, max_size=3))
def test_overlay_of_boxes_is_that_of_cells(a, b):
    def grid(boxes):
        out = np.zeros((14, 14), bool)
        for x, y, w, h in boxes:
            out[x + 1 : x + w + 1, y + 1 : y + h + 1] = True
        return out

    p, q = [box(*v) for v in a], [box(*v) for v in b]
    for made, cells in ((O.union(p), grid(a)), (O.intersection(p, q), grid(a) & grid(b)), (O.difference(p, q), grid(a) & ~grid(b))):
        assert math.isclose(sum(map(O.polygon_area, made)), cells.sum(), abs_tol=1e-6)
        rim = (cells[1:] != cells[:-1]).sum() + (cells[:, 1:] != cells[:, :-1]).sum()
        assert math.isclose(sum(O.ring_length(r) for part in made for r in part), rim, abs_tol=1e-6)


def test_overlay_of_any_polygons_adds_up():
    rng = np.random.default_rng(0)
    for _ in range(60):
        shift = rng.uniform(-1, 1, 2) + 4e6  # metres of a projected system
        a, b = [hull(rng.normal(size=(8, 2)) + shift)], [hull(rng.normal(size=(8, 2)) + 4e6)]
        area = lambda parts: sum(map(O.polygon_area, parts))
        both, either, rest = O.intersection([a], [b]), O.union([a, b]), O.difference([a], [b])
        assert math.isclose(area(both) + area(either), O.polygon_area(a) + O.polygon_area(b), abs_tol=1e-4)
        assert math.isclose(area(rest) + area(both), O.polygon_area(a), abs_tol=1e-4)
        for part in rest:
            x, y = O.representative_point(part)
            assert O.inside(np.array([[x, y]]), part)[0]


def test_buffers_faces_and_forms():
    grown = O.buffer([box(0, 0, 10, 10)], 1, 16)
    assert math.isclose(O.polygon_area(grown[0]), 140 + math.pi, rel_tol=1e-3)
    ell = [np.array([(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4)], float)]
    assert math.isclose(sum(map(O.polygon_area, O.buffer([ell], 0.5, 16))), 7 + 8 - 0.25 + 5 * math.pi / 16, rel_tol=1e-3)
    assert math.isclose(O.polygon_area(O.buffer([box(0, 0, 10, 10)], -1)[0]), 64, abs_tol=1e-4) and O.buffer([box(0, 0, 0.9, 9)], -0.5) == []
    assert math.isclose(sum(map(O.polygon_area, O.line_buffer(np.array([(0.0, 0.0), (5.0, 0.0)]), 1, 16))), 10 + math.pi, rel_tol=1e-2)
    lines = [np.array([(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)], float), np.array([(1, -1), (1, 3)], float), np.array([(0, 1), (5, 1)], float)]
    assert [O.signed_area(f) for f in O.faces(lines)] == [1.0] * 4 and O.faces(lines[1:]) == []
    bow = [np.array([(0, 0), (2, 2), (2, 0), (0, 2)], float)]
    assert sorted(O.polygon_area(p) for p in O.union([bow])) == [1.0, 1.0]
    turned = O.normalized([box(0, 0, 3, 3)[0][::-1], box(1, 1, 1, 1)[0]])
    assert turned[0].tolist() == box(0, 0, 3, 3)[0].tolist() and O.signed_area(turned[1]) < 0


@pytest.fixture(scope="module")
def row(spark):
    """Five boxes: two overlap much, two touch, a sliver leans on one of them."""
    given_ = [(0, closed(*box(0, 0, 10, 10))), (1, closed(*box(1, 1, 3, 3))), (2, closed(*box(20, 0, 10, 10))), (3, closed(*box(30, 2, 10, 10))), (4, closed(*box(40, 2, 0.6, 9))), (5, closed(*box(28, -9, 10, 9.5)))]
    return spark.createDataFrame(given_, f"id long, rings {RINGS}").repartition(3)


def areas(df):
    return {r.id: round(r.a, 4) for r in df.groupBy("id").agg(F.sum(G.polygon_area(F.col("rings"))).alias("a")).collect()}


def test_cleaning_of_footprints(spark, row):
    assert areas(polygons.merge_overlaps(row, "id", 20.0)) == {0: 100.0, 2: 100.0, 3: 100.0, 4: 5.4, 5: 95.0}
    cut = polygons.trim_overlaps(row, "id", 20.0)
    assert areas(cut) == {0: 91.0, 1: 9.0, 2: 99.0, 3: 100.0, 4: 5.4, 5: 95.0}
    assert {r.id for r in polygons.collapsing(row, "id").collect()} == {4}
    walls = {(r.focal, r.neighbor): r.length for r in polygons.shared_walls(row, "id", 20.0).collect()}
    assert math.isclose(walls[2, 3], 8.0) and math.isclose(walls[4, 3], 9.0) and (0, 2) not in walls
    assert areas(polygons.merge_touching(row, "id", 20.0, spark.createDataFrame([(4,)], "id long"))) == {0: 100.0, 1: 9.0, 2: 100.0, 3: 105.4, 5: 95.0}
    clean = polygons.clean_footprints(row)
    assert sorted(round(a, 3) for a in areas(clean).values()) == [95.0, 99.0, 100.0, 105.4]
    fuzzy = {(r.focal, r.neighbor) for r in polygons.fuzzy_contiguity(row, "id", 0.1, 20.0).collect()}
    assert {(2, 3), (3, 4), (0, 1), (2, 5)} <= fuzzy and (0, 2) not in fuzzy
    road = spark.createDataFrame([(7, [(0.0, 10.2), (15.0, 10.2)])], "nID long, line array<struct<x:double,y:double>>")
    assert {r.id for r in polygons.away_from_lines(row, road, "id", 0.3, 20.0).collect()} == {1, 2, 3, 4, 5}
    near = {r.id: (r.nID, round(r.distance, 3)) for r in polygons.nearest_line(row, road, "id", "nID", 0.5).collect()}
    assert len(near) == 6 and near[0] == (7, 0.2) and near[4] == (7, 25.0)


def test_dissolve_in_shares(spark):
    cells = [(i % 3, closed(*box((i // 3) % 30, (i // 3) // 30, 1, 1))) for i in range(2700)]
    df = spark.createDataFrame(cells, f"label long, rings {RINGS}").repartition(4)
    whole = polygons.dissolve(df, ["label"], "rings", 8.0).collect()
    assert [(r.label, r.part, len(r.rings)) for r in sorted(whole, key=lambda r: r.label)] == [(k, 0, 1) for k in range(3)]
    assert all(len(r.rings[0]) == 5 for r in whole)


def test_enclosures_by_region(spark):
    lines = spark.createDataFrame([(0, [(5.0, -1.0), (5.0, 11.0)]), (0, [(0.0, 4.0), (3.0, 4.0)]), (1, [(0.0, 5.0), (10.0, 5.0)])], "region long, line array<struct<x:double,y:double>>")
    limits = spark.createDataFrame([(k, closed(*box(0, 0, 10, 10))) for k in (0, 1, 2)], f"region long, rings {RINGS}")
    got = polygons.enclosures(lines, limits, ["region"]).groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.sum(G.polygon_area(F.col("rings"))).alias("a")).collect()
    assert sorted((r.region, r.n, r.a) for r in got) == [(0, 2, 100.0), (1, 2, 100.0), (2, 1, 100.0)]


def test_polygon_measures_in_frames(spark, row):
    got = {r.id: r for r in row.select("id", K.representative_point("rings").alias("p"), F.size(K.buffered(-0.5, 2)("rings")).alias("n"), K.normalized("rings").alias("z"), F.size(K.made_valid("rings")).alias("v")).collect()}
    assert got[4].n == 0 and got[0].n == 1 and got[0].v == 1 and 0 < got[0].p.x < 10 and len(got[0].z[0]) == 5
    snapped = spark.range(1).select(F.size(G.snapped(F.array(G.point(F.lit(0.12), F.lit(0)), G.point(F.lit(0.14), F.lit(0)), G.point(F.lit(3), F.lit(0))), 1)).alias("n"), F.size(G.resampled(F.array(G.point(F.lit(0), F.lit(0)), G.point(F.lit(25), F.lit(0))), 10)).alias("m")).first()
    assert (snapped.n, snapped.m) == (2, 4)


def test_nearest_gives_up_on_no_row(spark):
    left = spark.createDataFrame([(0, 0.0, 0.0), (1, 1e9, 0.0), (2, None, 0.0), (3, float("nan"), 1.0)], "id long, x double, y double")
    right = spark.createDataFrame([(7, 3.0, 4.0)], "other long, x double, y double")
    got = {r.id: r.distance for r in spatial.nearest(left, right, "id", "other", 1e-3).collect()}
    assert set(got) == {0, 1} and got[0] == 5.0
    line = spark.createDataFrame([(7, [(3.0, -9.0), (3.0, 9.0)])], "nID long, line array<struct<x:double,y:double>>")
    assert {r.id: r.distance for r in spatial.nearest_segment(left, line, "id", "nID", 0.5).collect()} == {0: 3.0, 1: 1e9 - 3}


@pytest.mark.parametrize("rule", ["gabriel", "rng"])
def test_proximity_edges_of_any_length(spark, rule):
    rng = np.random.default_rng(1)
    p = np.concatenate([rng.normal(size=(60, 2)), rng.normal(size=(6, 2)) * 40])
    d = ((p[:, None] - p[None]) ** 2).sum(2)
    spoiled = lambda i, j, k: d[i, k] + d[j, k] < d[i, j] if rule == "gabriel" else max(d[i, k], d[j, k]) < d[i, j]
    n = range(len(p))
    want = {(i, j) for i in n for j in n if i < j and not any(k not in (i, j) and spoiled(i, j, k) for k in n)}
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)], "id long, x double, y double")
    assert {(r.focal, r.neighbor) for r in spatial.proximity_graph(df, "id", rule, 0.4).collect()} == want


def test_paths_in_a_deep_tree(spark):
    n = 200
    chain = [(n + i, i + 1 if i else 1, n + i - 1 if i else 0, float(i), i + 2) for i in range(n - 1)]
    tree = spark.createDataFrame(chain, "node long, left long, right long, distance double, size long")
    got = cluster.leaves_under(tree).groupBy("node").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {r.node: r.n for r in got} == {n + i: i + 2 for i in range(n - 1)}


def test_ward_in_rounds_is_ward_one_by_one(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(12, 3)) + 6 * k for k in range(3)])
    z = cluster.ward_tree(x)
    nodes = spark.createDataFrame([(i, 1, [float(v) for v in r]) for i, r in enumerate(x)], "id long, size long, v array<double>")
    pairs = spark.createDataFrame([(i, j) for i in range(len(x)) for j in range(i)], "a long, b long")
    merges = ward.ward_merges(nodes, pairs)
    assert np.allclose(sorted(r.distance for r in merges.collect()), sorted(z[:, 2]))
    for t in (3.0, 30.0):
        want = cluster.flat_cut(z, len(x), t)
        got = [r.level_1 for r in ward.cut_levels(nodes, merges, [t]).orderBy("id").collect()]
        assert got == want.tolist()
    apart = ward.ward_merges(nodes, spark.createDataFrame([(0, 1)], "a long, b long"))
    assert apart.count() == len(x) - 1


def test_boxes_of_any_size_meet_once(spark):
    rng = np.random.default_rng(7)

    def boxes(n, seed):
        out = []
        for i in range(n):
            x, y = rng.uniform(-50, 50, 2)
            w, h = rng.uniform(0, 3, 2) * 10 ** rng.integers(0, 3)
            out.append((i, float(x), float(y), float(x + w), float(y + h)))
        return [*out, (n, -500.0, -500.0, 500.0, 500.0), (n + 1, 1.0, 1.0, 1.0, 1.0), (n + 2, 2.0, 0.0, 4.0, 2.0)]

    a, b = boxes(60, 0), boxes(50, 1)
    kind = "id long, minx double, miny double, maxx double, maxy double"
    left, right = spark.createDataFrame(a, kind), spark.createDataFrame(b, kind)
    want = sorted((p[0], q[0]) for p in a for q in b if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4])
    for size in (1.0, 2.0, 30.0):
        assert sorted((r.id, r.r_id) for r in spatial.box_join(left, right, size).collect()) == want
    assert spatial.box_join(left, right.limit(0), 1.0).count() == 0
