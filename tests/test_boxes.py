"""Pairs of boxes: what needs no overlay, and cells as small as the boxes."""

import math

import numpy as np

from pyspark.sql import functions as F

from morphloom.functions import geometry as G
from morphloom.functions import polygons as K
from morphloom.functions.scalar import rounded
from morphloom.operators import polygons as P
from morphloom.operators import spatial

RINGS = "array<array<struct<x:double,y:double>>>"


def box(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_small_overlaps_are_not_snapped():
    """areas of some 1e-4 were off by 1e-8, enough to round the other way."""
    a, b = (np.array(box(*v)[:-1]) for v in ((0.1234567891, 0.2, 0.05, 0.05), (0.1500000003, 0.2100000007, 0.05, 0.05)))
    want = (0.1234567891 + 0.05 - 0.1500000003) * (0.2 + 0.05 - 0.2100000007)
    assert math.isclose(K.common_area([a], [b]), want, rel_tol=1e-12)
    ell = np.array([(0.1, 0.2), (0.18, 0.2), (0.18, 0.22), (0.14, 0.22), (0.14, 0.26), (0.1, 0.26)]) + 1.1e-7
    assert math.isclose(K.common_area([ell], [np.array(box(0.12, 0.21, 0.05, 0.06)[:-1])]), 0.05 * (0.01 + 1.1e-7) + (0.02 + 1.1e-7) * 0.04, rel_tol=1e-7)


def test_overlaps_of_upright_rectangles_need_no_python(spark):
    """F8: every pair of rectangles went through the overlay."""
    rows = [(i, [box(0.01 * (i % 7), 0.013 * (i % 5), 0.02, 0.03)]) for i in range(20)]
    found = P.overlapping(spark.createDataFrame(rows, f"id long, rings {RINGS}"), "id", 0.5)
    assert "shared_area" not in plan(found) and "common_area" not in plan(found) and "EvalPython" not in plan(found)
    side = lambda i, j, step, n, s: max(0.0, s - step * abs(i % n - j % n))
    want = {(i, j): side(i, j, 0.01, 7, 0.02) * side(i, j, 0.013, 5, 0.03) for i in range(20) for j in range(i + 1, 20)}
    got = {(r.a, r.b): r.overlap for r in found.collect()}
    assert got.keys() == {k for k, v in want.items() if v > 1e-6} and all(math.isclose(v, want[k], rel_tol=1e-9) for k, v in got.items())
    mixed = spark.createDataFrame([*rows, (20, [[(0.0, 0.0), (0.02, 0.0), (0.0, 0.02), (0.0, 0.0)]])], f"id long, rings {RINGS}")
    both = {(r.a, r.b): r.overlap for r in P.overlapping(mixed, "id", 0.5).collect()}
    assert got.items() <= {k: v for k, v in both.items()}.items() and math.isclose(both[0, 20], 0.0002, rel_tol=1e-9)


def test_cells_are_as_small_as_the_boxes(spark):
    """all boxes of a dense place met in cells of the size asked for."""
    rows = spark.createDataFrame([(0.0, 0.0, 0.02, 0.01), (0.0, 0.0, 0.5, 0.1), (0.0, 0.0, 3.0, 1.0), (0.2, 0.2, 0.2, 0.2)], "minx double, miny double, maxx double, maxy double")
    assert [r.l for r in rows.select(spatial._level(("minx", "miny", "maxx", "maxy"), 0.5).alias("l")).collect()] == [-4, 0, 3, -spatial.FINER]
    rng = np.random.default_rng(3)
    at, side = rng.random((150, 2)), rng.choice([0.001, 0.02, 0.3, 2.0], (150, 2))
    own = spark.createDataFrame([(i, float(x), float(y), float(x + w), float(y + h)) for i, ((x, y), (w, h)) in enumerate(zip(at, side))], "id long, minx double, miny double, maxx double, maxy double")
    got = sorted((r.id, r.r_id) for r in spatial.box_join(own, own, 0.25).select("id", "r_id").collect())
    meets = lambda i, j: (at[i] <= at[j] + side[j]).all() and (at[j] <= at[i] + side[i]).all()
    assert got == [(i, j) for i in range(150) for j in range(150) if meets(i, j)]


def test_largest_overlaps_of_upright_rectangles_need_no_python(spark):
    own = spark.createDataFrame([(i, box(0.01 * i, 0.0, 0.025, 0.1)) for i in range(9)], "id long, ring array<struct<x:double,y:double>>")
    pairs = spatial.polygon_overlaps(own, own, 0.5).where("id <> r_id")
    assert "EvalPython" not in plan(pairs)
    best = {r.id: (r.r_id, r.overlap) for r in spatial.largest_overlap(pairs.withColumn("overlap", F.round("overlap", 9)), "id", "r_id").collect()}
    assert best == {i: (i - 1 if i else 1, 0.0015) for i in range(9)}


def test_extracts_by_an_upright_region_need_no_python(spark):
    """each feature whose box meets the boundary went through the overlay."""
    own = spark.createDataFrame([(0, [box(0.4, 0.4, 0.2, 0.2)]), (1, [box(0.5, 0.0, 0.2, 0.2)]), (2, [box(-1.0, -1.0, 3.0, 3.0)]), (3, [[(0.45, 0.7), (0.7, 0.45), (0.7, 0.7), (0.45, 0.7)]])], f"id long, rings {RINGS}")
    region = spark.createDataFrame([([box(-0.5, -0.5, 1.0, 1.0)],)], f"rings {RINGS}")
    assert "EvalPython" not in plan(P.intersecting(own.where("id < 3"), region, 0.5))
    assert sorted(r.id for r in P.intersecting(own, region, 0.5).collect()) == [0, 2]


def test_large_sides_are_not_broadcast(spark):
    """what the planner takes for a table's size knows nothing of exploded rings and cells, so all edges went through the driver."""
    own = spark.range(4000).select("id", F.array(F.array(*(F.struct((F.col("id") * 2.0 + x).alias("x"), F.lit(y).alias("y")) for x, y in box(0.0, 0.0, 2.0, 1.0)))).alias("rings"))
    walls = P.shared_walls(own, "id", 20.0)
    chosen = walls._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in chosen and "Broadcast" not in chosen
    got = walls.agg(F.count(F.lit(1)), F.min("length"), F.max("length")).first()
    assert tuple(got) == (2 * 3999, 1.0, 1.0)
    few = spatial.box_join(P.boxed(own), P.boxed(own.where("id < 3")), 20.0)
    assert "SortMergeJoin" not in few._jdf.queryExecution().executedPlan().toString()


def test_a_few_regions_need_no_join(spark):
    """polygons were written, numbered and joined, and pushed filters repeated each box in every comparison."""
    rows = spark.range(300).select("id", F.array(G.rectangle(F.col("id") % 20 - 10.0, F.floor(F.col("id") / 20) - 8.0, F.lit(0.5) + F.col("id") % 3, F.lit(1.0))).alias("rings"))
    odd = spark.createDataFrame([(300, [[(3.0, 3.0), (5.0, 1.0), (5.0, 3.0), (3.0, 3.0)]]), (301, [[(1.4, 2.4), (2.4, 1.4), (2.4, 2.4), (1.4, 2.4)]]), (302, None)], f"id long, rings {RINGS}")
    regions = [box(-2.0, -3.0, 4.0, 5.0), box(6.5, 1.0, 1.0, 1.0)]
    where = lambda some: spark.createDataFrame([([r],) for r in some], f"rings {RINGS}")
    found = P.intersecting(rows, where(regions), 0.5)
    assert "Join" not in plan(found) and "EvalPython" not in plan(found) and plan(found).count("array_min(") == 2
    inside = lambda i, r: max(i % 20 - 10, r[0][0]) < min(i % 20 - 9.5 + i % 3, r[2][0]) and max(i // 20 - 8, r[0][1]) < min(i // 20 - 7, r[2][1])
    want = [i for i in range(300) if any(inside(i, r) for r in regions)]
    assert sorted(r.id for r in found.collect()) == want and found.columns == ["id", "rings"]
    both = rows.unionByName(odd)
    assert sorted(r.id for r in P.intersecting(both, where(regions), 0.5).collect()) == [*want, 301]
    ell = [(-2.0, -3.0), (2.0, -3.0), (2.0, 2.0), (1.0, 2.0), (1.0, -2.0), (-2.0, -2.0), (-2.0, -3.0)]
    part = {r.id for r in P.intersecting(both, where([ell]), 0.5).collect()}
    assert part == {r.id for r in P._intersecting(both, P.plain_boxes(where([ell]).withColumnRenamed("rings", "g"), "g"), 0.5, "rings").collect()} and 0 < len(part) < len(want)
    many = [box(-2.0 + i, -3.0, 0.25, 0.25) for i in range(P.FEW_REGIONS + 1)]
    assert {r.id for r in P.intersecting(rows, where(many), 0.5).collect()} == {i for i in range(300) if any(inside(i, r) for r in many)}
    assert P.intersecting(rows, where([]), 0.5).count() == 0


def test_pairs_of_one_table_are_met_once(spark):
    """F8: a table's boxes met each other twice, in cells of twice their size, and filters repeated the whole ring."""
    rng = np.random.default_rng(5)
    at, side = rng.integers(0, 24, (200, 2)) / 16, rng.choice([0.0, 1e-6, 1 / 16, 0.3, 2.0], (200, 2))
    own = spark.createDataFrame([(i, float(x), float(y), float(x + w), float(y + h), True) for i, ((x, y), (w, h)) in enumerate(zip(at, side))], "id long, minx double, miny double, maxx double, maxy double, _up boolean")
    seen, others = spatial.extents(own, 0.25, "_up")
    assert others == 0 and sum(n for _, n, *_ in seen) == 200 and len(seen) > 3
    found = [tuple(sorted(r)) for r in spatial.box_pairs(own.drop("_up"), "id", 0.25, seen).select("id", "r_id").collect()]
    meets = lambda i, j: (at[i] <= at[j] + side[j]).all() and (at[j] <= at[i] + side[i]).all()
    assert sorted(found) == [(i, j) for i in range(200) for j in range(i + 1, 200) if meets(i, j)]
    chosen = plan(P.overlapping(spark.createDataFrame([(i, [box(0.01 * i, 0.0, 0.02, 0.03)]) for i in range(20)], f"id long, rings {RINGS}"), "id", 0.5))
    assert chosen.count("Join") == 1 and "Union" not in chosen


def test_areas_are_rounded_as_in_sql(spark):
    """F8: two of 3,377,901 areas were rounded as decimals, not as doubles."""
    import duckdb

    values = [i / 1e5 + 5e-6 for i in range(300)]
    got = [r.v for r in spark.createDataFrame([(v,) for v in values], "v double").select(rounded(F.col("v"), 5).alias("v")).collect()]
    assert got == [duckdb.execute("SELECT round(CAST(? AS DOUBLE), 5)", [v]).fetchone()[0] for v in values]


def test_largest_overlaps_sort_few_pairs(spark):
    """all overlapping pairs were sorted, and their number grows with the square of the density."""
    rng = np.random.default_rng(7)
    at, side = rng.integers(0, 40, (400, 2)) / 20, rng.choice([0.1, 0.4, 1.5], (400, 2)) + rng.integers(0, 3, (400, 2)) / 32
    rows = [(i, box(float(x), float(y), float(w), float(h))) for i, ((x, y), (w, h)) in enumerate(zip(at, side))]
    rows += [(400, box(9.0, 9.0, 1.0, 1.0)), (401, [(0.0, 0.0), (0.9, 0.0), (0.0, 0.9), (0.0, 0.0)])]
    frame = lambda some: spark.createDataFrame(some, "id long, ring array<struct<x:double,y:double>>")
    plainly = lambda df: {r.id: (r.r_id, r.overlap) for r in spatial.largest_overlap(spatial.polygon_overlaps(df, df, 0.5).where("id <> r_id").withColumn("overlap", rounded(F.col("overlap"), 6)), "id", "r_id").collect()}
    for some in (rows[:401], rows, rows[400:], rows[:0]):
        found = spatial.largest_overlaps(frame(some), "id", 0.5, 6)
        assert {r.id: (r.r_id, r.overlap) for r in found.collect()} == plainly(frame(some)) and found.columns == ["id", "r_id", "overlap"]
    chosen = plan(spatial.largest_overlaps(frame(rows[:401]), "id", 0.5, 6))
    assert "least" in chosen and "EvalPython" not in chosen
